"""``python -m shelfmark split|join|recommend ...``: the runs of ``shelfmark.workflow`` from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from shelfmark import workflow
from shelfmark.session import session
from shelfmark.sources.manifest import Source


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("shelfmark")
    runs = parser.add_subparsers(dest="run", required=True)
    split = runs.add_parser("split", help="samples, cleaning, core, random split")
    split.add_argument("interactions")
    split.add_argument("out")
    join = runs.add_parser("join", help="join to the catalogue, checks, split by time")
    join.add_argument("interactions", nargs="+", help="one path, or a train and a test path")
    join.add_argument("--catalogue", required=True)
    join.add_argument("--out", required=True)
    recommend = runs.add_parser("recommend", help="representation, profiles, rankings, analysis")
    recommend.add_argument("prepared")
    recommend.add_argument("out")
    given = parser.parse_args(args)
    spark = session()
    if given.run == "split":
        page = json.dumps(workflow.sample_and_split(spark, given.interactions, given.out), indent=2)
    elif given.run == "join":
        rows = Source("interactions", "interactions", tuple(given.interactions))
        page = workflow.join_and_report(spark, rows, Source("catalogue", "metadata", (given.catalogue,)), given.out)
    else:
        page = workflow.recommend_and_analyse(spark, given.prepared, given.out)
    sys.stdout.write(page + "\n")


if __name__ == "__main__":
    main()
