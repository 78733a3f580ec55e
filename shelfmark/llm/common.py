"""Expressions that several training-data operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: anything between ASCII white space (fixed by the result contracts).
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def free(columns: list[str], name: str) -> str:
    """``name`` with as many underscores after it as make it clash with no column, whatever the case of their letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def first_ids(rows: DataFrame, by: str, wanted: int, most: int = 2000) -> dict:
    """For each value of ``by`` its first ``wanted`` distinct ids in the order of a hash, or all of them, on the driver.

    ``rows`` is (id, by) without nulls and should be free of wide columns. More than ``most`` values of ``by`` are refused with an
    error and the ids asked for are bounded, so what is collected is bounded too: only ids whose hash lies below a bound, set from counts so that about one and a half
    times the ids wanted do, leave their partition; should they be too few, as where ids repeat, the bound is raised. No window or
    sort sees a whole group, so a value that holds most rows is no hot key.
    """
    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"{by} has more than {most} values")
    place, top = F.xxhash64("id", F.lit(7)), 2.0**63
    share, out = {k: min(1.0, (1.5 * wanted + 50) / n) for k, n in counts.items()}, {}
    while share:
        bound = {k: 2 * top * s - top for k, s in share.items()}
        below = [(F.col(by) == F.lit(k)) & (place <= F.lit(min(math.floor(b), 2**63 - 1))) for k, b in bound.items()]
        keep = below[0]
        for more in below[1:]:
            keep |= more
        found = {k: [] for k in share}
        for r in rows.filter(keep).select(by, "id", place.alias("place")).distinct().collect():
            found[r[by]].append((r["place"], r["id"]))
        for k, ids in found.items():
            if len(ids) >= wanted or share[k] == 1.0:
                out[k] = [i for _, i in sorted(ids)[:wanted]]
        share = {k: min(1.0, 4 * s) for k, s in share.items() if k not in out}
    return out
