"""Quotation linking for conversations.

Lines that begin with ``>`` marks are quotes; the number of marks is their level. Consecutive lines of one level make a
quoted passage. An attribution line right before a deeper quote ("... wrote:") belongs to the quote. A message's own text is
what remains. Texts are normalised (lower case, runs of anything but letters and digits as one space) and hashed (XXH3,
128 bits) as a whole, by paragraph and by line, so that partial and rewrapped quotes are found.

A quoted unit links to the original: the first message of the same conversation that says it, if it is earlier, else the
first message of any conversation that does, unless that is the quoting message itself. Originals are aggregated by hash before the join, which is therefore many to
one, however often a line is said. A passage's origin is that of its longest linked unit; a message replies to the origin
of its longest linked passage at level 1, by units whose original comes before it in the order of (conversation, turn): the
tables have no times, and replies may not go round in circles. Other linked quotes only count. Messages without one reply to the turn before them in their conversation.

Conversations are rebuilt without quotes in reply order: a thread is a root message and all that reply to it directly or
not, depths are found by pointer doubling, and ``position`` numbers a conversation's messages by thread, then by depth, then by
turn, so replies follow what they reply to and threads stay together. Numbers come from sorted ranges whose sizes are summed,
and the turn before is looked up by blocks of ``BLOCK`` turns, so a long conversation is never one task's group.

Defined cases: a null text is empty; null roles stay; rows with a null conversation or turn are left out; repeated
(conversation, turn) keep the row with the least (role, text); a text of quotes only has an empty own text; a quote that
nobody said links nowhere; of passages of equal length the first in the message counts; very long texts are parsed whole; an empty
table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shelfmark.plans.lineage import cut

BLOCK = 1024
_UNITS = "array<struct<hash:string,words:int>>"
_PARSED = f"own string, own_units {_UNITS}, quotes array<struct<quote:int,level:int,text:string,units:{_UNITS}>>"
_MARK = re.compile(r"[ \t]{0,3}>[ \t]?")
_ATTRIBUTION = re.compile(r"(wrote|writes|said|écrit|a écrit|schrieb|escribió)\s*:\s*$", re.IGNORECASE)
_OTHER = re.compile(r"[\W_]+")


def level_of(line: str) -> tuple[int, str]:
    """Number of quote marks before a line, and the line without them."""
    level = 0
    while m := _MARK.match(line):
        level, line = level + 1, line[m.end() :]
    return level, line


def normalise(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def units(text: str) -> list[dict]:
    """Distinct (hash, words) of a text as a whole, of its paragraphs and of its lines."""
    found = {normalise(t): None for t in [text, *re.split(r"\n\s*\n", text), *text.split("\n")]}
    return [{"hash": xxhash.xxh3_128_hexdigest(t.encode("utf-8", "replace")), "words": t.count(" ") + 1} for t in found if t]


def parse(text: str | None) -> tuple[str, list[dict], list[dict]]:
    """Own text, its units, and the quoted passages in order."""
    lines = [level_of(line) for line in re.split(r"\r?\n", text or "")]
    below = [level for level, _ in lines[1:]] + [0]
    own, quotes, run = [], [], None
    for (level, line), deeper in zip(lines, below, strict=True):
        if deeper > level and _ATTRIBUTION.search(line):
            run = None
        elif not level:
            own.append(line)
            run = None
        else:
            if run is None or run["level"] != level:
                run = {"quote": len(quotes), "level": level, "lines": []}
                quotes.append(run)
            run["lines"].append(line)
    said = "\n".join(own).strip()
    return said, units(said), [{"quote": q["quote"], "level": q["level"], "text": (t := "\n".join(q["lines"]).strip()), "units": units(t)} for q in quotes]


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """One row a message: conv_id, turn, role, text (without quotes), n_quotes, n_linked, parent_conv, parent_turn, linked_by."""

    @pandas_udf(_PARSED)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t) for t in texts], columns=["own", "own_units", "quotes"])

    rows = messages.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).alias("role"),
        F.coalesce(text, F.lit("")).alias("_text"),
    ).filter("conv_id is not null and turn is not null")
    rows = rows.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "_text")).alias("m")).select("conv_id", "turn", "m.role", parsed("m._text").alias("p"))
    rows = cut(rows.select("conv_id", "turn", "role", "p.*"))
    asked = rows.select("conv_id", "turn", F.explode("quotes").alias("q")).select(
        "conv_id",
        "turn",
        "q.quote",
        "q.level",
        F.explode("q.units").alias("u"),
    ).select("conv_id", "turn", "quote", "level", "u.hash", "u.words")
    said = rows.select("conv_id", "turn", F.explode("own_units").alias("u")).select("conv_id", "turn", "u.hash").join(asked.select("hash").distinct(), "hash", "left_semi")
    first_here = said.groupBy("hash", "conv_id").agg(F.min("turn").alias("here"))
    first = said.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("any"))
    met = asked.join(first_here, ["hash", "conv_id"], "left").join(first, "hash", "left")
    here = F.when(F.col("here") < F.col("turn"), F.struct("conv_id", F.col("here").alias("turn")))
    there = F.when(F.col("any") < F.struct("conv_id", "turn"), F.col("any"))
    other = F.col("any") != F.struct("conv_id", "turn")
    units_found = met.withColumn("origin", F.coalesce(here, there)).filter(F.col("origin").isNotNull() | other)
    before = F.col("origin").isNotNull()
    by_quote = units_found.groupBy("conv_id", "turn", "quote", "level").agg(
        F.max_by("origin", F.when(before, F.struct("words", "hash"))).alias("origin"),
        F.max(F.when(before, F.col("words"))).alias("words"),
    )
    by_message = by_quote.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.max_by("origin", F.when((F.col("level") == 1) & F.col("origin").isNotNull(), F.struct("words", -F.col("quote")))).alias("origin"))
    block = F.floor(F.col("turn") / BLOCK)
    blocks = rows.groupBy("conv_id", block.alias("_block")).agg(F.max("turn").alias("_last"))
    by_block = Window.partitionBy("conv_id").orderBy("_block")
    blocks = blocks.withColumn("_last", F.lag("_last").over(by_block))
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn")
    placed = rows.withColumn("_block", block).join(blocks, ["conv_id", "_block"])
    placed = placed.withColumn("_before", F.coalesce(F.lag("turn").over(inside), "_last"))
    out = placed.join(by_message, ["conv_id", "turn"], "left")
    linked = F.col("origin").isNotNull()
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.col("own").alias("text"),
        F.size("quotes").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.when(linked, F.col("origin.conv_id")).when(F.col("_before").isNotNull(), F.col("conv_id")).alias("parent_conv"),
        F.coalesce("origin.turn", "_before").alias("parent_turn"),
        F.when(linked, "quote").when(F.col("_before").isNotNull(), "order").alias("linked_by"),
    )


def threads(linked: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``linked`` with thread_conv and thread_turn (the message at the root), depth (replies from it) and position, by pointer doubling."""
    linked = cut(linked)
    me = F.struct("conv_id", "turn")
    up = cut(linked.select(
        me.alias("me"),
        F.when(F.col("parent_turn").isNotNull(), F.struct(F.col("parent_conv").alias("conv_id"), F.col("parent_turn").alias("turn"))).alias("up"),
        F.when(F.col("parent_turn").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
    ))
    up = up.select("me", F.coalesce("up", "me").alias("up"), "depth")
    pending, settled = up.filter("me <> up"), up.filter("me = up")  # what has reached its root is only looked up from then on
    for _ in range(max_rounds):
        above = settled.union(pending).select(F.col("me").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        step = cut(pending.join(above, "up").select("me", "up2", "depth", "more"))
        moved = step.select("me", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), "more")
        pending, settled = moved.filter("more > 0").drop("more"), settled.union(moved.filter("more = 0").drop("more"))
        if pending.isEmpty():
            break
    else:
        raise RuntimeError(f"threads not settled in {max_rounds} rounds")
    up = settled.union(pending)
    roots = up.select(F.col("me.conv_id").alias("conv_id"), F.col("me.turn").alias("turn"), F.col("up.conv_id").alias("thread_conv"), F.col("up.turn").alias("thread_turn"), "depth")
    return linked.join(in_reply_order(roots), ["conv_id", "turn"])


def in_reply_order(roots: DataFrame) -> DataFrame:
    """With ``position``: the place in its conversation, by thread, depth and turn."""
    order = ["conv_id", "thread_conv", "thread_turn", "depth", "turn"]
    ranged = cut(roots.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")  # a row a partition
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_p").orderBy(*order))).join(F.broadcast(base), "_p")
    placed = placed.withColumn("_at", F.col("_base") + F.col("_at"))
    first = placed.groupBy("conv_id").agg(F.min("_at").alias("_first"))
    return placed.join(first, "conv_id").select(*roots.columns, (F.col("_at") - F.col("_first")).alias("position"))


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
