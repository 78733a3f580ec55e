"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of ``cells`` cells; a row's id hashes to a cell and the row belongs to the
first point clockwise. A shard takes rows up to its capacity. Rows that overflow a full shard go on clockwise to the next
shard with room. Capacities are ``floor`` or ``ceil`` of the even share (times ``1 + slack``), so with ``slack=0`` the
row counts of any two shards differ by one at most, whatever the hash does.

Only the histogram of rows per cell (at most ``cells`` numbers) reaches the driver; the walk around the ring is worked out
on it and comes back as a list of ``(cell, from rank, to rank, shard, first slot)`` segments of bounded length. Rows find
their segment by their rank within their cell, which is the one shuffle. All of it is DataFrame expressions.

Defined cases: a null id hashes by the text instead; a null text has size 1 and CRC 0; repeated rows are placed one by
one; ties within a cell go by key, id, CRC and size, and rows that are equal in all of them may swap places; very long texts are
one row like others; an empty table gives an empty result; columns of the input named like a result column are kept as
``_in_<name>``, all others stay as they are.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import documents, text_of

CELLS, VNODES, SHARDS = 16384, 64, 16


def ring_points(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise. A shard's points depend on its number alone."""
    at = lambda s, v: int.from_bytes(hashlib.md5(f"shard:{s}:{v}".encode()).digest()[:8], "big") % cells
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    low, more = divmod(rows, shards)
    return [int((low + (s < more)) * (1 + slack)) + (1 if slack else 0) for s in range(shards)]


def ring_plan(counts: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = CELLS, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, first rank, last rank, shard, slot of the first) that place every row. Ranks start at 1.

    In each round every cell with rows left offers them to its next shard clockwise; a shard accepts in the ring order of
    the cells until it is full. A shard that has turned rows away is full for good, so a row moves past full shards only.
    """
    points = ring_points(shards, vnodes, cells)
    places = [c for c, _ in points]
    room = capacities(sum(counts.values()), shards, slack)
    filled = [0] * shards
    out = []
    waiting = [(cell, 1, n, bisect_left(places, cell) % len(points)) for cell, n in sorted(counts.items()) if n]
    while waiting:
        left = []
        for cell, first, n, at in waiting:
            shard = points[at][1]
            if take := min(n, room[shard]):
                out.append((cell, first, first + take - 1, shard, filled[shard]))
                room[shard] -= take
                filled[shard] += take
            if n > take:
                step = 1
                while points[(at + step) % len(points)][1] == shard and step < len(points):
                    step += 1
                left.append((cell, first + take, n - take, (at + step) % len(points)))
        waiting = left
    return out


def _segments(spark: SparkSession, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The plan as a one-literal relation, so that no Python runs on executors."""
    kind = "array<struct<_cell:int,_from:bigint,_to:bigint,shard:int,_slot:bigint>>"
    rows = json.dumps([dict(zip(("_cell", "_from", "_to", "shard", "_slot"), x, strict=True)) for x in plan])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), kind)))


def shard_ring(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES, cells: int = CELLS, slack: float = 0.0) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    key = F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), text_of(text_col)))
    histogram = docs.select(F.pmod(key, F.lit(cells)).cast("int").alias("cell")).groupBy("cell").count()
    plan = ring_plan({r["cell"]: r["count"] for r in histogram.collect()}, shards, vnodes, cells, slack)  # at most `cells` rows
    crc = F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long")
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), (F.octet_length(text_of(text_col)) + 1).cast("long").alias("size"), crc.alias("text_crc32"), key.alias("_key"))
    keyed = keyed.withColumn("_cell", F.pmod("_key", F.lit(cells)).cast("int"))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_key", "_id", "text_crc32", "size")).cast("long"))
    placed = ranked.join(F.broadcast(_segments(spark, plan)), ["_cell"]).filter("_rank between _from and _to")
    made = {"size", "text_crc32", "shard", "slot"}
    kept = [F.col("_row")[c].alias(f"_in_{c}" if c.lower() in made else c) for c in docs.columns]
    return placed.select(*kept, "size", "text_crc32", "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"))


def op3_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_ring(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
