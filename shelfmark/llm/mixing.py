"""Mixing sources to target weights by capped water-filling.

Sources in code-point order (null last) take the weights of a cycle in turn. A source's target is its weight's part of the
total size, clamped at ``max_epochs`` times the source's own size; what the clamp leaves over is shared again by weight
until no source is above. That fixed point has a closed form: order the sources by cap / weight, then the water level is
(total - caps of the sources before) / (weights of the others) at the first source whose cap is above it.

A source's documents are then taken whole ``floor(target / size)`` times, and once more those that come first in a seeded
order for as long as they fit whole into the fractional part of the target; one document more, the one whose size is
nearest to what is left over, evens out the rest. The cut is found without ordering a source in one task: sizes are summed
by (source, ``DIGITS`` leading digits of the order key), the sums are accumulated over at most 2 * 16 ** (DIGITS - 1) rows a
source, and only the bucket that holds the cut is ordered by row. Documents that are over ``SMALL_PART`` of a partial epoch
come last in the order, so that a single long one doesn't end it far from its target.

Defined cases: a null text has size 0; documents of size 0 are taken like others of their place; a source of size 0 has
target 0; a null source is a source; repeated rows share a fate; an empty table gives an empty result; very long texts come last;
columns of the input named like a result column are kept as ``_in_<name>``, all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, documents, text_of
from shelfmark.plans.lineage import cut

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, 42
#: Leading hexadecimal digits of the order key that make a bucket.
DIGITS = 4
#: Documents above this part of a source's partial epoch come last in its order.
SMALL_PART = 0.02
#: Above so many sources their plan is joined instead of broadcast (a row takes about 200 bytes).
BROADCAST_SOURCES = 50_000


def words(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def order_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def source_key(column: str = "source") -> Column:
    """A non-null key in the order of the sources: code points, null last."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column)))


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(_source, source_size) -> with weight, target and epochs. One row a source, so one small ordered window."""
    by_name = Window.orderBy("_source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("_cap", F.col("source_size").cast("double") * max_epochs)
    by_ratio, whole = Window.orderBy(F.col("_cap") / F.col("weight"), "_source"), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "*",
        F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_caps"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("_used"),
        F.sum("source_size").over(whole).cast("double").alias("_total"),
        F.sum("weight").over(whole).alias("_weights"),
    )
    levels = levels.withColumn("_level", (F.col("_total") - F.col("_caps")) / (F.col("_weights") - F.col("_used")))
    # Past the first source that the level leaves uncapped the levels only fall, so the first is the largest.
    level = F.max(F.when(F.col("_cap") > F.col("weight") * F.col("_level"), F.col("_level"))).over(whole)
    out = levels.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("weight") * level, F.col("_cap"))))
    return out.select("_source", "source_size", "weight", "target", F.coalesce(F.floor(F.col("target") / F.expr("nullif(source_size, 0)")), F.lit(0)).cast("long").alias("epochs"))


def placed_key(size: Column) -> Column:
    """The order key with a leading 0 for documents that are a small part of their source's partial epoch, 1 for others."""
    return F.concat(F.when(size <= F.lit(SMALL_PART) * F.col("_part"), "0").otherwise("1"), F.col("_key"))


def mixture_plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """The documents with their places in the order, and a row for each source: its target, whole epochs and, of the further,
    partial one, the last whole bucket and the last (order key, id)."""
    plan = cut(water_fill(slim.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, max_epochs))
    plan = plan.withColumn("_part", F.col("target") - F.col("epochs") * F.col("source_size"))
    slim = slim.join(_sized(plan.select("_source", "_part")), "_source").withColumn("_key", placed_key(F.col("size"))).drop("_part")
    buckets = cut(slim.groupBy("_source", F.substring("_key", 1, DIGITS).alias("_bucket")).agg(F.sum("size").alias("_sum")))
    w = Window.partitionBy("_source").orderBy("_bucket")
    upto = buckets.withColumn("_upto", F.sum("_sum").over(w)).withColumn("_before", F.col("_upto") - F.col("_sum")).join(plan.select("_source", "_part"), "_source")
    near = cut(upto.filter("_before <= _part and _upto > _part and _part > 0").select("_source", "_bucket", "_before", "_part"))
    rows = slim.withColumn("_bucket", F.substring("_key", 1, DIGITS)).join(near, ["_source", "_bucket"])
    inside = F.sum("size").over(Window.partitionBy("_source", "_bucket").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("_at", F.col("_before") + inside).filter("_at <= _part")
    last = kept.groupBy("_source").agg(F.max(F.struct("_key", "_id")).alias("_last"), F.max("_at").alias("_in_bucket"))
    full = upto.filter("_upto <= _part and _part > 0").groupBy("_source").agg(F.max("_bucket").alias("_full"), F.max("_upto").alias("_in_full"))
    plan = plan.join(last, "_source", "left").join(full, "_source", "left")
    return slim, plan.withColumn("_left", F.col("_part") - F.greatest(F.coalesce("_in_bucket", F.lit(0)), F.coalesce("_in_full", F.lit(0)))).drop("_in_bucket", "_in_full")


def _ahead() -> Column:
    """Whether a document lies before the cut of its source."""
    return F.coalesce(F.substring("_key", 1, DIGITS) <= F.col("_full"), F.lit(False)) | F.coalesce(F.struct("_key", "_id") <= F.col("_last"), F.lit(False))


def _sized(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with _source_size, _target and _repeats (how often the mix takes the document)."""
    slim = cut(docs.select(source_key(source_col).alias("_source"), F.col(id_col).alias("_id"), words(text_col).alias("size"), order_key(id_col, seed).alias("_key")))
    slim, plan = mixture_plan(slim, weights, max_epochs)
    plan = _sized(cut(plan.withColumnsRenamed({"source_size": "_source_size", "target": "_target", "epochs": "_epochs"})))
    others = slim.join(plan, "_source").filter((F.col("_part") > 0) & ~_ahead())
    fit = F.min(F.struct(F.abs(F.col("size") - F.col("_left")).alias("miss"), "_key", "_id"))
    picks = others.groupBy("_source").agg(fit.alias("_fit"), F.first("_left").alias("_left")).filter("_fit.miss < _left").select("_source", F.struct("_fit._key", "_fit._id").alias("_pick"))
    plan = _sized(cut(plan.join(picks, "_source", "left")))
    rows = docs.select(F.struct("*").alias("_row"), source_key(source_col).alias("_source"), order_key(id_col, seed).alias("_key"), F.col(id_col).alias("_id"), words(text_col).alias("_size"))
    out = rows.join(plan, "_source").withColumn("_key", placed_key(F.col("_size")))
    more = _ahead() | F.coalesce(F.struct("_key", "_id") == F.col("_pick"), F.lit(False))
    repeats = F.least(F.col("_epochs") + F.when(more, 1).otherwise(0), F.lit(max_epochs)).cast("long")
    taken = {c.lower() for c in ("_source_size", "_target", "_repeats")}
    kept = [F.col("_row")[c].alias(f"_in_{c}" if c.lower() in taken else c) for c in docs.columns]
    return out.select(*kept, "_source_size", "_target", repeats.alias("_repeats"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("from"), F.col(text_col).alias("text"))
    mixed = mix_sources(rows, id_col="id", source_col="from", text_col="text", **options).filter("_repeats > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("_repeats").cast("int")))).select("row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = mix_sources(docs)
    return out.select("doc_id", words().alias("size"), F.col("_source_size").cast("long").alias("source_size"), F.col("_target").alias("target"), (words() * F.col("_repeats")).alias("taken"))


#: The same mix in DuckDB: the water level by closed form, the partial epoch by a running sum in the order of the key.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT sk, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY sk) AS r FROM d GROUP BY sk),
w AS (SELECT sk, source_size, CASE (r - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS wt, source_size::DOUBLE * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER b, 0)) AS lv
      FROM w WINDOW b AS (ORDER BY cap / wt, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT sk, source_size, least(cap, coalesce(wt * max(CASE WHEN cap > wt * lv THEN lv END) OVER (), cap)) AS target FROM l),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t),
p0 AS (SELECT d.doc_id, d.sk, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS part, (CASE WHEN d.size <= 0.02::DOUBLE * (e.target - e.epochs * e.source_size) THEN '0' ELSE '1' END) || d.k AS k FROM d JOIN e USING (sk)),
p AS (SELECT *, sum(size) OVER (PARTITION BY sk ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM p0),
q AS (SELECT *, part > 0 AND run <= part AS ahead, part - coalesce(max(CASE WHEN part > 0 AND run <= part THEN run END) OVER (PARTITION BY sk), 0) AS rest FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY sk, ahead ORDER BY abs(size - rest), k, doc_id) = 1 AND NOT ahead AND part > 0 AND abs(size - rest) < rest AS pick FROM q)
SELECT doc_id, size, source_size, target, size * least(epochs + CASE WHEN ahead OR pick THEN 1 ELSE 0 END, 3) AS taken FROM f
"""
