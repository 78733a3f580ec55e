"""Exact top-k inner products by the three-phase uniform threshold (Cao and Wang, "TPUT", 2004).

A vector's components are cut into ``lists`` blocks; a candidate has one partial score a block, and its score is their sum.

1. Every partition gathers, for each query, its k best candidates of each list and their whole scores, and reports the k
   highest of those and each list's maximum. The k-th highest over all partitions is a safe cutoff: k candidates reach it.
2. The cutoff is broadcast. A candidate that reaches it has a partial score of cutoff / lists or more in some list. Each
   partition collects those entries and drops the ones whose upper bound (their own partial scores where those are over the
   uniform threshold, the threshold or the list's maximum where they aren't) stays below the cutoff.
3. What remains is scored exactly; scores at or over the cutoff go on to the final ranking, k of a partition at most.

Queries come in waves of at most about ``wave`` vectors, so what the driver and each broadcast hold is bounded; each wave
scans all candidates in blocks. Scores are sums of integers; they are computed in float32 or float64 while these are
exact for the values at hand, in Python's integers beyond.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part; neither do null ids. Missing
components of shorter vectors count as 0. A query's own id is no candidate; other repeated ids each take a rank, and each row of a
repeated query id gets a list of its own. Ties go to the smaller id. Very wide vectors only cost time; other columns aren't looked at. Fewer candidates than k are all returned. Empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.plans.lineage import cut

K, LISTS, SCALE, WAVE, BLOCK = 20, 4, 64, 8192, 1024


def taking_part(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that take part."""
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)


def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of ``width`` doubles, short vectors padded with 0."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    mask = np.arange(width)[None] < sizes[:, None]
    out[mask] = flat
    return out


class Wave:
    """The queries of one wave, and how to score candidates against them list by list."""

    def __init__(self, ids: list[int], vectors: np.ndarray, largest: float, k: int, lists: int, scale: int, base: int = 0):
        self.base, self.ids, self.k, self.scale, self.width = base, np.array(ids, np.int64), k, scale, vectors.shape[1]
        self.parts = [p for p in np.array_split(np.arange(self.width), lists) if len(p)] or [np.arange(0)]
        bound = largest * largest * max(1, self.width)
        self.kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
        self.vectors = self._typed(vectors)

    def _typed(self, x: np.ndarray) -> np.ndarray:
        return np.vectorize(int, otypes=[object])(x) if self.kind is object and x.size else x.astype(self.kind)

    def blocks(self, batches):
        """(ids, [partial scores (queries, candidates) of each list], whether a candidate is the query itself)"""
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = self._typed(_matrix(batch.column(1), self.width, self.scale))
            for i in range(0, len(ids), BLOCK):
                some = x[i : i + BLOCK]
                yield ids[i : i + BLOCK], [self.vectors[:, p] @ some[:, p].T for p in self.parts], self.ids[:, None] == ids[None, i : i + BLOCK]

    def gather(self, batches):
        """Phase 1: a row a query."""
        low = -np.inf
        n, k = len(self.ids), self.k
        best, most = np.full((n, k), low), np.full((n, len(self.parts)), low)
        for ids, partial, own in self.blocks(batches):
            partial = [np.where(own, low, s).astype(np.float64 if self.kind is object else self.kind) for s in partial]
            total = np.sum(partial, axis=0)
            seen = np.zeros(total.shape, bool)
            for j, s in enumerate(partial):
                most[:, j] = np.maximum(most[:, j], s.max(1))
                top = np.argpartition(s, -k, axis=1)[:, -k:] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                np.put_along_axis(seen, top, True, axis=1)
            gathered = np.where(seen, total, low)
            if gathered.shape[1] > k:
                gathered = np.partition(gathered, -k, axis=1)[:, -k:]
            best = np.partition(np.concatenate([best, gathered], 1), -k, axis=1)[:, -k:]
        if np.isfinite(most).any():
            kept = [[float(v) for v in row if np.isfinite(v)] for row in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(kept, pa.list_(pa.float64())), pa.array(most.tolist(), pa.list_(pa.float64()))], names=["q", "best", "most"])

    def collect(self, batches, cutoff: np.ndarray, most: np.ndarray):
        """Phases 2 and 3: the candidates of each query that reach its cutoff, k of this partition at most."""
        uniform = cutoff / len(self.parts)
        kept = [np.zeros((0, 3), object)]
        for ids, partial, own in self.blocks(batches):
            entry, upper = ~own & False, np.zeros(own.shape, np.float64 if self.kind is object else self.kind)
            for j, s in enumerate(partial):
                over = (s >= uniform[:, None]).astype(bool)
                entry |= over
                upper += np.where(over, s, np.minimum(uniform, most[:, j])[:, None]).astype(upper.dtype)
            slack = np.abs(cutoff) * 1e-6 + 1  # bounds may be rounded
            q, c = np.nonzero(entry & ~own & (upper >= np.nan_to_num(cutoff - slack, neginf=-np.inf)[:, None]))
            score = np.sum([s[q, c] for s in partial], axis=0) if len(q) else np.zeros(0)
            hit = np.asarray(score >= cutoff[q], bool)
            rows = np.empty((int(hit.sum()), 3), object)
            rows[:, 0], rows[:, 1], rows[:, 2] = q[hit].tolist(), ids[c[hit]].tolist(), [max(-(2**63), min(2**63 - 1, int(v))) for v in np.asarray(score)[hit]]
            kept.append(rows)
            if sum(map(len, kept)) > 2_000_000:
                kept = [self._least(np.concatenate(kept))]
        rows = self._least(np.concatenate(kept))
        columns = [[self.base + i for i in rows[:, 0]], [int(self.ids[i]) for i in rows[:, 0]], rows[:, 1].tolist(), rows[:, 2].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query", "query_id", "id", "score"])

    def _least(self, rows: np.ndarray) -> np.ndarray:
        """The k best rows of each query."""
        if not len(rows):
            return rows
        q, v, s = (rows[:, i].astype(np.int64) for i in range(3))
        order = np.lexsort((v, -s, q))
        q = q[order]
        first = np.concatenate(([True], q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        return rows[order[rank < self.k]]


def _tput(candidates: DataFrame, wave: Wave) -> DataFrame:
    def first(batches):
        yield from wave.gather(batches)

    lists = candidates.mapInArrow(first, "q int, best array<double>, most array<double>")
    lists = cut(lists)
    ranked = lists.select("q", F.explode("best").alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"))))
    kth = {r["q"]: r["s"] for r in ranked.filter(F.col("r") == wave.k).select("q", "s").collect()}  # a row a query of the wave
    tops = {(r["q"], r["j"]): r["m"] for r in lists.select("q", F.posexplode("most").alias("j", "m")).groupBy("q", "j").agg(F.max("m").alias("m")).collect()}
    n = len(wave.ids)
    cutoff = np.array([kth.get(q, -np.inf) for q in range(n)])
    most = np.array([[tops.get((q, j), np.inf) for j in range(len(wave.parts))] for q in range(n)])

    def rest(batches):
        yield from wave.collect(batches, cutoff, most)

    found = candidates.mapInArrow(rest, "query long, query_id long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wave.k)


def top_k(candidates: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, lists: int = LISTS, scale: int = SCALE, wave: int = WAVE) -> DataFrame:
    """(query_id, rank, id, score): the k candidates with the highest integer inner product for every query."""
    spark = candidates.sparkSession
    c, q = taking_part(candidates, id_col, vector_col), taking_part(queries, id_col, vector_col)
    stats = lambda t: t.agg(F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))), F.count("*")).first()
    (width, most, rows), (qwidth, qmost, asked) = stats(c), stats(q)
    if not rows or not asked:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    width, largest = max(1, width, qwidth), scale * max(most, qmost) + 1
    waves, parts, base = -(-asked // wave), [], 0
    for w in range(waves):
        some = q.filter(F.pmod(F.xxhash64("id"), F.lit(waves)) == w).orderBy("id").collect()  # about `wave` rows
        if some:
            x = np.zeros((len(some), width))
            for i, r in enumerate(some):
                x[i, : len(r["x"])] = np.floor(np.array(r["x"], np.float64) * scale)
            parts.append(_tput(c, Wave([r["id"] for r in some], x, largest, k, lists, scale, base)).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))
            base += len(some)
    return reduce(DataFrame.union, parts)


def op4_topk_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(table, table.filter("vec_id % 20 = 0")).withColumnRenamed("id", "vec_id")


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
