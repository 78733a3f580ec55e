"""User profiles and cosine rankings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.interactions import dense_ids
from shelfmark.operators.sparse import entries, times
from shelfmark.plans.lineage import cut

TOP_N = 10
#: Bytes of the vectors of a block; items up to so many are sent along with one pass over the users.
BLOCK_BYTES = 64 << 20
#: Bytes of scores that a task has at a time, whatever the number of items.
SCORE_BYTES = 8 << 20
#: Entries of a group of sparse rows, and users whose profiles a task spreads out at a time.
GROUP_ENTRIES, STRIP = 8 << 20, 64


def dense_profiles(train: DataFrame, vectors: DataFrame, cold_below: int = 1) -> DataFrame:
    """(user_id, profile): rating-weighted mean of item vectors; users with fewer rows than ``cold_below`` get the centroid."""
    first = vectors.first()
    if first is None:
        return train.select("user_id", F.array().cast("array<double>").alias("profile")).limit(0)
    width = len(first["vec"])
    rows = train.filter("user_id is not null and rating is not null").join(vectors.filter("vec is not null"), "item_id").select("user_id", F.col("rating").cast("double").alias("rating"), "vec")
    # Partial sums are made where the rows lie: a record a user and task is shuffled, not one a dimension.
    added = [F.sum(F.col("rating") * F.get("vec", F.lit(j))).alias(f"_{j}") for j in range(width)]
    sums = rows.groupBy("user_id").agg(*added, F.sum("rating").alias("s"), F.count("*").alias("n")).withColumn("sums", F.array(*[F.col(f"_{j}") for j in range(width)])).select("user_id", "sums", "s", "n")
    divisor = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    profile = F.transform("sums", lambda x: x / divisor)
    if cold_below > 1:
        centre = vectors.agg(F.array(*[F.avg(F.get("vec", F.lit(j))) for j in range(width)]).alias("centre"))  # one row
        sums = sums.join(F.broadcast(centre))
        profile = F.when(F.col("n") < cold_below, F.col("centre")).otherwise(profile)
    return sums.select("user_id", profile.alias("profile"))


def packed_cells(weights: DataFrame, key: str) -> DataFrame:
    """(key, features, weights): a sparse row as two arrays."""
    cells = weights.groupBy(key).agg(F.collect_list(F.struct("feature", "weight")).alias("cells"))  # a row's own entries
    return cells.select(key, F.col("cells.feature").alias("features"), F.col("cells.weight").alias("weights"))


def sparse_profiles(train: DataFrame, weights: DataFrame) -> DataFrame:
    """(user_id, feature, weight): the same over sparse items; the divisor counts all of a user's items that have a vector.

    Items travel to their users packed, a record a train row; features are told apart and added up where the user's rows meet.
    """
    rows = train.select("user_id", "item_id", "rating").join(packed_cells(weights, "item_id"), "item_id").repartition("user_id")
    # The sizes keep both arrays in the second plan, so that it reads the same shuffled rows.
    total = rows.filter((F.size("features") > 0) & (F.size("weights") > 0)).groupBy("user_id").agg(F.sum("rating").alias("s"))
    cells = rows.filter((F.size("features") > 0) & (F.size("weights") > 0)).select("user_id", "rating", F.inline(F.arrays_zip("features", "weights")))
    sums = cells.groupBy("user_id", F.col("features").alias("feature")).agg(F.sum(F.col("rating") * F.col("weights")).alias("x"))
    return sums.join(total, "user_id").select("user_id", "feature", (F.col("x") / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("weight"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ranked(scores: DataFrame, seen: DataFrame | None, n: int = TOP_N) -> DataFrame:
    """The n best items a user, by score rounded to 6 places, then by id; those in ``seen`` (none if None) are left out."""
    unseen = scores if seen is None else scores.join(seen.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    placed = unseen.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order).cast("long"))
    return placed.filter(F.col("rank") <= n)


def cosine(a: str, b: str) -> Column:
    """Cosine of two columns; 0 where one of them is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(dot(a, b) / F.when(norm != 0, norm), F.lit(0.0))


def _matrix(rows: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    """A copy of a column of arrays of one width as a matrix; there is a row at least."""
    lists = rows.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.array(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows.num_rows, -1)


class Items:
    """A block of items, in the order of their ids, that users are scored against."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids)  # so that the first of equal scores has the smallest id
        self.ids, self.x = ids[order], vectors[order].astype(np.float64, copy=False)
        for i in range(0, len(self.x), 4096):
            _to_unit_length(self.x[i : i + 4096])

    def best(self, users: pa.RecordBatch | pa.Table, n: int) -> pa.Table:
        """(user_id, item_id, score): the n + k items of highest cosine to each (user_id, profile, k), by partial selection.

        Scores are made for as many users at a time as ``SCORE_BYTES`` allow, and rounded only near the last one wanted or above.
        """
        u = _to_unit_length(_matrix(users, "profile"))
        wanted = np.minimum(users.column("k").to_numpy() + n, len(self.ids)).astype(int)
        picks, scores, step = [], [], max(1, SCORE_BYTES // (8 * len(self.ids)))
        for start in range(0, len(u), step):
            for row, w in zip(u[start : start + step] @ self.x.T, wanted[start : start + step], strict=True):
                pick, score = _highest(row, w)
                picks.append(pick)
                scores.append(score)
        whose, what = np.repeat(np.arange(len(picks)), [len(p) for p in picks]), np.concatenate(picks)
        who = users.column("user_id").take(pa.array(whose))
        return pa.table({"user_id": who, "item_id": pa.array(self.ids[what]), "score": pa.array(np.concatenate(scores))})


def _highest(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values, rounded to 6 places, of the n highest values; the first of equal ones come first. Only what may count is rounded."""
    least = np.partition(row, len(row) - n)[len(row) - n]
    near = np.flatnonzero(row >= least - 1.1e-6)  # all that may round to the same or more
    rounded = np.round(row[near], 6)
    first = np.argsort(-rounded, kind="stable")[:n]
    return near[first], rounded[first]


def _to_unit_length(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in place; a row that has no length becomes 0, so that its cosines do."""
    norms = np.linalg.norm(x, axis=1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        x /= norms
    return np.nan_to_num(x, copy=False, posinf=0, neginf=0)


def _with_seen(profiles: DataFrame, seen: DataFrame | None) -> DataFrame:
    """(user_id, profile, k): k is the number of items that the user has seen."""
    none = F.lit(0).cast("long")
    if seen is None:
        return profiles.select("user_id", "profile", none.alias("k"))
    counts = seen.groupBy("user_id").agg(F.countDistinct("item_id").alias("k"))
    return profiles.join(counts, "user_id", "left").select("user_id", "profile", F.coalesce("k", none).alias("k"))


def _scored(profiles: DataFrame) -> str:
    return f"user_id {profiles.schema['user_id'].dataType.simpleString()}, item_id long, score double"


def top_dense(profiles: DataFrame, vectors: DataFrame, seen: DataFrame | None, n: int = TOP_N, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Top n by cosine in one pass over the users, with all items sent along; refused if they take more than ``most_bytes``."""
    if item_bytes(vectors) > most_bytes:
        raise ValueError(f"items take more than {most_bytes} bytes")
    rows = vectors.collect()  # bounded by the check
    if not rows:
        return profiles.select("user_id", F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    items = Items(np.array([r["item_id"] for r in rows], np.int64), np.array([r["vec"] for r in rows]))

    def each(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                yield from items.best(batch.slice(start, 256), n).to_batches()

    return ranked(_with_seen(profiles, seen).mapInArrow(each, _scored(profiles)), seen, n)


def item_bytes(vectors: DataFrame) -> int:
    first = vectors.first()
    return vectors.count() * len(first["vec"]) * 8 if first else 0


def score_bytes(n_users: int, n_items: int, each: int = 8) -> int:
    """Bytes of a full matrix of scores."""
    return n_users * n_items * each


def frame_bytes(df: DataFrame, sample: int = 1000) -> int:
    """An estimate of a frame's bytes in memory: the mean size of some rows as JSON times the number of rows."""
    some = df.limit(sample).agg(F.avg(F.length(F.to_json(F.struct(*df.columns)))).alias("each")).first()["each"]
    return int((some or 0) * df.count())


def top(profiles: DataFrame, vectors: DataFrame, seen: DataFrame | None, n: int = TOP_N, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``top_dense`` where the items fit, else ``top_block``; both give the same rows."""
    return (top_dense if item_bytes(vectors) <= most_bytes else top_block)(profiles, vectors, seen, n)


def top_block(profiles: DataFrame, vectors: DataFrame, seen: DataFrame | None, n: int = TOP_N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Top n by cosine in blocks: users and items are dealt into blocks, each pair of blocks is scored by one task, then one ranking.

    A task holds one block of items of about ``block_bytes`` at most, and one of users of a quarter of that; it keeps a user's best
    n + (number of seen items), by partial selection, so leaving out seen items afterwards is exact. Users and items are
    repeated once a block of the other side; other scores don't leave their task. The driver holds counts only.
    """
    size = item_bytes(vectors)
    if not size:
        return profiles.select("user_id", F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    users = cut(_with_seen(profiles, seen))
    n_items = -(-size // block_bytes)
    # Enough blocks of users to keep a cluster busy where the items make one block only.
    n_users = max(-(-users.count() * size // max(1, vectors.count()) // max(1, block_bytes // 4)), min(users.rdd.getNumPartitions(), 1000))
    each = lambda b: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b - 1).cast("long")))
    left = users.withColumn("ub", F.pmod(F.xxhash64("user_id"), F.lit(n_users)).cast("long")).select("*", each(n_items).alias("ib"))
    right = vectors.select("item_id", "vec", F.pmod(F.xxhash64("item_id"), F.lit(n_items)).cast("long").alias("ib")).select("*", each(n_users).alias("ub"))

    def score(people: pa.Table, items: pa.Table) -> pa.Table:
        parts = []
        if items.num_rows:
            block = Items(items.column("item_id").to_numpy(), _matrix(items, "vec"))
            parts = [block.best(people.slice(i, 256), n) for i in range(0, people.num_rows, 256)]
        empty = pa.table({"user_id": people.column("user_id").slice(0, 0), "item_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *parts])

    found = left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib")).applyInArrow(score, _scored(profiles))
    return ranked(found, seen, n)


def numbered(weights: DataFrame) -> DataFrame:
    """The same with features as numbers, which travel and compare faster than text."""
    ids = dense_ids(weights, "feature", "idx").select("feature", F.col("idx").cast("int").alias("idx"))
    return weights.join(ids, "feature").select("item_id", F.col("idx").alias("feature"), "weight")


def _in_groups(weights: DataFrame, key: str, group: str, most: int) -> tuple[DataFrame, int]:
    """(key, idx, w, norm, group) and the number of groups: packed rows in groups of about ``most`` entries."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")
    cells = weights.groupBy(key).agg(F.collect_list(F.struct("feature", "weight")).alias("cells"), length)  # a row's own entries
    rows = cut(cells.select(key, F.col("cells.feature").alias("idx"), F.col("cells.weight").alias("w"), "norm"))
    n = max(1, -(-(rows.agg(F.sum(F.size("idx"))).first()[0] or 0) // most))
    return rows.withColumn(group, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def top_sparse(profiles: DataFrame, weights: DataFrame, seen: DataFrame | None, n: int = TOP_N, most: int = GROUP_ENTRIES) -> DataFrame:
    """Top n by cosine over sparse vectors; only pairs that share a feature are scored.

    Items and users are dealt into groups of about ``most`` entries, and each pair of groups is scored by one task, ``STRIP`` users at a
    time. As in ``top_block`` a task keeps a user's best n + (number of seen items), so other scores never leave it. The work grows
    with users times entries of items; memory doesn't, and what is shuffled is each side once a group of the other.
    """
    if profiles.schema["feature"].dataType.simpleString() != "int":
        ids = cut(dense_ids(weights.select("feature").union(profiles.select("feature")), "feature", "idx")).select("feature", F.col("idx").cast("int").alias("idx"))
        with_ids = lambda t, key: t.join(ids, "feature").select(key, F.col("idx").alias("feature"), "weight")
        profiles, weights = with_ids(profiles, "user_id"), with_ids(weights, "item_id")
    items, n_items = _in_groups(weights, "item_id", "ig", most)
    users, n_users = _in_groups(profiles, "user_id", "ug", most)
    if seen is None:
        users = users.withColumn("k", F.lit(0).cast("long"))
    else:
        counts = seen.groupBy("user_id").agg(F.countDistinct("item_id").alias("k"))
        users = users.join(counts, "user_id", "left").withColumn("k", F.coalesce("k", F.lit(0).cast("long")))
    each = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    left, right = users.select("*", each(n_items).alias("ig")), items.select("*", each(n_users).alias("ug"))

    def score(people: pa.Table, things: pa.Table) -> pa.Table:
        found = [pa.table({"user_id": people.column("user_id").slice(0, 0), "item_id": things.column("item_id").slice(0, 0), "score": pa.array([], pa.float64())})]
        if not people.num_rows or not things.num_rows:
            return found[0]
        things = things.take(pc.sort_indices(things.column("item_id")))  # so that the first of equal scores has the smallest id
        idx, w, starts = entries(things)
        known, at = np.unique(idx, return_inverse=True)
        norms = things.column("norm").to_numpy()
        for a in range(0, people.num_rows, STRIP):
            some = people.slice(a, STRIP)
            mine, v, heads = entries(some)
            place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            there = known[place] == mine
            whose = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(mine))))
            spread = np.zeros((len(known), some.num_rows))
            spread[place[there], whose[there]] = v[there]
            dots = times(at, w, starts, spread)
            if (w > 0).all() and (v > 0).all():
                met = dots > 0
            else:
                spread[place[there], whose[there]] = 1
                met = times(at, np.ones_like(w), starts, spread) > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                cos = np.nan_to_num(dots / np.outer(norms, some.column("norm").to_numpy()), posinf=0, neginf=0)
            cos = np.where(met, cos, -np.inf).T
            for i, (row, k) in enumerate(zip(np.ascontiguousarray(cos), some.column("k").to_pylist(), strict=True)):
                if count := min(int(met[:, i].sum()), n + k):
                    pick, value = _highest(row, count)
                    found.append(pa.table({"user_id": some.column("user_id").take(pa.array(np.full(count, i))), "item_id": things.column("item_id").take(pa.array(pick)), "score": pa.array(value)}))
        return pa.concat_tables(found)

    user, item = (t.schema[c].dataType.simpleString() for t, c in ((profiles, "user_id"), (weights, "item_id")))
    both = left.groupBy("ug", "ig").cogroup(right.groupBy("ug", "ig")).applyInArrow(score, f"user_id {user}, item_id {item}, score double")
    return ranked(both, seen, n)


def trade_off(table: DataFrame, least: float = 30.0, gain: float = 2.0) -> DataFrame:
    """(n_components, variance_pct) with the gain to the next size and the recommended size: the first over ``least`` whose next
    gain is below ``gain``, else the one with the most variance."""
    nxt = F.lead("variance_pct").over(Window.orderBy("n_components"))  # a row a size
    gains = table.withColumn("next_gain", nxt - F.col("variance_pct"))
    good = F.min(F.when((F.col("variance_pct") > least) & (F.col("next_gain") < gain), F.col("n_components")))
    pick = gains.agg(F.coalesce(good, F.max_by("n_components", "variance_pct")).alias("recommended"))
    return gains.join(F.broadcast(pick)).select("n_components", "variance_pct", F.round("next_gain", 4).alias("next_gain"), (F.col("n_components") == F.col("recommended")).alias("recommended"))
