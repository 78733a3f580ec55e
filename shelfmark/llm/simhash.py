"""SimHash near-duplicates by the generalised pigeonhole principle (Qin et al., "GPH", ICDE 2018).

Fingerprints of 64 bits link when they differ in ``distance`` bits or fewer. The bits are dealt into m partitions, the
most correlated ones together; partition i gets a threshold t_i >= -1 with sum(t_i) = distance - m + 1. Any two
fingerprints within ``distance`` are then within t_i on some partition i (t_i = -1: the partition is not looked at).
Thresholds are allocated by dynamic programming over the partitions on costs estimated from all fingerprints: the
signatures to emit, plus the pairs expected to share one (exact collision counts at t = 0, bit disagreement
probabilities beyond). The m with the least cost wins.

Probing: with t_i = 0 a fingerprint emits its bits on the partition; with t_i = r > 0 also every variant with up to
ceil(r / 2) of them flipped, so that any two within t_i share a variant. Fingerprints that share a signature are verified
on all 64 bits. A signature shared by more than ``BUCKET`` fingerprints is not expanded into pairs: its members go to the
exact way for the rest, the radius-ceil(distance / 2) balls of the whole fingerprint. There two fingerprints that share a
variant are within ``distance``, so each links to one of them and no pair is formed at all. (That needs an even distance;
an odd one is refused.) Two members of a signature only differ in bits that are not the same in all its members, so a ball only
flips bits that vary in one of the hot signatures of its centre. The costs know of this bound.

Classes are the connected components over distinct fingerprints; exact copies never meet in a join.

The pipeline's near duplicates (``text_classes``) are texts whose sets of shingles have a least Jaccard similarity. They are searched
by the same means on fingerprints of many words (``wide_links``); what the search connects is then compared exactly.

Defined cases: a null text is the empty text; fewer words than a shingle make one shingle of all of them; no words give
fingerprint 0, linked like any other; repeated rows and null ids belong to the class of their text (a class's id is the
smallest non-null id in it); an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from shelfmark.llm.common import documents
from shelfmark.plans.components import components
from shelfmark.plans.lineage import cut, packed

BITS = 64
SHINGLE, DISTANCE = 3, 2
#: A signature shared by more fingerprints than this is linked without forming pairs.
BUCKET = 32
#: Near duplicates by text: words in a shingle, least similarity, and the probability at most with which two texts at SIMILAR share
#: no signature of their fingerprints.
WORDS, SIMILAR, MISS = 5, 0.8, 2.6e-5
#: Partitions that a word of such a fingerprint may be dealt into, words of it that go along with a signature, and by how many
#: standard deviations a pair at SIMILAR may differ in more of their bits than expected.
PARTITIONS, CHECK, CHECK_DEVIATIONS = range(2, 7), 3, 4.0
#: Texts whose fingerprints tell how bits correlate and collide (this steers costs only), and cost of a signature in pairs compared.
SAMPLE, WIDE_SIGNATURE_COST = 2000, 100.0
#: Signatures (40 bytes each) in a task; more texts than CROWD under one signature go to the exact comparison as one group, unpaired.
TASK_SIGNATURES, CROWD = 500_000, 4096
#: Bits of the sketch by which candidates are sifted before their sets are compared, in words of 64, and by how many standard
#: deviations a pair at SIMILAR may differ in more bits than expected (beyond four: probability 3e-5).
SKETCH, DEVIATIONS = 16, 4.0
#: Ids are broadcast up to so many (16 bytes each in a hash table of longs), joined by a shuffle beyond; rows with a sketch up to so many.
BROADCAST_IDS, BROADCAST_SKETCHES = 1_000_000, 100_000
#: Rows with a sketch (about 400 bytes each) in a partition.
WIDE = 20_000
#: Members of a signature that all its others are compared with in the first round; each further round takes eight times as many, up to
#: a number that Spark still finds without ordering the whole signature in one task (its limit for that is 1000).
HUBS, MOST_HUBS = 1, 1000
#: Cost of a verified pair and of a signature, relative to each other (a signature is shuffled, a pair is not).
PAIR_COST, SIGNATURE_COST = 1.0, 2.0

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def hashes(text: str | None, n: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """XXH64 of each n-word shingle of the text with A-Z lowered, repeats included."""
    found = (text or "").encode().lower().split()
    joined = b" ".join(found)
    if len(found) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, seed)] if found else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def fold_bits(h: np.ndarray) -> int:
    """The fingerprint whose bits are set in over half of ``h``."""
    if not len(h):
        return 0
    planes = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(planes[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def each(batches):
        for batch in batches:
            fps = np.array([fold_bits(hashes(t.as_py(), n)) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(each, "id long, fp long")


def bit_statistics(items: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of items and, for each of their ``width`` fingerprints, how often bits i and j are both set (64 x 64), over all items."""

    def each(batches):
        total, rows = np.zeros((width, BITS, BITS)), 0
        for batch in batches:
            fps = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            rows += len(fps)
            for k in range(width):
                for i in range(0, len(fps), 20_000):
                    x = np.unpackbits(fps[i : i + 20_000, k].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                    total[k] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size + 1), pa.int32()), pa.array([*total.ravel().astype(np.int64).tolist(), rows], pa.int64())], names=["cell", "n"])

    rows = items.select("fps").mapInArrow(each, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4096 numbers a fingerprint
    flat = np.zeros(width * BITS * BITS + 1)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(width, BITS, BITS)


def group_bits(rows: int, together: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into m partitions of near equal size, each grown from its seed by the strongest mean correlation."""
    p = np.diag(together) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for i in range(m):
        want = BITS // m + (i < BITS % m)
        part = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free.remove(part[0])
        while len(part) < want:
            best = max(free, key=lambda b: (corr[b, part].mean(), -b))
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def ball_size(width: int, threshold: int) -> int:
    radius = (threshold + 1) // 2
    size, term = 1, 1
    for r in range(1, radius + 1):
        term = term * (width - r + 1) // r
        size += term
    return size


def expected_cost(rows: int, p: np.ndarray, part: list[int], exact: float, threshold: int) -> float:
    """Cost of the pairs expected to share a signature: as counted at 0, by independent bits of known bias beyond."""
    if threshold < 0:
        return 0.0
    reach = 0 if threshold == 0 else 2 * ((threshold + 1) // 2)
    tail = np.zeros(reach + 1)
    tail[0] = 1.0
    for b in part:
        d = 2 * p[b] * (1 - p[b])
        tail = tail * (1 - d) + np.concatenate(([0.0], tail[:-1])) * d
    return max(exact, PAIR_COST * float(tail.sum()) * rows * (rows - 1) / 2)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (index - 1 into each row of ``costs``) with the given sum and the least total cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(row, start=-1):
                if used + t not in step or cost + c < step[used + t][0]:
                    step[used + t] = (cost + c, [*chosen, t])
        best = step
    return best[total]


def plan_partitions(items: DataFrame, width: int, distance: int, bucket: int = BUCKET) -> list[list[tuple[list[int], int]]]:
    """For each fingerprint of the items, [(bits, threshold)] for the number of partitions with the least estimated cost."""
    rows, together = bit_statistics(items, width)
    options = {(k, m): group_bits(rows, together[k], m) for k in range(width) for m in range(1, distance + 2)}
    probes = [(k, m, i) for (k, m), parts in options.items() for i in range(len(parts)) if m > 1]
    values = F.array(*[F.struct(F.lit(n).alias("n"), _bits(options[k, m][i], F.col("fps")[k]).alias("v")) for n, (k, m, i) in enumerate(probes)])
    size = F.col("count").cast("double")
    hot = size * SIGNATURE_COST * ball_size(BITS, distance)  # beyond a bucket's bound its members emit whole balls
    cost = F.when(size > bucket, hot).otherwise(PAIR_COST * size * (size - 1) / 2)
    counted = items.select(F.inline(values)).groupBy("n", "v").count().groupBy("n").agg(F.sum(cost).alias("cost")).collect() if probes else []
    exact = {probes[r["n"]]: r["cost"] for r in counted}  # a row a partition
    out = []
    for k in range(width):
        p = np.diag(together[k]) / max(rows, 1)
        found = []
        for m in range(1, distance + 2):
            costs = []
            for i, part in enumerate(options[k, m]):
                pairs = [0.0 if m == 1 else expected_cost(rows, p, part, exact.get((k, m, i), 0.0), t) for t in range(-1, distance + 1)]
                costs.append([0.0 if t < 0 else SIGNATURE_COST * rows * ball_size(len(part), t) + pairs[t + 1] for t in range(-1, distance + 1)])
            cost, thresholds = allocate(costs, distance - m + 1)
            found.append((cost, m, thresholds))
        _, m, thresholds = min(found)
        out.append([(part, t) for part, t in zip(options[k, m], thresholds, strict=True) if t >= 0])
    return out


def _mask(part: list[int]) -> int:
    m = sum(1 << b for b in part)
    return m - (1 << BITS) if m >= 1 << (BITS - 1) else m


def _bits(part: list[int], fp):
    return fp.bitwiseAND(F.lit(_mask(part)).cast("long"))


def _ball(part: list[int], radius: int, fp, varying=None):
    """The bits of a partition, and every variant with up to ``radius`` of them (that ``varying`` has, if given) flipped."""
    flips = F.array(*[F.lit(_mask(list(c))).cast("long") for r in range(radius + 1) for c in combinations(part, r)])
    if varying is not None:
        flips = F.filter(flips, lambda x: x.bitwiseAND(F.bitwise_not(varying)) == 0)
    return F.transform(flips, lambda x: _bits(part, fp).bitwiseXOR(x))


def _stars_of_balls(members: DataFrame, radius: int) -> DataFrame:
    """(node, which, fp, varying): links (a, b, d) from each item to the one at the centre of a ball it lies in, or else to the ball's least item.

    ``varying``: the bits that an item may differ in from those it is to be linked with. Two of them have the bits in which
    they differ in both their masks, so they share the variants half way.

    Items that share a variant of the whole fingerprint are within 2 * radius, so every ball is connected, and no pair of
    members is formed.
    """
    # Items of one fingerprint link to the least of them, which alone goes on to the balls.
    same = members.groupBy("which", "fp").agg(F.min("node").alias("to"), F.bit_or("varying").alias("varying"))
    copies = members.join(same, ["which", "fp"]).filter("node <> to").select(*_link("node", "fp", "to", "fp"))
    ones = same.withColumnRenamed("to", "node")
    variants = ones.select("node", "which", "fp", F.explode(_ball(list(range(BITS)), radius, F.col("fp"), F.col("varying"))).alias("v"))
    ball = Window.partitionBy("which", "v")  # at most as many rows as a ball has places, as fingerprints are distinct here
    hub = F.min(F.struct((F.col("fp") != F.col("v")).alias("off"), F.col("node").alias("to"), F.col("fp").alias("to_fp"))).over(ball)
    met = variants.withColumn("hub", hub).select("node", "fp", "hub.to", "hub.to_fp").filter("node <> to")
    return met.select(*_link("node", "fp", "to", "to_fp")).union(copies).distinct()


def _link(a: str, fa: str, b: str, fb: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.bit_count(F.col(fa).bitwiseXOR(F.col(fb))).cast("int").alias("d")]


def links(items: DataFrame, width: int = 1, distance: int = DISTANCE, plan: list[list[tuple[list[int], int]]] | None = None, bucket: int = BUCKET) -> DataFrame:
    """(node, fps) -> links (a, b, d) with a > b and d <= distance on one of the ``width`` fingerprints, whose components are
    those of the relation "the fingerprints differ in ``distance`` bits or fewer". All such pairs are there, except among the
    members of hot signatures, which are linked by stars. ``distance`` is even."""
    if distance % 2:
        raise ValueError("an even distance is needed")
    plan = plan or plan_partitions(items, width, distance, bucket)
    whole = [k for k, parts in enumerate(plan) if len(parts) == 1 and len(parts[0][0]) == BITS]  # one partition: whole balls
    split = [(k, i, part, t) for k, parts in enumerate(plan) if k not in whole for i, (part, t) in enumerate(parts)]
    found = []
    if whole:
        chosen = F.array(*[F.struct(F.lit(k).alias("which"), F.col("fps")[k].alias("fp")) for k in whole])
        found.append(_stars_of_balls(items.select("node", F.inline(chosen)).withColumn("varying", F.lit(-1).cast("long")), distance // 2))
    if split:
        sig = lambda k, i, fp: lambda v: F.struct(F.lit(k).alias("which"), F.lit(i).alias("part"), v.alias("v"), fp.alias("fp"))
        sigs = F.flatten(F.array(*[F.transform(_ball(part, (t + 1) // 2, F.col("fps")[k]), sig(k, i, F.col("fps")[k])) for k, i, part, t in split]))
        signed, key = items.select("node", F.inline(sigs)), ["which", "part", "v"]
        varying = F.bit_or("fp").bitwiseAND(F.bitwise_not(F.bit_and("fp")))
        counts = packed(signed.groupBy(key).agg(F.count("*").alias("n"), varying.alias("varying")).filter("n > 1"))
        shared = signed.join(counts, key)
        groups = shared.filter(F.col("n") <= bucket).groupBy(key).agg(F.collect_list(F.struct("node", "fp")).alias("all"))  # at most `bucket` of them
        near = lambda x: (x["node"] < F.col("one.node")) & (F.bit_count(x["fp"].bitwiseXOR(F.col("one.fp"))) <= distance)
        pairs = groups.select(F.explode("all").alias("one"), "all").select("one", F.explode(F.filter("all", near)).alias("two"))
        found.append(pairs.select(*_link("one.node", "one.fp", "two.node", "two.fp")).distinct())
        if not counts.filter(F.col("n") > bucket).isEmpty():
            hot = shared.filter(F.col("n") > bucket).groupBy("node", "which", "fp").agg(F.bit_or("varying").alias("varying"))
            found.append(_stars_of_balls(packed(hot, 10_000), distance // 2))
    return reduce(DataFrame.union, found)


def classes(fps: DataFrame, distance: int = DISTANCE, plan: list[list[tuple[list[int], int]]] | None = None, bucket: int = BUCKET) -> DataFrame:
    """(id, fp) -> (id, fp, component_id)."""
    fps = cut(fps)
    distinct = packed(fps.groupBy("fp").agg(F.min("id").alias("first")), 10_000)
    found = components(links(distinct.select(F.col("fp").alias("node"), F.array("fp").alias("fps")), 1, distance, plan, bucket), "a", "b")
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("id", "fp", "component_id")


def remix(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of what ``h`` is a hash of, by the finaliser of SplitMix64."""
    x = h + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """Ids marked for broadcast if their counted number allows it."""
    return F.broadcast(ids) if ids.count() <= most else ids


def text_digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, t1, t2): a hash of the text as it is and a 128-bit digest of its words in order."""

    def each(batches):
        for batch in batches:
            t = np.array([digest(text.as_py()) for text in batch.column(2)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t[:, 0]), pa.array(t[:, 1])], names=["id", "mark", "t1", "t2"])

    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text_col).alias("mark"),
        F.col(text_col).alias("text"),
    ).mapInArrow(each, "id long, mark long, t1 long, t2 long")


def digest(text: str | None) -> np.ndarray:
    """Two longs that stand for the words of a text."""
    return np.frombuffer(xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "replace").lower().split())), np.int64)


def wide_fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` fingerprints of 64 bits of the set ``h``: the bits set in over half of its remixed hashes; where half of them have a
    bit, that of the least hash decides, so that bits of small sets aren't mostly zero."""
    if not len(h):
        return np.zeros(words, np.uint64)
    seeds = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, 1)
    ones = np.zeros((words, 8, 8), np.int64)  # by place in a byte, then byte
    low = np.uint64(0x0101010101010101)
    for i in range(0, len(h), 255):  # a byte counts that far
        x = remix(h[i : i + 255] + seeds, 0)
        lanes = np.stack([((x >> np.uint64(j)) & low).sum(1, dtype=np.uint64) for j in range(8)], axis=1)
        ones += lanes.view(np.uint8).reshape(words, 8, 8)
    tie = np.unpackbits(remix(h.min() + seeds, 0).view(np.uint8).reshape(words, 8), axis=1, bitorder="little")
    return np.packbits(2 * ones.transpose(0, 2, 1).reshape(words, BITS) + tie > len(h), axis=1, bitorder="little").view(np.uint64).ravel()


def bit_odds(similarity: float) -> tuple[float, float, int]:
    """(p, q, few): a bit of two sets of this Jaccard similarity differs with probability p at most, or q if one has ``few`` elements or
    fewer. By the angle between them, and for how coarse the counts of small sets are 7 % and 25 % more (as enumerated at 0.8)."""
    angle = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return 1.07 * angle, 1.25 * angle, round(1 / (1 - similarity))


def words_needed(m: int, differ: float, miss: float = MISS) -> int:
    """Words of m partitions each, such that two fingerprints agree on none of all partitions with probability ``miss`` at most."""
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    return int(np.ceil(np.log(miss) / sum(np.log1p(-((1 - differ) ** w)) for w in widths)))


def plan_wide(sample: np.ndarray, rows: int, m: int) -> list[tuple[int, list[int], int]]:
    """[(word, bits, threshold)]: each word's bits dealt into m partitions, with thresholds for m - 1 bits by costs estimated from a
    sample of fingerprints (a row each)."""
    out, scale = [], (rows / max(len(sample), 1)) ** 2
    for k in range(sample.shape[1]):
        bits = np.unpackbits(sample[:, k].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        together = bits.T @ bits
        parts, p, costs = group_bits(len(bits), together, m), np.diag(together) / max(len(bits), 1), []
        for part in parts:
            same = np.unique(bits[:, part] @ 2.0 ** np.arange(len(part)), return_counts=True)[1].astype(float)
            exact = scale * float((same * (same - 1)).sum()) / 2
            pairs = [expected_cost(rows, p, part, exact, t) for t in (0, 1)]
            costs.append([0.0, *(WIDE_SIGNATURE_COST * rows * ball_size(len(part), t) + c for t, c in enumerate(pairs))])
        _, thresholds = allocate(costs, 0)
        out += [(k, part, t) for part, t in zip(parts, thresholds, strict=True) if t >= 0]
    return out


_SIGNATURE = np.dtype([("key", "<u8"), ("node", "<i8"), ("check", "<u8", (CHECK,))])


def wide_signatures(docs: DataFrame, n: int, plan: list[tuple[int, list[int], int]], words: int, few: int, slots: int) -> DataFrame:
    """(text) -> (slot, found): signatures of the texts' fingerprints as packed arrays, a signature's in one of ``slots``.

    Texts of more than ``few`` shingles have ``words`` words, others all that the plan has. Those without a shingle have none.
    """
    longest = 1 + max(k for k, _, _ in plan)
    probes = [(i, k, part, flip) for i, (k, part, t) in enumerate(plan) for flip in ([0, *(1 << j for j in range(len(part)))] if t else [0])]
    columns = np.full((len(probes), 32), BITS * longest)  # that column has zeros
    for row, (_, k, part, _) in enumerate(probes):
        columns[row, : len(part)] = [BITS * k + b for b in part]
    index, word, flips = (np.array([x[i] for x in probes], np.uint64) for i in (0, 1, 3))

    def each(batches):
        for batch in batches:
            seen, nodes, sizes, fps = set(), [], [], []
            for i, text in enumerate(batch.column(0), start=1):
                text = text.as_py()
                node = int(digest(text)[0])
                if node not in seen:
                    seen.add(node)
                    h = np.unique(hashes(text, n))
                    if len(h):
                        size = longest if len(h) <= few else words
                        fp = np.zeros(longest, np.uint64)
                        fp[:size] = wide_fingerprint(h, size)
                        nodes.append(node)
                        sizes.append(size)
                        fps.append(fp)
                if nodes and (len(nodes) == 2000 or i == batch.num_rows):
                    yield from packs(np.array(nodes, np.int64), np.array(sizes, np.uint64), np.array(fps))
                    nodes, sizes, fps = [], [], []

    def packs(nodes, sizes, fps):
        bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
        bits = np.concatenate([bits, np.zeros((len(bits), 1), np.uint8)], axis=1)
        values = np.packbits(bits[:, columns.ravel()].reshape(len(bits), -1, 32), axis=2, bitorder="little").view("<u4")[..., 0].astype(np.uint64) ^ flips
        at, probe = np.nonzero(word < sizes[:, None])
        out = np.empty(len(at), _SIGNATURE)
        out["key"] = index[probe] << np.uint64(32) | values[at, probe]
        out["node"], out["check"] = nodes[at], fps[at, :CHECK]
        slot = (remix(out["key"], 1) % np.uint64(slots)).astype(np.int64)
        out, ends = out[np.argsort(slot, kind="stable")], np.cumsum(np.bincount(slot, minlength=slots))
        found = [(j, out[a:b].tobytes()) for j, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)) if a < b]
        yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["slot", "found"])

    return docs.select("text").mapInArrow(each, "slot int, found binary")


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``size`` nodes the least that the links a - b connect it to."""
    root = np.arange(size)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def meet(found: np.ndarray, most: int, crowd: int = CROWD, held: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n): nodes of signatures, the least node each is connected to by links between two of one signature whose check words
    differ in ``most`` bits or fewer, and how many links it has. Nodes without a link are left out; a signature of more than
    ``crowd`` nodes connects them all. No more than ``held`` links and those of one step are held at a time."""
    found = found[np.lexsort((found["node"], found["key"]))]
    found = found[np.concatenate(([True], (found["key"][1:] != found["key"][:-1]) | (found["node"][1:] != found["node"][:-1])))]
    nodes, at = np.unique(found["node"], return_inverse=True)
    starts = np.flatnonzero(np.concatenate(([True], found["key"][1:] != found["key"][:-1])))
    sizes = np.diff(np.concatenate((starts, [len(found)])))
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    check, n = np.ascontiguousarray(found["check"]), np.zeros(len(nodes), np.int64)
    crowded = np.flatnonzero(size > crowd)
    a, b, waiting = [at[crowded]], [at[first[crowded]]], len(crowded)
    np.add.at(n, at[crowded], size[crowded] - 1)
    end = np.where(size > crowd, 0, first + size)
    i, step = np.flatnonzero(np.arange(1, len(found) + 1) < end), 1
    while len(i):
        near = i[np.bitwise_count(check[i] ^ check[i + step]).sum(1, dtype=np.int64) <= most]
        x, y = at[near], at[near + step]
        n += np.bincount(x, minlength=len(n)) + np.bincount(y, minlength=len(n))
        a, b, waiting, step = [*a, x], [*b, y], waiting + len(x), step + 1
        if waiting > held:
            root = forest(len(nodes), np.concatenate(a), np.concatenate(b))
            a, b, waiting = [np.arange(len(nodes))], [root], 0
        i = i[i + step < end[i]]
    root = forest(len(nodes), np.concatenate(a), np.concatenate(b))
    linked = n > 0
    return nodes[linked], nodes[root[linked]], n[linked]


def wide_links(texts: DataFrame, sample: DataFrame, rows: int, n: int, similarity: float, m: int | None = None) -> DataFrame:
    """(a, b, n): links between digests (t1) of texts, whose components hold every two whose sets of shingles are similar; n as in ``meet``.

    A fingerprint has several words of 64 bits. It is searched as a single one is: bits dealt into partitions by correlation, thresholds
    allocated by cost, variants probed within them. Texts that share a signature are verified on ``CHECK`` words. Two that
    differ in fewer than m bits of any word are sure to share a signature. Bits enough for a pair at ``similarity`` (ten of 64)
    would make any guaranteed search of one word quadratic; so there are as many words as it takes for such a pair, whose
    differing bits fall at random, to share none with probability ``MISS`` at most. m has the least cost in signatures and pairs expected.
    """
    differ, worst, few = bit_odds(similarity)
    if m is None:
        m = min(PARTITIONS, key=lambda m: words_needed(m, differ) * m * (WIDE_SIGNATURE_COST + rows / 2 ** (BITS / m + 1)))
    words, longest = words_needed(m, differ), words_needed(m, worst)

    def each(batches):
        for batch in batches:
            fps = [wide_fingerprint(np.unique(hashes(t.as_py(), n)), longest).view(np.int64).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.list_(pa.int64()))], names=["fps"])

    seen = [r["fps"] for r in sample.select("text").mapInArrow(each, "fps array<long>").collect()]  # SAMPLE of them
    plan = plan_wide(np.array(seen, np.int64).reshape(len(seen), longest).view(np.uint64), rows, m)
    slots = max(2, -(-rows * m * words // TASK_SIGNATURES))
    bits, worst = BITS * min(CHECK, words), max(differ, worst)
    most = int(bits * worst + CHECK_DEVIATIONS * (bits * worst * (1 - worst)) ** 0.5)

    def met(batches):
        found = [np.frombuffer(x.as_py(), _SIGNATURE) for batch in batches for x in batch.column(0)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in meet(np.concatenate(found), most)], names=["a", "b", "n"])

    signed = wide_signatures(texts, n, plan, words, few, slots)
    return signed.repartitionById(slots, F.col("slot")).select("found").mapInArrow(met, "a long, b long, n long")


def sketch(h: np.ndarray, size: int = SKETCH, chunk: int = 1000) -> np.ndarray:
    """``size`` words of bits of the set ``h`` of 32-bit hashes: one bit of its least value under each of 64 * size hash functions.

    A bit agrees between two sets with probability (1 + their Jaccard similarity) / 2.
    """
    if not len(h):
        return np.zeros(size, np.uint64)
    k = np.arange(1000, 1000 + 128 * size, dtype=np.uint64).reshape(2, -1, 1)
    scale, shift = remix(k[0], 1) | np.uint64(1), remix(k[1], 2)
    x = h.astype(np.uint64)
    least = np.min([((x[i : i + chunk] * scale + shift) >> np.uint64(32)).min(1) for i in range(0, len(x), chunk)], axis=0)
    return np.packbits((remix(least, 9) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)


def most_differing(similarity: float, size: int = SKETCH, deviations: float = DEVIATIONS) -> int:
    """Bits in which the sketches of two sets of this similarity may differ."""
    p, n = (1 - similarity) / 2, 64 * size
    return int(n * p + deviations * (n * p * (1 - p)) ** 0.5)


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, text) -> (node, shingles, sketch): the sorted 32-bit hashes of each n-word shingle, as bytes, and their sketch."""

    def each(batches):
        for batch in batches:
            sets = [np.unique(hashes(t.as_py(), n).astype(np.uint32)) for t in batch.column(1)]
            sketches = pa.array([sketch(s).view(np.int64).tolist() for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), sketches], names=["node", "shingles", "sketch"])

    return docs.select("node", "text").mapInArrow(each, "node long, shingles binary, sketch array<long>")


def _differing(a: str, b: str):
    """Bits in which two sketches differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH)])


@pandas_udf(BooleanType())
def _same(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    out = []
    for x, y, s in zip(a, b, least, strict=True):
        x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both >= s * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


def _with_sets(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) whose sets of shingles are similar."""
    sets = sets.select("node", "shingles")
    with_a = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "_a"}), "a")
    return with_a.join(sets.withColumnsRenamed({"node": "b", "shingles": "_b"}), "b").filter(_same("_a", "_b", F.lit(similarity))).select("a", "b")


def verified_components(members: DataFrame, sets: DataFrame, similarity: float, hubs: int = HUBS) -> DataFrame | None:
    """(sig, node, score, sketch) -> (node, root): the components of the links between members of one group (sig) that are similar; None without links.

    In each round a few members of each group, those of highest score first, are compared with all others that are
    not known to be connected to them, and then leave it. A group is done when what is left of it is connected. So every
    pair of its members has been compared or is connected, though a large group of copies needs a pair a member only. Members
    of a group's largest component needn't be taken: the others meet them. A comparison takes the sketches first, within
    the join, and only pairs that they leave possible come out of it and have their sets fetched. So texts that share a
    passage, but are not near copies, make no rows.
    """
    members, roots, most = members.withColumn("root", F.col("node")), None, most_differing(similarity)
    while True:
        sizes = members.groupBy("sig", "root").agg(F.count("*").alias("n"))
        major = F.max_by("root", F.struct("n", "root"))
        split = sizes.groupBy("sig").agg(F.when(F.max("n") > 1, major).alias("major"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
        left = packed(members.join(small(packed(split)), "sig"), WIDE)
        if left.isEmpty():
            return roots
        place = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("score"), "node"))
        hub = [F.col("sig").alias("hub_sig"), *[F.col(c).alias(f"hub_{c}") for c in ("root", "sketch")], F.col("node").alias("hub")]
        taken = left.filter("major is null or root <> major").select("*", place.alias("place")).filter(F.col("place") <= hubs).select(hub)
        taken = small(packed(taken), BROADCAST_SKETCHES)
        possible = (F.col("sig") == F.col("hub_sig")) & (F.col("root") != F.col("hub_root")) & (_differing("sketch", "hub_sketch") <= most)
        met = left.join(taken, possible).select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
        good = packed(_with_sets(packed(met), sets, similarity))
        gone = taken.select(F.col("hub_sig").alias("sig"), F.col("hub").alias("node"))
        members = left.join(gone, ["sig", "node"], "left_anti").drop("major")
        if not good.isEmpty():
            roots = components(good if roots is None else good.union(roots.select("node", "root")), "a", "b")
            found = small(roots.select("node", F.col("root").alias("_root")))
            members = members.join(found, "node", "left").withColumn("root", F.coalesce("_root", "root")).drop("_root")
        hubs = min(8 * hubs, MOST_HUBS)


def _same_row(one: DataFrame, two: DataFrame):
    """A join condition: the same id, which may be null, and text."""
    return one["id"].eqNullSafe(two["id"]) & (one["mark"] == two["mark"])


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: float = SIMILAR) -> DataFrame:
    """(id, mark, least) by verified similarity of texts, for a looser notion of near duplicate than a fixed distance.

    Texts link if the Jaccard similarity of their sets of n-word shingles is ``similarity`` or more. Texts that the search by
    SimHash fingerprints connects are a group; within it every pair is compared exactly, or else links found so far already
    connect them. Texts with the same words are one from the start. mark is a hash of the text; least has the id and mark of
    the class's first row, by id with null last.
    """
    signed = cut(text_digests(docs, id_col, text_col))
    nodes = signed.groupBy("t1", "t2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first"))
    nodes = packed(nodes.withColumn("node", F.monotonically_increasing_id()), 10_000)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    picked = nodes.select("first.mark").distinct().orderBy(F.xxhash64("mark")).limit(SAMPLE)
    sample = texts.join(F.broadcast(cut(picked)), "mark").dropDuplicates(["mark"])
    found = packed(wide_links(texts, sample, nodes.count(), n, similarity))
    groups = components(found, "a", "b").select(F.col("node").alias("t1"), F.col("root").alias("sig"))
    scores = found.groupBy(F.col("a").alias("t1")).agg(F.sum("n").alias("score")).join(groups, "t1", "left")
    grouped = nodes.join(scores, "t1").select(F.coalesce("sig", "t1").alias("sig"), "node", "score", "first")
    grouped = packed(grouped, 10_000)
    involved = small(packed(grouped.select("first.id", "first.mark", "node")))
    sets = cut(shingle_sets(texts.join(involved, _same_row(texts, involved)), n).dropDuplicates(["node"]))
    about = grouped.select("sig", "node", "score").join(sets.select("node", "sketch"), "node")
    roots = verified_components(packed(about, WIDE), sets, similarity)
    rooted = nodes.withColumn("root", F.col("node")) if roots is None else nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    return signed.join(rooted.join(least, "root").select("t1", "t2", "least"), ["t1", "t2"]).select("id", "mark", "least")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, component_id): a class's id is the smallest non-null id in it, or null without any."""
    return text_classes(docs, id_col, text_col, **options).select("id", F.col("least.id").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id, or one with a null id where all are null."""
    found = cut(text_classes(docs, id_col, text_col, **options))
    first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("mark") == F.col("least.mark"))
    gone = small(packed(found.filter(~first).select("id", "mark").distinct()))
    marked = docs.withColumns({"_id": F.col(id_col).cast("long"), "_mark": F.xxhash64(text_col)})
    same = lambda keys: marked["_id"].eqNullSafe(keys["id"]) & (marked["_mark"] == keys["mark"])
    kept = marked.join(gone, same(gone), "left_anti")
    repeated = packed(found.filter(first).groupBy("id", "mark").count().filter("count > 1").select("id", "mark"))
    if not repeated.isEmpty():
        again = kept.join(repeated, same(repeated), "left_semi").dropDuplicates(["_id", "_mark"])
        kept = kept.join(repeated, same(repeated), "left_anti").unionByName(again)
    return kept.select(docs.columns)


def op8_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(fingerprints(documents(spark, sf_dir)))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
