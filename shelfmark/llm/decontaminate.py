"""Benchmark decontamination by greedy string tiling (Wise's running Karp-Rabin).

Texts and benchmark items become tokens: runs of letters and digits in lower case, by CRC-32. Windows of ``MIN_MATCH``
tokens are hashed by a rolling Karp-Rabin hash; a window of a text that is also one of an item is a seed, and items that
share a seed with a text are tiled against it. Tiling repeatedly marks the longest match of tokens not marked yet (ties:
first in the item, then in the text), down to MIN_MATCH tokens. Matches of a search length or more are found by hashing
windows of that length over unmarked tokens; the length starts high and is halved once nothing that long is left. Where equal windows
would pair up in more than ``PAIRS`` places, as in repetitive texts, runs are followed along the diagonals row by row instead,
in memory that grows with the text's length alone. An item's
coverage is the part of its tokens in tiles: order doesn't matter, so reordered passages count. A text is contaminated
by an item when coverage reaches ``COVERAGE``.

If the benchmark's text is within ``broadcast_bytes`` its windows travel to the texts, which are then tiled where they lie,
without a shuffle. Beyond that size seeds are joined: text windows that pass a bit map of fixed size are joined to the
benchmark's windows, and pairs are tiled that share seeds at enough places of the item: a tile of n >= 5 tokens holds
n - 4 >= n / 5 of them, so fewer than a fifth of the tokens to cover can't do. Both ways give the same rows.

Defined cases: long texts are tiled whole; null and empty texts and items match nothing; items of fewer than MIN_MATCH tokens can't hold a tile and
match nothing; repeated rows are reported once for each row; null ids are reported as null; other columns aren't looked at.
The join way knows texts and items by a 128-bit digest of their text, so ids may be null or repeated in both.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shelfmark.llm.common import documents, free, text_of

MIN_MATCH, COVERAGE, LONGEST = 5, 0.5, 40
#: The benchmark's windows take about 3.5 bytes of each worker's memory for each byte of its text.
BROADCAST_BYTES = 32 << 20
#: Pairs of places with equal windows that are looked at one by one; more are followed along diagonals.
PAIRS = 100_000
#: Bits of the map that text windows pass before the seed join: 2 ** MAP_BITS, whatever the benchmark's size.
MAP_BITS = 24

_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOUND = "array<struct<item:int,item_tokens:int,tiles:int,tiled:int,longest:int,coverage:double>>"


def tokens(text: str | None) -> np.ndarray:
    found = _TOKEN.findall((text or "").lower().encode("utf-8", "replace"))
    return np.fromiter(map(zlib.crc32, found), dtype=np.uint64, count=len(found))


def rolling(x: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` tokens, modulo 2**64; high bits are the good ones."""
    if len(x) < width:
        return np.zeros(0, np.uint64)
    n = len(x) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * _BASE + (x[i : i + n] + np.uint64(1))
    return h * np.uint64(0xD6E8FEB86659FD93)


def _windows_at(x: np.ndarray, free: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows of ``width`` that hold no marked token."""
    h = rolling(x, width)
    if not len(h):
        return h, np.zeros(0, np.int64)
    run = np.concatenate(([0], np.cumsum(~free)))
    at = np.flatnonzero(run[width:] == run[:-width])
    return h[at], at


def _runs_by_pairs(item: np.ndarray, text: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, search: int) -> list[tuple[int, int, int]] | None:
    """(length, place in item, place in text) of the runs of ``search`` or more unmarked tokens; None if windows pair up too often."""
    ha, at_a = _windows_at(item, free_a, search)
    hb, at_b = _windows_at(text, free_b, search)
    if not len(ha) or not len(hb):
        return []
    known, counts = np.unique(ha, return_counts=True)
    place = np.minimum(np.searchsorted(known, hb), len(known) - 1)
    keep = known[place] == hb
    if counts[place[keep]].sum() > PAIRS:
        return None
    places = defaultdict(list)
    for h, i in zip(ha.tolist(), at_a.tolist(), strict=True):
        places[h].append(i)
    starts = {(i, j) for h, j in zip(hb[keep].tolist(), at_b[keep].tolist(), strict=True) for i in places[h] if (item[i : i + search] == text[j : j + search]).all()}
    runs = []
    for i, j in sorted(starts):
        if (i - 1, j - 1) in starts:
            continue  # inside a longer match
        n = search
        while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_a[i + n] and free_b[j + n]:
            n += 1
        runs.append((n, i, j))
    return runs


def _runs_by_diagonals(item: np.ndarray, text: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, search: int) -> list[tuple[int, int, int]]:
    """The same, however repetitive both are: lengths of the runs that end at each place of the text, for one place of the item after another."""
    m, runs = len(text), []
    length = np.zeros(m + 1, np.int64)  # of the run that ends before place j of the text
    for i in range(len(item) + 1):
        after = np.zeros(m + 1, np.int64)
        if i < len(item) and free_a[i]:
            same = (text == item[i]) & free_b
            after[1:][same] = length[:-1][same] + 1
        ended = np.flatnonzero(length >= search)
        ended = ended[(ended == m) | (after[np.minimum(ended + 1, m)] == 0)]
        runs += [(n, i - n, j - n) for j, n in zip(ended.tolist(), length[ended].tolist(), strict=True)]
        length = after
    return runs


def tile(item: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH, longest: int = LONGEST) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length) of running Karp-Rabin greedy string tiling."""
    free_a, free_b, tiles = np.ones(len(item), bool), np.ones(len(text), bool), []
    search = max(min_match, min(longest, len(item), len(text)))
    while True:
        matches = _runs_by_pairs(item, text, free_a, free_b, search)
        if matches is None:
            matches = _runs_by_diagonals(item, text, free_a, free_b, search)
        most = max((n for n, _, _ in matches), default=0)
        if most > 2 * search:  # a very long match: search for ones as long first
            search = most
            continue
        queue = [(-n, i, j) for n, i, j in matches]
        heapify(queue)
        while queue:
            n, i, j = heappop(queue)
            free = free_a[i : i - n] & free_b[j : j - n]
            if free.all():
                free_a[i : i - n] = free_b[j : j - n] = False
                tiles.append((i, j, -n))
                continue
            # A longer match took some of it: what is left in a row waits for its turn by its own length.
            edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0])))).tolist()
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                if b - a >= search:
                    heappush(queue, (a - b, i + a, j + a))
        if search == min_match:
            return tiles
        search = max(min_match, search // 2)


class Benchmark:
    """Items by number, and which of them hold a window, as sorted arrays: (hash, item, how many of the item's places hold it)."""

    def __init__(self, items: list[tuple[int, str | None]], min_match: int = MIN_MATCH):
        self.min_match = min_match
        self.ids = [i for i, _ in items]
        self.items = [tokens(t).astype(np.uint32) for _, t in items]
        found = [np.unique(rolling(x.astype(np.uint64), min_match), return_counts=True) for x in self.items]
        hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.holder = np.repeat(np.arange(len(found), dtype=np.int32), [len(h) for h, _ in found])[order]
        self.places = (np.concatenate([n for _, n in found]) if found else np.zeros(0, np.int64))[order].astype(np.int32)
        self.shift = np.uint64(64 - 20)
        self.map = np.zeros(1 << 20, bool)
        self.map[self.hashes >> self.shift] = True

    def candidates(self, h: np.ndarray, coverage: float) -> list[int]:
        """Items that hold enough places with one of the windows ``h``."""
        first, last = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True) if b > a] or [np.zeros(0, np.int64)])
        items, where = np.unique(self.holder[at], return_inverse=True)
        shared = np.bincount(where, self.places[at], len(items))
        return [int(k) for k, n in zip(items, shared, strict=True) if n >= least_places(len(self.items[k]), coverage)]

    def find(self, text: str | None, coverage: float) -> list[tuple[int, int, int, int, int, float]]:
        x = tokens(text)
        h = rolling(x, self.min_match)
        h = np.unique(h[self.map[h >> self.shift]])
        if not len(h):
            return []
        return [(k, *row) for k in self.candidates(h, coverage) if (row := tiled(self.items[k].astype(np.uint64), x, self.min_match, coverage))]


def least_places(n: int, coverage: float) -> float:
    """Places of an item of ``n`` tokens that begin a seed of a text that covers it; one at least."""
    return max(1.0, coverage * n / 5)


def tiled(item: np.ndarray, text: np.ndarray, min_match: int, coverage: float) -> tuple[int, int, int, int, float] | None:
    """(item tokens, tiles, tokens in tiles, longest tile, coverage), or None below the threshold."""
    tiles = tile(item, text, min_match)
    covered = sum(n for _, _, n in tiles)
    if not tiles or covered < coverage * len(item):
        return None
    return len(item), len(tiles), covered, max(n for _, _, n in tiles), covered / len(item)


def matcher(benchmark: Benchmark, coverage: float = COVERAGE):
    """A column function: text -> the items that contaminate it."""

    @pandas_udf(_FOUND)
    def find(texts: pd.Series) -> pd.Series:
        keys = ("item", "item_tokens", "tiles", "tiled", "longest", "coverage")
        return pd.Series([[dict(zip(keys, row, strict=True)) for row in benchmark.find(t, coverage)] for t in texts])

    return find


def fits_broadcast(benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> bool:
    return (benchmark.agg(F.sum(F.octet_length(text_of()) + 64)).first()[0] or 0) <= broadcast_bytes


def load(benchmark: DataFrame, min_match: int = MIN_MATCH) -> Benchmark:
    return Benchmark([(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").orderBy("item_id", "text").collect()], min_match)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, item_tokens, tiles, tiled, longest, coverage) for every text and item at or over the threshold."""
    if not fits_broadcast(benchmark, broadcast_bytes):
        hits = _by_seed_join(docs, benchmark, coverage, min_match)
        named = hits.join(benchmark.select(F.col("item_id").cast("long"), _key().alias("_item_key")), "_item_key")
        return docs.select(F.col("doc_id").cast("long"), _key().alias("_text_key")).join(named, "_text_key").select("doc_id", "item_id", *[c for c in hits.columns if c[0] != "_"])
    items = load(benchmark, min_match)
    ids = F.array(*[F.lit(i).cast("long") for i in items.ids]) if items.ids else F.lit(None).cast("array<long>")
    hits = docs.select("doc_id", F.explode(matcher(items, coverage)(text_of())).alias("hit"))
    return hits.select("doc_id", F.get(ids, F.col("hit.item")).alias("item_id"), *[f"hit.{c}" for c in ("item_tokens", "tiles", "tiled", "longest", "coverage")])


def _key() -> Column:
    return F.unhex(F.md5(text_of().cast("binary")))


def _by_seed_join(docs: DataFrame, benchmark: DataFrame, coverage: float, min_match: int) -> DataFrame:
    """(_text_key, _item_key, ...) for every distinct text and item at or over the threshold."""

    def seeds(table: DataFrame, only: np.ndarray | None) -> DataFrame:
        def each(batches):
            for batch in batches:
                for i, t in zip(batch.column(0), batch.column(1), strict=True):
                    x = tokens(t.as_py())
                    h, places = np.unique(rolling(x, min_match), return_counts=True)
                    if only is not None:
                        h = h[(only[h >> np.uint64(64 - MAP_BITS + 3)] >> ((h >> np.uint64(64 - MAP_BITS)) & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    if len(h):
                        size = [pa.array(places[: len(h)], pa.int64()), pa.array([len(x)] * len(h), pa.int64())]
                        yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(h), pa.binary()), pa.array(h.view(np.int64)), *size], names=["key", "seed", "places", "size"])

        return table.select(_key().alias("key"), text_of().alias("text")).mapInArrow(each, "key binary, seed long, places long, size long")

    item_seeds = seeds(benchmark, None).withColumnRenamed("key", "_item_key").distinct()
    cell = F.shiftrightunsigned("seed", 64 - MAP_BITS)
    bits = item_seeds.groupBy(F.shiftright(cell, 3).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(seed, {64 - MAP_BITS}) & 7 as int))")).alias("bits"))
    only = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in bits.collect():  # at most 2 ** (MAP_BITS - 3) rows
        only[r["byte"]] = r["bits"]
    text_seeds = seeds(docs, only).select(F.col("key").alias("_text_key"), "seed").distinct()
    shared = text_seeds.join(item_seeds, "seed").groupBy("_text_key", "_item_key").agg(F.sum("places").alias("places"), F.max("size").alias("size"))
    pairs = shared.filter(F.col("places") >= F.greatest(F.lit(1.0), F.lit(coverage) * F.col("size") / 5)).select("_text_key", "_item_key")

    @pandas_udf("item_tokens int, tiles int, tiled int, longest int, coverage double")
    def both(items: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [tiled(tokens(i), tokens(t), min_match, coverage) or (None,) * 5 for i, t in zip(items, texts, strict=True)]
        return pd.DataFrame(rows, columns=["item_tokens", "tiles", "tiled", "longest", "coverage"]).astype({"item_tokens": "Int32", "tiles": "Int32", "tiled": "Int32", "longest": "Int32", "coverage": "float64"})

    texts = lambda table, key, name: table.select(_key().alias(key), F.col("text").alias(name)).dropDuplicates([key])
    met = texts(docs, "_text_key", "_text").join(pairs, "_text_key").join(texts(benchmark, "_item_key", "_item"), "_item_key")
    hits = met.select("_text_key", "_item_key", both("_item", "_text").alias("hit"))
    return hits.filter("hit.coverage is not null and not isnan(hit.coverage)").select("_text_key", "_item_key", "hit.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the texts that an item contaminates."""
    if fits_broadcast(benchmark, broadcast_bytes):
        return docs.filter(F.size(matcher(load(benchmark, min_match), coverage)(text_of())) == 0)
    name = free(docs.columns, "_text_key")
    gone = _by_seed_join(docs, benchmark, coverage, min_match).select(F.col("_text_key").alias(name)).distinct()
    return docs.withColumn(name, _key()).join(gone, name, "left_anti").select(docs.columns)


def op6_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
