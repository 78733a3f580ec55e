"""Deleted interpolation (Jelinek and Mercer, 1980) of word bigrams, counted over the whole corpus.

P(w | h) = l2(b) c(h w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of the context's count c(h) and the
weights of a bucket are learned by expectation-maximisation on held-out counts: every token of the training texts of one
fold, each scored with its own text deleted from the counts. (One fold of six keeps the disk in bounds; its weights cost 0.0004 log10
a held-out token at sf0.1 against the mean of those of all six.)

How it is spread. Nothing of the model is broadcast, since it grows with the corpus:

1. Texts are packed into chunks of up to about ``CHUNK`` tokens (a row each: word numbers within the chunk, hashes of its
   words, ids), compressed and checkpointed. The fold that the EM learns from has chunks of its own. A chunk is the unit that asks for counts, so a key is asked for once a chunk and not
   once an occurrence.
2. Each chunk sends, for all its distinct words and bigrams, 64-bit keys in order with its own training counts, cut by the
   leading bits into buckets. A bucket is a task's group: it adds up the counts of its keys over all chunks and answers each
   chunk with a list of totals, aligned with the keys that the chunk sent. Keys are hashes and every chunk sends a key once,
   so frequent words make no bucket larger; ``BUCKET`` bounds the mean number of keys in one.
3. Chunks meet their answers twice: to count quantised (bucket, p1, p2) cells of the held-out tokens for the EM (a table of
   bounded size, over all of them), and to score.

Two keys that share a 64-bit hash share a count; at 10**9 distinct keys about 0.03 such pairs are expected.

Defined cases: a null text is the empty text, whose only token is the end; null ids are as the empty id; repeated rows count
and are scored each; very long texts are one text of one chunk; without training texts every count is 0; a bucket without held-out tokens takes the weights of all;
other columns aren't looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import documents
from shelfmark.plans.lineage import cut

CHUNK, BUCKET = 3_500_000, 1_000_000
FOLDS, HELD_OUT, EM_FOLD = 7, 2, 3
EM_ROUNDS, BINS, CONTEXTS = 60, 80, 40

BEGIN, END = 0, 1
_BEGIN_HASH, _END_HASH = (np.uint64(xxhash.xxh64_intdigest(b"", seed)) for seed in (2, 1))


def pack(x: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes()) if len(x) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class _Numbering(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 2
        return n


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


class Chunk:
    """Texts as word numbers: ``ids`` of all tokens with ends, ``sizes`` of the texts, ``words`` (hash of each number)."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, words: np.ndarray, folds: np.ndarray):
        self.ids, self.sizes, self.words, self.folds = ids, sizes, words, folds
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        previous = np.empty_like(ids)
        previous[1:] = ids[:-1]
        previous[self.starts] = BEGIN
        self.previous = previous
        self.train = np.repeat(folds != HELD_OUT, sizes)

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words (kind 0) or bigrams (1): keys in order, own training counts; codes in order, their places among the keys."""
        n = np.int64(len(self.words))
        marked = self.codes(kind) * 2
        marked += self.train
        marked.sort()
        first = np.flatnonzero(np.concatenate(([True], marked[1:] >> 1 != marked[:-1] >> 1))) if len(marked) else np.zeros(0, np.int64)
        codes = marked[first] >> 1
        own = np.add.reduceat(marked & 1, first).astype(np.uint32) if len(first) else np.zeros(0, np.uint32)
        del marked, first
        keys = mix(self.words[codes // n], self.words[codes % n]) if kind else self.words[codes]
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return keys[order], own[order], codes, place

    def codes(self, kind: int) -> np.ndarray:
        return self.previous.astype(np.int64) * len(self.words) + self.ids if kind else self.ids.astype(np.int64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key of two hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33)))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_CHUNK_SCHEMA = "chunk long, em boolean, tokens long, train_tokens long, train_docs long, doc_ids array<long>, sizes binary, ids binary, words binary"


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    def each(batches):
        part, done = TaskContext.get().partitionId(), 0
        open_chunks = {em: (_Numbering(), [], []) for em in (False, True)}

        def close(em: bool):
            nonlocal done
            numbers, held, doc_ids = open_chunks[em]
            open_chunks[em] = (_Numbering(), [], [])
            ids = np.concatenate(held)
            sizes = np.array([len(x) for x in held], np.int32)
            train = np.array([fold_of(i) != HELD_OUT for i in doc_ids])
            words = np.array([_BEGIN_HASH, _END_HASH, *map(xxhash.xxh64_intdigest, numbers)], np.uint64)
            values = [(part << 32) + done, em, len(ids), int(sizes[train].sum()), int(train.sum()), doc_ids, pack(sizes), pack(ids), words.tobytes()]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            done += 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _CHUNK_SCHEMA.split(", ")])

        sizes = {False: 0, True: 0}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                em = fold_of(doc_id) == EM_FOLD
                numbers, held, doc_ids = open_chunks[em]
                found = (text.as_py() or "").encode("utf-8", "replace").lower().split()
                held.append(np.append(np.fromiter(map(numbers.__getitem__, found), np.int32, count=len(found)), np.int32(END)))
                doc_ids.append(doc_id)
                sizes[em] += len(held[-1])
                if sizes[em] >= size:
                    yield close(em)
                    sizes[em] = 0
        for em in (False, True):
            if sizes[em]:
                yield close(em)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, _CHUNK_SCHEMA)


def _chunk(row: dict) -> Chunk:
    return Chunk(unpack(row["ids"], np.int32), unpack(row["sizes"], np.int32), np.frombuffer(row["words"], np.uint64), np.array([fold_of(i) for i in row["doc_ids"]], np.int64))


def _delta(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def requests(packed: DataFrame, bits: int) -> DataFrame:
    """(kind, bucket, chunk, keys, own) of all words (kind 0) and bigrams (kind 1)."""

    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for kind in (0, 1):
                    keys, own, _, _ = _chunk(row).keys(kind)
                    ends = _bucket_ends(keys, bits)
                    rows = [(b, a, e) for b, (a, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if e > a]
                    columns = [
                        pa.array([kind] * len(rows), pa.int32()),
                        pa.array([b for b, _, _ in rows], pa.int32()),
                        pa.array([row["chunk"]] * len(rows), pa.int64()),
                        pa.array([_delta(keys[a:e]) for _, a, e in rows], pa.binary()),
                        pa.array([pack(own[a:e]) for _, a, e in rows], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "chunk", "keys", "own"])

    return packed.mapInArrow(each, "kind int, bucket int, chunk long, keys binary, own binary")


def _bucket_ends(keys: np.ndarray, bits: int) -> list[int]:
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
    return [*np.searchsorted(keys, edges, side="left").tolist(), len(keys)]


def totals(asked: DataFrame) -> DataFrame:
    """(chunk, kind, bucket, totals, known): the summed counts of the keys that a chunk sent, and how many keys of the bucket have one."""

    def add_up(table: pa.Table) -> pa.Table:
        sent = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in table["keys"].to_pylist()]
        own = np.concatenate([unpack(o, np.uint32) for o in table["own"].to_pylist()]).astype(np.uint64)
        keys = np.concatenate(sent)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        group = np.cumsum(new) - 1
        sums = np.add.reduceat(own[order], np.flatnonzero(new))
        back = np.empty(len(keys), np.uint64)
        back[order] = sums[group]
        ends = np.cumsum([len(s) for s in sent])
        known = [int((sums > 0).sum())] + [0] * (len(sent) - 1)  # once a bucket
        lists = [pack(x) for x in np.split(back, ends[:-1])]
        return pa.table({"chunk": table["chunk"], "kind": table["kind"], "bucket": table["bucket"], "totals": pa.array(lists, pa.binary()), "known": pa.array(known, pa.int64())})

    return asked.groupBy("kind", "bucket").applyInArrow(add_up, "chunk long, kind int, bucket int, totals binary, known long")


class Counted:
    """A chunk with the corpus counts of its words, contexts and bigrams."""

    def __init__(self, row: dict, answers: list[dict], train_docs: int):
        self.chunk = c = _chunk(row)
        self.word = np.zeros(len(c.words), np.int64)
        for kind in (0, 1):
            _, _, codes, place = c.keys(kind)
            lists = [unpack(a["totals"], np.uint64) for a in sorted((a for a in answers if a["kind"] == kind), key=lambda a: a["bucket"])]
            counts = (np.concatenate(lists) if lists else np.zeros(0, np.uint64))[place].astype(np.int64)
            if kind:
                self.pair = counts[np.searchsorted(codes, c.codes(1))]
            else:
                self.word[codes] = counts
        self.context = self.word.copy()
        self.context[BEGIN] = train_docs


def bucket_of(count: np.ndarray) -> np.ndarray:
    """Context bucket: 0 for 0, then one for each power of two."""
    return np.minimum(np.where(count > 0, np.frexp(np.maximum(count, 1).astype(np.float64))[1], 0), CONTEXTS - 1)


def _bin(p: np.ndarray) -> np.ndarray:
    """Quantised probability: eighths of a decade; the last bin is zero."""
    with np.errstate(divide="ignore"):
        b = np.floor(-8 * np.log10(p))
    return np.where(p > 0, np.clip(b, 0, BINS - 2), BINS - 1).astype(np.int64)


def bin_value(b: np.ndarray) -> np.ndarray:
    return np.where(b == BINS - 1, 0.0, 10.0 ** (-(b + 0.5) / 8))


def held_out_cells(x: Counted, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (context bucket, bin of p1, bin of p2) of the EM fold's tokens, their own text deleted from the counts."""
    c, found = x.chunk, []
    for d in np.flatnonzero(c.folds == EM_FOLD).tolist():
        s = slice(c.starts[d], c.starts[d] + c.sizes[d])
        ids, previous = c.ids[s], c.previous[s]
        code = previous.astype(np.int64) * len(c.words) + ids
        own = lambda a: (lambda u: u[1][u[0]])(np.unique(a, return_inverse=True, return_counts=True)[1:])
        word = x.word[ids] - own(ids)
        every, where = np.unique(np.concatenate([previous, ids]), return_inverse=True)
        uses = np.bincount(where[: len(ids)], minlength=len(every))
        context = x.context[previous] - uses[where[: len(ids)]]
        pair = x.pair[s] - own(code)
        p1 = word / max(1, n - len(ids))
        p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
        found.append((bucket_of(context) * BINS + _bin(p1)) * BINS + _bin(p2))
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def learn_weights(cells: dict[int, int], v: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """(CONTEXTS, 3): weights of p0, p1 and p2 for each context bucket, by expectation-maximisation."""
    cell = np.array(sorted(cells), np.int64)
    n = np.array([cells[c] for c in cell.tolist()], np.float64)
    bucket = cell // (BINS * BINS)
    p = np.stack([np.full(len(cell), 1 / (v + 1)), bin_value(cell // BINS % BINS), bin_value(cell % BINS)], 1)

    def em(some: np.ndarray, context: bool) -> np.ndarray:
        w = np.array([0.1, 0.5, 0.4]) if context else np.array([0.2, 0.8, 0.0])
        for _ in range(rounds):
            r = p[some] * w
            r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
            w = (n[some, None] * r).sum(0) + np.array([0.5, 0.5, 0.5 if context else 0.0])
            w /= w.sum()
        return w

    everything = em(bucket > 0, True)
    return np.stack([em(bucket == b, b > 0) if (bucket == b).any() else everything if b else em(bucket < 0, False) for b in range(CONTEXTS)])


class Model:
    """What is fitted: the checkpointed chunks and answers, corpus sizes and weights."""

    def __init__(self, packed: DataFrame, answers: DataFrame, n: int, v: int, train_docs: int, weights: np.ndarray | None = None):
        self.packed, self.answers, self.n, self.v, self.train_docs, self.weights = packed, answers, n, v, train_docs, weights

    def over_chunks(self, each, schema: str, em_only: bool = False) -> DataFrame:
        train_docs, packed, answers = self.train_docs, self.packed, self.answers
        if em_only:
            packed = packed.filter("em")
            answers = answers.join(F.broadcast(packed.select("chunk")), "chunk", "left_semi") if packed.count() <= 1_000_000 else answers.join(packed.select("chunk"), "chunk", "left_semi")

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            return each([(row, Counted(row, right.to_pylist(), train_docs)) for row in left.to_pylist()])

        return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, schema)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, bucket: int = BUCKET) -> Model:
    packed = cut(chunks(docs, id_col, text_col, chunk))
    sizes = packed.agg(F.sum("tokens"), F.sum("train_tokens"), F.sum("train_docs")).first()
    tokens, n, train_docs = (int(s or 0) for s in sizes)
    bits = max(0, int(np.ceil(np.log2(max(1, tokens) / bucket))))
    answers = cut(totals(requests(packed, bits)))
    v = int(answers.filter("kind = 0").agg(F.sum("known")).first()[0] or 0)
    model = Model(packed, answers, n, v, train_docs)

    def cells(counted) -> pa.Table:
        found = [held_out_cells(x, n) for _, x in counted]
        return pa.table({"cell": pa.array(np.concatenate([c for c, _ in found])), "n": pa.array(np.concatenate([k for _, k in found]))})

    rows = model.over_chunks(cells, "cell long, n long", em_only=True).groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most CONTEXTS * BINS ** 2
    model.weights = learn_weights({r["cell"]: r["n"] for r in rows}, v)
    return model


def score(model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text the model was fitted with."""
    n, v, weights = model.n, model.v, model.weights

    def each(counted) -> pa.Table:
        out = []
        for row, x in counted:
            c = x.chunk
            word, context = x.word[c.ids], x.context[c.previous]
            base = np.log10((word + 1) / (n + v + 1))
            w = weights[bucket_of(context)]
            p = w[:, 0] / (v + 1) + w[:, 1] * word / max(1, n) + w[:, 2] * x.pair / np.maximum(context, 1)
            at = lambda a: np.add.reduceat(a, c.starts)  # noqa: E731, B023
            columns = {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "held_out": pa.array(c.folds == HELD_OUT),
                "n_tokens": pa.array(c.sizes.astype(np.int64)),
                "n_known": pa.array(at((word > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(c.sizes), n, np.int64)),
                "base_score": pa.array(at(base)),
                "score": pa.array(at(np.log10(p))),
            }
            out.append(pa.table(columns))
        return pa.concat_tables(out)

    return model.over_chunks(each, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(fit(documents(spark, sf_dir)))
