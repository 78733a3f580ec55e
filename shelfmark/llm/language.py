"""Language ID by a byte-level convolutional network, trained in numpy.

A text's bytes (lower case, ASCII other than letters as spaces) are cut into windows of ``WINDOW`` bytes; the last window
reaches back so that it is full. Bytes are embedded, filters of several widths slide over them, each filter's largest
response in the window is rectified, and a softmax over languages follows. A text's probabilities are the mean of its
windows', weighted by their bytes other than spaces. All windows of a text count.

Bounds: at most ``sample`` texts a language train the network, the first in the order of a hash of their ids, and each
epoch draws ``WINDOWS_A_TEXT`` windows of each of them at random from all its windows, so that very long texts don't crowd out the
rest. More than ``MAX_LANGUAGES`` labels are refused with an error, as they can't be languages.

Beside the label and its probability a text gets ``known``: the share of its bytes other than spaces that occurred in the
training texts. A text in a script that was never seen has a low one, whatever the softmax makes of it.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no labelled text at all everything is
``und``; ties go to the language first by code point; repeated rows are predicted alike; other columns aren't looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shelfmark.llm.common import documents, first_ids, fold, free, text_of

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4, 5), 8, 8
SAMPLE, WINDOWS_A_TEXT, MAX_LANGUAGES = 400, 4, 2000
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 400, 64, 0.01
UND = "und"

_LETTER = re.compile(r"[^\W\d_]")
_SPACES = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def windows(text: str) -> np.ndarray:
    """(n, WINDOW) bytes."""
    data = text.lower().encode("utf-8", "replace").translate(_SPACES)
    if len(data) < WINDOW:
        data = data.ljust(WINDOW)
    x = np.frombuffer(data, dtype=np.uint8)
    whole = len(x) // WINDOW
    out = x[: whole * WINDOW].reshape(whole, WINDOW)
    return out if whole * WINDOW == len(x) else np.concatenate([out, x[-WINDOW:][None]])


class ByteCNN:
    """Weights: embedding (256, DIM); kernel (widest * DIM, filters), zero beyond a filter's width; biases; output layer."""

    def __init__(self, languages: list[str], seed: int = 42):
        rng = np.random.default_rng(seed)
        self.languages, self.widest = languages, max(WIDTHS)
        self.seen = np.zeros(256, bool)
        n = FILTERS * len(WIDTHS)
        self.mask = np.zeros((self.widest * DIM, n), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)),
            "kernel": rng.normal(0, 0.3, self.mask.shape) * self.mask,
            "bias": np.zeros(n),
            "out": rng.normal(0, 0.1, (n, max(1, len(languages)))),
            "shift": np.zeros(max(1, len(languages))),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def responses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patches (n, places, widest * DIM) and the filters' responses (n, places, filters)."""
        e = self.p["embed"][x].reshape(len(x), WINDOW * DIM)
        places = WINDOW - self.widest + 1
        patches = np.lib.stride_tricks.as_strided(e, (len(x), places, self.widest * DIM), (e.strides[0], DIM * e.itemsize, e.itemsize))
        flat = np.ascontiguousarray(patches).reshape(-1, self.widest * DIM)
        return patches, (flat @ self.p["kernel"]).reshape(len(x), places, -1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        _, r = self.responses(x)
        return self._softmax(np.maximum(r.max(1) + self.p["bias"], 0))

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.p["out"] + self.p["shift"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        patches, r = self.responses(x)
        at = r.argmax(1)  # (n, filters)
        rows = np.arange(len(x))[:, None]
        pooled = np.maximum(r[rows, at, np.arange(at.shape[1])[None]] + self.p["bias"], 0)
        d = self._softmax(pooled)
        d[np.arange(len(x)), y] -= 1
        d /= len(x)
        back = (d @ self.p["out"].T) * (pooled > 0)  # (n, filters)
        best = patches[rows, at]  # (n, filters, widest * DIM)
        spread = (back[:, :, None] * (self.p["kernel"] * self.mask).T[None]).reshape(-1, DIM)
        places = x[rows[:, :, None], at[:, :, None] + np.arange(self.widest)[None, None]].reshape(-1)
        embed = np.stack([np.bincount(places, spread[:, i], minlength=256) for i in range(DIM)], 1)
        return {"embed": embed, "kernel": np.einsum("nf,nfk->kf", back, best) * self.mask, "bias": back.sum(0), "out": pooled.T @ d, "shift": d.sum(0)}

    def train(self, texts: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> ByteCNN:
        """Adam on shuffled batches with a rate that falls to zero; each epoch draws its windows of each text anew. Few texts get
        as many epochs as make ``LEAST_STEPS`` steps."""
        for w in texts:
            self.seen[np.unique(w)] = True
        self.seen[32] = True
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        y = np.repeat(labels, [min(len(w), WINDOWS_A_TEXT) for w in texts])
        epochs = max(epochs, -(-LEAST_STEPS // -(-len(y) // BATCH)))
        steps = epochs * -(-len(y) // BATCH)
        for _ in range(epochs):
            x = np.concatenate([w[rng.permutation(len(w))[:WINDOWS_A_TEXT]] for w in texts])
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                pick = order[i : i + BATCH]
                t += 1
                rate = RATE * (1 - (t - 1) / steps)
                for k, g in self.gradients(x[pick], y[pick]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[str | None], chunk: int = 128) -> list[tuple[str, float, float]]:
        """(label, its probability, share of known bytes) of each text."""
        out: list[tuple[str, float, float]] = [(UND, 0.0, 0.0)] * len(texts)
        wanted = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        held, size = [], 0

        def flush() -> None:
            if not held:
                return
            x = np.concatenate([w for _, w in held])
            p = np.concatenate([self.probabilities(x[i : i + chunk]) for i in range(0, len(x), chunk)]).astype(np.float64)
            weight = (x != 32).sum(1) + 1e-6
            known = (self.seen[x] & (x != 32)).sum(1)
            ends = np.cumsum([len(w) for _, w in held])
            starts = np.concatenate(([0], ends[:-1]))
            total = np.add.reduceat(weight, starts)
            sums = np.add.reduceat(p * weight[:, None], starts, axis=0) / total[:, None]
            for (i, _), q, k in zip(held, sums, np.add.reduceat(known, starts) / total, strict=True):
                out[i] = (self.languages[int(q.argmax())], float(min(1.0, q.max())), float(min(1.0, k)))
            held.clear()

        for i in wanted:
            w = windows(texts[i])
            held.append((i, w))
            size += len(w)
            if size >= 4096:
                flush()
                size = 0
        flush()
        return out


def fit(labelled: DataFrame, sample: int = SAMPLE) -> ByteCNN:
    """(id, text, lang) -> a trained network, from a bounded sample."""
    labelled = labelled.filter("lang is not null and text is not null and id is not null")
    picks = first_ids(labelled.select("id", "lang"), "lang", sample, MAX_LANGUAGES)
    languages = sorted(picks)
    model = ByteCNN(languages)
    ids = [i for chosen in picks.values() for i in chosen]
    rows = labelled.filter(F.col("id").isin(ids)).groupBy("id", "lang").agg(F.min("text").alias("text")).collect() if ids else []
    chosen = [r for r in sorted(rows, key=lambda r: (r["lang"], r["id"])) if _LETTER.search(r["text"])]
    return model.train([windows(r["text"]) for r in chosen], [languages.index(r["lang"]) for r in chosen]) if chosen else model


def identify(docs: DataFrame, model: ByteCNN, text_col: str = "text", out_col: str = "_language") -> DataFrame:
    """``docs`` with ``out_col``: struct(lang, score, known); a column of that name gives way to it."""

    @pandas_udf("lang string, score double, known double")
    def language(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.predict(texts.tolist()), columns=["lang", "score", "known"])

    return docs.withColumn(out_col, language(text_of(text_col)))


def keep_known(docs: DataFrame, model: ByteCNN, least_known: float, least_score: float = 0.0) -> DataFrame:
    """``docs`` without those that are ``und``, mostly of bytes that were never seen, or of too low a probability."""
    name = free(docs.columns, "_language")
    found = identify(docs, model, out_col=name)
    ok = (F.col(name)["lang"] != UND) & (F.col(name)["known"] >= least_known) & (F.col(name)["score"] >= least_score)
    return found.filter(ok).select(docs.columns)


def learn(docs: DataFrame, id_col: str = "doc_id") -> ByteCNN:
    return fit(docs.filter(fold(id_col, 3) != 1).select(F.col(id_col).alias("id"), "text", "lang"))


def op7_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"))
