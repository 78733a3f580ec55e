"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed as a whole once with each dictionary. Its feature is (bytes with the bad one - bytes with the good
one) / (bytes of the text + SMOOTH): text like the good examples is shorter with their dictionary. A logistic curve,
fitted on labelled texts that the dictionaries haven't seen, turns the feature into a probability of label 1.

Bounds: ``dictionary_rows`` texts a label train the dictionaries, ``calibration_rows`` texts a label fit the curve; both
are the first in the order of a hash of their ids. Of a dictionary text ``PIECES_A_TEXT`` pieces of ``PIECE`` bytes take part, spread
evenly over all of it; with every piece the very long texts crowd out the rest. Calibration and scoring compress whole texts.
Piece and number were chosen by scoring one training fold with a model of the other three.

Defined cases: a null text is the empty text; an empty text has feature 0; null labels and labels without a text are
skipped; a repeated label counts again; with one label or none the score is that label's rate (0.5 without any);
other columns aren't looked at and stay, but for one named like ``out_col``.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shelfmark.llm.common import documents, first_ids, fold, text_of

DICTIONARY_ROWS, CALIBRATION_ROWS = 1000, 1000
DICTIONARY_BYTES, PIECE, PIECES_A_TEXT, LEVEL, SMOOTH, THRESHOLD = 262_144, 256, 4, 3, 64, 0.3


def train_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of pieces spread evenly over each text; raw content if they are too few to train on."""
    pieces = []
    for t in texts:
        n = -(-len(t) // PIECE)
        pieces += [t[i * PIECE : (i + 1) * PIECE] for i in np.unique(np.linspace(0, n - 1, min(n, PIECES_A_TEXT)).astype(int))] if n else []
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(pieces)[-size:] or b"\n" * 8


class Compressors:
    """Both dictionaries, made ready once a process."""

    def __init__(self, good: bytes, bad: bytes):
        self.raw, self.ready = (good, bad), None

    def __getstate__(self):
        return {"raw": self.raw, "ready": None}

    def feature(self, text: bytes) -> float:
        if self.ready is None:
            self.ready = []
            for raw in self.raw:
                made = zstandard.ZstdCompressionDict(raw)
                made.precompute_compress(level=LEVEL)
                self.ready.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False))
        if not text:
            return 0.0
        good, bad = (len(c.compress(text)) for c in self.ready)
        return (bad - good) / (len(text) + SMOOTH)


def fit_curve(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a slight ridge.

    The sample is balanced by label; weights bring the labels back to ``prior``, the rate among the labelled rows.
    """
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return 0.0, math.log(rate / (1 - rate))
    w = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (w * (y - p)) - 1e-3 * beta
        h = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(labelled: DataFrame, dictionary_rows: int = DICTIONARY_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> tuple[Compressors, float, float]:
    """(id, text, label) -> compressors, slope, offset. Collects a bounded sample only.

    Ids are chosen before any text is read; the texts are then asked for by a list of ids, which reaches every scan below, so
    no other text is moved. Of the texts that share a chosen id and a label the least takes part.
    """
    labelled = labelled.filter("label in (0, 1) and id is not null")
    picks = first_ids(labelled.select("id", F.col("label").cast("int").alias("label")), "label", dictionary_rows + calibration_rows)
    total, ones = labelled.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    ids = [i for chosen in picks.values() for i in chosen]
    chosen = labelled.filter(F.col("id").isin(ids)).groupBy("id", "label").agg(F.min(text_of()).alias("text")).collect() if ids else []
    rows = sorted((zlib.crc32(str(r["id"]).encode()), r["id"], int(r["label"]), r["text"].encode()) for r in chosen)
    sample = {label: [t for _, _, x, t in rows if x == label] for label in (0, 1)}
    parts = {}
    for label, texts in sample.items():
        cutoff = min(dictionary_rows, (len(texts) + 1) // 2)
        parts[label] = (texts[:cutoff], texts[cutoff:] or texts)
    model = Compressors(*(train_dictionary(parts[label][0]) for label in (1, 0)))
    x = np.array([model.feature(t) for label in (0, 1) for t in parts[label][1]])
    y = np.array([label for label in (0, 1) for _ in parts[label][1]], dtype=float)
    slope, offset = fit_curve(x, y, ones / total if total else 0.5)
    return model, slope, offset


def score_quality(docs: DataFrame, model: tuple[Compressors, float, float], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``: the probability that a text is of label 1; a column of that name gives way to it."""
    compressors, slope, offset = model

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([compressors.feature(t.encode()) for t in texts], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30))))

    return docs.withColumn(out_col, score(text_of(text_col)))


def op10_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).filter(fold("doc_id", 5) != 0)
    model = fit(docs.join(labels, "doc_id").withColumnRenamed("doc_id", "id"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
