"""Artifacts on disk: splits, matrices in long form, vocabulary, recommendations, reports and a journal."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.manifest import _path, exists

SCIPY_CSR = ("data", "indices", "indptr")


def write_once(df: DataFrame, path: str) -> bool:
    """Write Parquet unless a finished output is there; whether it was written."""
    if exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def column_probe(df: DataFrame) -> DataFrame:
    """(column, type, n_null, n_distinct_about): a row a column, in one pass. A declared schema leaves no mixed types within one."""
    kinds = dict(df.dtypes)
    plain = {c: F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in kinds.items()}
    nulls = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    about = [F.approx_count_distinct(plain[c]).alias(f"d{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*nulls, *about)
    facts = lambda i, c: (F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(f"n{i}").alias("n_null"), F.col(f"d{i}").alias("n_distinct_about"))
    rows = [F.struct(*facts(i, c)) for i, c in enumerate(df.columns)]
    return one.select(F.inline(F.array(*rows)))


def save_joined(df: DataFrame, path: str) -> DataFrame:
    """Write the joined rows as Parquet and return the probe of what was written."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return column_probe(df.sparkSession.read.parquet(path))


def save_split(df: DataFrame, path: str) -> None:
    """Train and test rows (column ``split``) in one pass, a folder each."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One part of a saved split; the other folder isn't read."""
    return spark.read.parquet(path).filter(F.col("split") == part).drop("split")


def save_matrix(cells: DataFrame, path: str, **ids: DataFrame) -> None:
    """A sparse matrix as its cells in long form, and id tables beside it."""
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    for name, table in ids.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_matrix(spark: SparkSession, path: str, name: str = "cells") -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def read_numpy(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value) of arrays saved as .npy, or as a compressed sparse row matrix in .npz; pickled objects are refused.

    A file is one array, so it is one row of a binary scan and is opened by one task; several files are read side by side, and
    ``file`` tells them apart.
    """

    def cells(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.load(io.BytesIO(raw), allow_pickle=False)
                if isinstance(found, np.ndarray):
                    full = np.atleast_2d(found)
                    r, c = np.nonzero(full)
                    v = full[r, c]
                else:
                    v, c, starts = (found[k] for k in SCIPY_CSR)
                    r = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                columns = [pa.array([name] * len(v), pa.string()), pa.array(r.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(v.astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "row", "column", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cells, "file string, row long, column long, value double")


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """One term a line; part files and their lines are in alphabetical order."""
    vocab.select("term").distinct().orderBy("term").write.mode("overwrite").text(path)


def save_recommendations(recs: DataFrame, titles: DataFrame, path: str, unknown: str = "") -> None:
    """(user_id, rank, item_id, score, title); items without a title get ``unknown``. Ids stand in for row numbers of matrices."""
    named = recs.join(titles, "item_id", "left").withColumn("title", F.coalesce("title", F.lit(unknown)))
    named.select("user_id", "rank", "item_id", "score", "title").write.mode("overwrite").parquet(path)


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text from the driver, in any store that Spark writes."""
    fs, where = _path(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def save_json(spark: SparkSession, report: dict, path: str) -> None:
    save_text(spark, json.dumps(report, indent=2, sort_keys=True, default=str, ensure_ascii=False), path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def truthy(value: object) -> bool:
    """A flag of a report as a boolean: itself, or one of the words for yes."""
    # The words that count as yes.
    return value if isinstance(value, bool) else str(value).strip().lower() in {"true", "yes", "1", "ok", "passed"}
