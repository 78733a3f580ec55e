"""Named sources: where they lie, whether they are there, what they hold, and loading them as one.

Paths are looked at through Hadoop's file systems, so any store that Spark reads will do; globs work everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SINGLE, UNION = "single", "union"


def _path(spark: SparkSession, path: str):
    """(file system, Path) of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """What a glob finds, sorted; nothing found is an empty list."""
    fs, where = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(where) or [])


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def size_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder; 0 if it isn't there."""
    fs, where = _path(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this process wrote."""
    fs, where = _path(spark, path)
    fs.delete(where, True)


def usable_paths(spark: SparkSession, paths: Iterable[str], least_bytes: int = 1024) -> list[str]:
    """The paths that are there, hold ``least_bytes`` at least and, read as Parquet, a row at least."""
    large = [p for p in paths if size_bytes(spark, p) >= least_bytes]
    return [p for p in large if not spark.read.parquet(p).isEmpty()]


@dataclass(frozen=True)
class Source:
    """A named source: one path, or a train and a test path that are read as one."""

    name: str
    role: str
    paths: tuple[str, ...]
    stage: str = "raw"
    variant: str = ""
    required: tuple[str, ...] = field(default=())

    @property
    def kind(self) -> str:
        return SINGLE if len(self.paths) == 1 else UNION

    def load(self, spark: SparkSession, columns: list[str] | None = None) -> DataFrame:
        """All paths' rows with the columns that all of them have, or with those of ``columns`` that all have."""
        frames = [spark.read.parquet(p) for p in self.paths]
        shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
        wanted = [c for c in columns if c in shared] if columns else shared
        return reduce(DataFrame.unionByName, [f.select(wanted) for f in frames])


def missing_paths(spark: SparkSession, manifest: Iterable[Source]) -> dict[str, list[str]]:
    """For each source the paths that aren't there; an empty list where all are."""
    return {s.name: [p for p in s.paths if not exists(spark, p)] for s in manifest}


def _columns(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(path).columns if exists(spark, path) else []


def document(spark: SparkSession, source: Source) -> dict:
    """Facts about a source: rows (from footers), bytes, shared columns and those that only the first or only the last part has."""
    there = [p for p in source.paths if exists(spark, p)]
    names = [set(_columns(spark, p)) for p in source.paths]
    shared = set.intersection(*names)
    return {
        "name": source.name,
        "role": source.role,
        "stage": source.stage,
        "variant": source.variant,
        "kind": source.kind,
        "found": len(there) == len(source.paths),
        "n_rows": sum(spark.read.parquet(p).count() for p in there),
        "size_bytes": sum(size_bytes(spark, p) for p in there),
        "n_columns": len(shared),
        "shared": sorted(shared),
        "first_only": sorted(names[0] - shared),
        "last_only": sorted(names[-1] - shared),
        "missing": sorted(set(source.required) - shared),
    }


_FACTS = (
    "name string, role string, stage string, variant string, kind string, found boolean, n_rows long, size_bytes long, n_columns int, "
    "shared array<string>, first_only array<string>, last_only array<string>, missing array<string>"
)


def source_facts(spark: SparkSession, manifest: Iterable[Source]) -> DataFrame:
    """A row of facts a source; a manifest is a short list."""
    facts = [document(spark, s) for s in manifest]
    return spark.createDataFrame([tuple(f[k.split()[0]] for k in _FACTS.split(", ")) for f in facts], _FACTS)


def reuse_note(facts: DataFrame, role: str = "interactions") -> DataFrame:
    """What later steps take over as it is, without sampling anew: name, paths' kind and rows of the sources of a role."""
    return facts.filter(F.col("role") == role).select("name", "variant", "kind", "n_rows")


def items_or_fallback(spark: SparkSession, items: str, *fallbacks: str, key: str = "item_id", title: str = "title") -> DataFrame:
    """(key, title) of an item table, or of the first fallback that is there, one row a key (the first title)."""
    for path in (items, *fallbacks):
        if exists(spark, path):
            found = spark.read.parquet(path)
            titles = found.select(key, title) if title in found.columns else found.select(key, F.lit("").alias(title))
            return titles.groupBy(key).agg(F.min(title).alias(title))
    raise FileNotFoundError(f"none of {(items, *fallbacks)}")


def misaligned(matrix: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, side): ids that only the matrix or only the item table has. Empty if both are aligned."""
    a, b = matrix.select(key).distinct(), items.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("matrix")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("items")))
