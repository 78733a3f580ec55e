"""Reading sources, and the tables of the test data as interactions, catalogue and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType, StructField, StructType

#: Points for each kind of event.
EVENT_RATING = {"purchase": 5.0, "signup": 4.0, "click": 3.0, "view": 2.0, "error": 1.0}
#: A unique order of order lines; (order, line) alone is not unique.
LINE_KEY = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as interactions: who ordered which part, rated 1 to 5 by quantity."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    rating = (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double")
    return joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), rating.alias("rating"), F.col("o_orderdate").alias("ts"), *LINE_KEY)


def event_interactions(spark: SparkSession, sf_dir: str, items: str) -> DataFrame:
    """Events as interactions with the rows of another table, by id modulo its size (a count from file footers)."""
    n = table(spark, sf_dir, items).count()
    rating = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_RATING.items()], F.lit(1.0))
    return table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % n).alias("item_id"), rating.alias("rating"), "ts", "event_id")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a nested catalogue; every seventeenth part is missing from it."""
    part = table(spark, sf_dir, "part").filter("p_partkey % 17 <> 0")
    author = F.when(F.col("p_size") % 3 != 0, F.struct(F.col("p_brand").alias("name")))
    details = F.struct(F.col("p_brand").alias("Publisher"), F.when(F.col("p_size") % 5 != 0, F.lit("English")).alias("Language"))
    price = F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice"))
    return part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("categories"), author.alias("author"), details.alias("details"), price.alias("price"))


def read_jsonl(spark: SparkSession, path: str, fields: list[str], numeric: list[str]) -> DataFrame:
    """JSON lines with a declared schema; numeric columns are read as text and cast with bad values as null."""
    schema = StructType([StructField(f, StringType()) for f in fields])
    raw = spark.read.schema(schema).json(path)
    return raw.select(*[F.col(f).try_cast(DoubleType()).alias(f) if f in numeric else F.col(f) for f in fields])


def non_blank_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.trim("value") != "").count()


def verify_conversion(source: DataFrame, target: DataFrame) -> dict[str, bool]:
    """Row count, column names, and null-safe equality of all rows both ways."""
    same_names = set(source.columns) == set(target.columns)
    cols = sorted(source.columns)
    equal = same_names and source.select(cols).exceptAll(target.select(cols)).isEmpty() and target.select(cols).exceptAll(source.select(cols)).isEmpty()
    return {"rows": source.count() == target.count(), "columns": same_names, "values": equal}


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", *partition_by: str) -> None:
    """Snappy Parquet; mode ``ignore`` leaves a finished output alone."""
    df.write.mode(mode).option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def flat_columns(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if not isinstance(f.dataType, ArrayType | MapType | StructType)])


def tolerant_select(df: DataFrame, allowed: list[str]) -> DataFrame:
    return df.select(*[c for c in allowed if c in df.columns])
