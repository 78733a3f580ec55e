"""Joining interactions to the catalogue, normalising nested columns, and data-quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the pattern of markup left in text.
HTML_NOISE = r"<[^>]+>|&[a-zA-Z]+;|&#\d+;"
#: What to do about a column's missing values.
STRATEGY = {"key": "drop row", "text": "empty string", "number": "median"}


def first_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def joined_list(column: str, sep: str = " | ") -> Column:
    return F.coalesce(F.concat_ws(sep, F.filter(column, lambda x: x.isNotNull() & (x != ""))), F.lit(""))


def struct_field(column: str, key: str, missing: str = "None") -> Column:
    """A field as text; an absent struct is empty, an absent field of a present struct is ``missing``."""
    return F.when(F.col(column).isNull(), "").otherwise(F.coalesce(F.col(column)[key].cast("string"), F.lit(missing)))


def join_catalogue(df: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Left join, rows without a key dropped first, with nested columns flat and prices filled with the median of the joined rows."""
    out = df.filter(F.col(key).isNotNull()).join(first_by(items, key, "title"), key, "left")
    flat = {
        "title": F.coalesce("title", F.lit("")),
        "categories": joined_list("categories"),
        "author_name": struct_field("author", "name"),
        "details_publisher": struct_field("details", "Publisher"),
        "details_language": struct_field("details", "Language"),
    }
    out = out.withColumns(flat).drop("author", "details")
    median = out.agg(F.percentile("price", F.lit(0.5))).first()[0]
    return out.withColumn("price", F.coalesce("price", F.lit(median).cast("double")))


def join_quality(df: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Coverage of rows and of distinct keys, each side; the join itself isn't made."""
    ours = df.groupBy(key).agg(F.count("*").alias("n"))
    theirs = items.select(key).distinct().withColumn("there", F.lit(1))
    both = ours.join(theirs, key, "full_outer")
    n = lambda c, v=1: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    here, there = F.col("n").isNotNull(), F.col("there").isNotNull()
    out = both.agg(
        n(here, F.col("n")).alias("rows_total"),
        n(here & there, F.col("n")).alias("rows_matched"),
        n(here).alias("keys_total"),
        n(here & there).alias("keys_matched"),
        n(here & ~there).alias("keys_orphan"),
        n(~here).alias("catalogue_unused"),
    )
    out = out.withColumns({"rows_unmatched": F.col("rows_total") - F.col("rows_matched"), "catalogue_keys": F.col("keys_matched") + F.col("catalogue_unused")})
    ratio = lambda a, b: F.round(F.col(a) / F.expr(f"nullif({b}, 0)"), 6)
    return out.withColumns({"row_coverage": ratio("rows_matched", "rows_total"), "key_coverage": ratio("keys_matched", "keys_total"), "catalogue_used": ratio("keys_matched", "catalogue_keys")})


def _empty(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.size(c) == 0 if kind.startswith("array") else F.trim(c) == "" if kind == "string" else F.lit(False)


def missingness(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """A row a column: null, empty and effective counts and percentages, and what to do. One pass. Absent columns have null counts."""
    here = [c for c in kinds if c in df.columns]
    counts = [F.count_if(F.col(c).isNull()).alias(f"{c}_n") for c in here] + [F.count_if(F.col(c).isNotNull() & _empty(df, c)).alias(f"{c}_e") for c in here]
    one = df.agg(F.count("*").alias("_rows"), *counts)
    none = F.lit(None).cast("long")
    row = lambda c, k: F.struct(
        F.lit(c).alias("column"),
        (F.col(f"{c}_n") if c in here else none).alias("n_null"),
        (F.col(f"{c}_e") if c in here else none).alias("n_empty"),
        F.lit(STRATEGY[k] if c in here else "absent").alias("strategy"),
    )
    pct = lambda c: F.round(100.0 * c / F.expr("nullif(_rows, 0)"), 4)
    rows = one.select("_rows", F.inline(F.array(*[row(c, k) for c, k in kinds.items()])))
    return rows.select(
        "column", "n_null", pct(F.col("n_null")).alias("null_pct"), "n_empty", pct(F.col("n_empty")).alias("empty_pct"), pct(F.col("n_null") + F.col("n_empty")).alias("effective_pct"), "strategy"
    )


def missingness_strategy(report: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """The report with the reason for each column's strategy; ``-`` where none is given. The lookup has a row a column."""
    if not reasons:
        return report.withColumn("reason", F.lit("-"))
    lookup = F.create_map(*[F.lit(x) for pair in reasons.items() for x in pair])
    return report.withColumn("reason", F.coalesce(F.try_element_at(lookup, F.col("column")), F.lit("-")))


def schema_checks(df: DataFrame, name: str, required: list[str], key: str = "item_id") -> DataFrame:
    """One row: required columns that are missing, the key as text (how many values that changes), missing keys."""
    absent = missing_columns(df, required)
    head = [F.lit(name).alias("name"), F.array(*[F.lit(c) for c in absent]).cast("array<string>").alias("missing"), F.lit(not absent).alias("ok")]
    if key not in df.columns:
        return df.agg(F.count("*").alias("n_rows")).select(
            *head,
            "n_rows",
            *[F.lit(None).cast(t).alias(c) for c, t in (("n_missing_keys", "long"), ("missing_key_pct", "double"), ("n_changed", "long"))],
        )
    text = F.col(key).cast("string")
    changed = F.count_if(F.col(key).isNotNull() & ~text.try_cast(dict(df.dtypes)[key]).eqNullSafe(F.col(key)))
    out = df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(key).isNull()).alias("n_missing_keys"), changed.alias("n_changed"))
    pct = F.coalesce(F.round(100.0 * F.col("n_missing_keys") / F.expr("nullif(n_rows, 0)"), 6), F.lit(0.0))
    return out.select(*head, "n_rows", "n_missing_keys", pct.alias("missing_key_pct"), "n_changed")


def column_selection(df: DataFrame, wanted: dict[str, str], reasons: dict[str, str]) -> DataFrame:
    """(column, kept, kind, reason): the columns that are there, which of them are used, as what, and why (``wanted``: column to kind)."""
    rows = [(c, c in wanted, wanted.get(c), reasons.get(c, "" if c in wanted else "out of scope")) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, kept boolean, kind string, reason string")


KEYS = ("user_id", "item_id", "rating", "ts")


def clean_joined(df: DataFrame, *order: Column | str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows with all ``keys``, and of each (user, item) the first in ``order`` (the most recent first, in a total order)."""
    rows = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    place = F.row_number().over(Window.partitionBy("user_id", "item_id").orderBy(*order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def clean_joined_report(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows, users and items before and after ``clean_joined``, and rows dropped by reason. No row is sorted for it."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    pairs = df.groupBy("user_id", "item_id").agg(F.count("*").alias("n"), F.count_if(whole).alias("good"))
    kept = F.col("good") > 0
    out = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.countDistinct("user_id").alias("users_before"), F.countDistinct("item_id").alias("items_before"),
        F.count_if(kept).alias("rows_after"), F.countDistinct(F.when(kept, F.col("user_id"))).alias("users_after"), F.countDistinct(F.when(kept, F.col("item_id"))).alias("items_after"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("_good"),
    )
    return out.withColumns({"dropped_missing_key": F.col("rows_before") - F.col("_good"), "dropped_duplicates": F.col("_good") - F.col("rows_after")}).drop("_good")


def lost_items(before: DataFrame, after: DataFrame, key: str = "item_id") -> DataFrame:
    """(items_before, items_after, items_lost, items_lost_pct, ok)"""
    a = before.filter(F.col(key).isNotNull()).select(key).distinct()
    b = after.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_there", F.lit(True))
    out = a.withColumn("_was", F.lit(True)).join(b, key, "full_outer")
    counts = out.agg(F.count("_was").alias("items_before"), F.count("_there").alias("items_after"), F.count_if(F.col("_was").isNotNull() & F.col("_there").isNull()).alias("items_lost"))
    pct = F.coalesce(F.round(100.0 * F.col("items_lost") / F.expr("nullif(items_before, 0)"), 4), F.lit(0.0))
    return counts.select("*", pct.alias("items_lost_pct"), (F.col("items_lost") == 0).alias("ok"))


def rating_validation(df: DataFrame, low: float = 1.0, high: float = 5.0) -> DataFrame:
    r = F.nanvl("rating", F.lit(None).cast("double"))
    out = F.sum(F.when(~r.between(low, high), 1).otherwise(0)).cast("long")
    return df.agg(
        F.count(r).alias("n"),
        F.min(r).alias("min"),
        F.max(r).alias("max"),
        F.round(F.avg(r), 4).alias("mean"),
        F.percentile(r, F.lit(0.5)).alias("median"),
        out.alias("n_out"),
        F.round(100.0 * out / F.count(r), 4).alias("pct_out"),
    )


def as_time(column: str, kind: str) -> Column:
    """Numbers are seconds since 1970, or milliseconds above 1e12; text is parsed; what doesn't convert is null."""
    c = F.col(column)
    if kind == "string":
        return c.try_cast("timestamp_ntz")
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return c.cast("timestamp_ntz")
    seconds = F.when(c > 1e12, c / 1000).otherwise(c).cast("double")
    fits = F.abs(seconds) < 253_402_300_800  # up to the year 9999
    return F.timestamp_micros(F.when(fits, seconds * 1_000_000).cast("long")).cast("timestamp_ntz")


def timestamp_validation(df: DataFrame, first: int = 2000, last: int = 2026, column: str = "ts") -> DataFrame:
    """Values, first and last time and year, years out of range, and values that are there but don't convert.

    Numbers count as milliseconds if the greatest of them is above 1e12, as seconds otherwise; here that is decided row by row.
    """
    t = as_time(column, dict(df.dtypes)[column])
    y = F.year(t).cast("long")
    return df.agg(
        F.count(column).alias("n"), F.min(t).alias("min_time"), F.max(t).alias("max_time"), F.min(y).alias("min_year"), F.max(y).alias("max_year"),
        F.count_if(y < first).alias("n_before"), F.count_if(y > last).alias("n_after"), F.count_if(F.col(column).isNotNull() & t.isNull()).alias("n_bad"),
    ).withColumn("ok", (F.col("n_before") + F.col("n_after") + F.col("n_bad") == 0) & F.col("min_year").isNotNull())


def text_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a text column: non-null, blank (share of all rows), length statistics, markup (share of non-null)."""
    def one(c: str) -> DataFrame:
        size, n = F.char_length(c), lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("long")
        return df.agg(
            F.lit(c).alias("column"),
            F.count(c).alias("n"),
            F.round(100.0 * n(F.trim(c) == "") / F.count("*"), 4).alias("pct_blank"),
            F.round(F.avg(size), 1).alias("avg_len"),
            F.min(size).cast("long").alias("min_len"),
            F.max(size).cast("long").alias("max_len"),
            F.floor(F.percentile(size, F.lit(0.5))).cast("long").alias("median_len"),
            F.round(100.0 * n(F.col(c).rlike(HTML_NOISE)) / F.count(c), 4).alias("pct_html"),
        )

    return reduce(DataFrame.union, [one(c) for c in columns])


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def post_clean_checks(df: DataFrame, items: DataFrame, low: float = 1.0, high: float = 5.0, key: str = "item_id") -> DataFrame:
    """What cleaning should have left at zero: repeated pairs, ratings out of range, items not in the catalogue, nulls."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    bad = F.coalesce(~F.col("rating").between(low, high), F.lit(False))
    null = F.col("user_id").isNull() | F.col(key).isNull() | F.col("rating").isNull()
    pairs = df.groupBy("user_id", key).agg(F.count("*").alias("_n"), n(bad).alias("_bad"), n(null).alias("_null"))
    found = pairs.join(items.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    orphan = F.when(F.col("_known").isNull(), F.col("_n")).otherwise(0)
    return found.agg(total(F.col("_n") - 1).alias("repeated"), total("_bad").alias("bad_ratings"), total(orphan).alias("orphans"), total("_null").alias("nulls"))
