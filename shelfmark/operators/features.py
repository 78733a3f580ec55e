"""Items as sparse TF-IDF vectors and scaled attributes, in long form (item_id, feature, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import is_token, plain, words

MIN_DF, MAX_DF = 5, 0.95


def term_counts(items: DataFrame, text: str = "text") -> DataFrame:
    """(item_id, term, tf). Words are counted before they are judged, so the patterns run once a distinct word of an item, in generated code."""
    found = items.select("item_id", F.explode(words(F.col(text))).alias("term")).filter(F.length("term") > 2)
    return found.groupBy("item_id", "term").agg(F.count("*").alias("tf")).filter(is_token(F.col("term")))


def second_stop_words(spark) -> list[str]:
    """Spark's own English stop words, for a stop list on top of the one of the text cleaning."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english") if spark else []


def vocabulary(counts: DataFrame, n_items: int, min_df: int = MIN_DF, max_df: float = MAX_DF, stop: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(term, df, idf) with smooth idf ln((1 + n) / (1 + df)) + 1; without the words of ``stop``, and only the ``most`` frequent terms if given."""
    if stop:
        counts = counts.filter(~F.col("term").isin(stop))
    if most is not None:
        kept = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_items))
        counts = counts.join(kept.orderBy(F.desc("n"), "term").limit(most).select("term"), "term", "left_semi")
    # Counts are looked at, so that this plan has all the columns of the one that joins it and reads the same shuffled rows.
    df = counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_items))
    return df.withColumn("idf", F.log(F.lit(1.0 + n_items) / (1.0 + F.col("df"))) + 1)


def raw_weights(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(item_id, term, w): TF-IDF before rows are brought to unit length."""
    return counts.join(vocab, "term").select("item_id", "term", (F.col("tf") * F.col("idf")).alias("w"))


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows of unit length. The norm is an aggregate over the item, co-partitioned with the weights."""
    raw = raw_weights(counts, vocab)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("item_id")))
    return raw.select("item_id", F.col("term").alias("feature"), (F.col("w") / norm).alias("weight"))


def min_max(items: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1; a constant column, and a missing value, is 0."""
    ends = items.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = items.join(F.broadcast(ends))  # one row
    return scaled.select("item_id", *[F.coalesce((F.col(c) - F.col(f"_lo_{c}")) / F.expr(f"nullif(_hi_{c} - _lo_{c}, 0)"), F.lit(0.0)).alias(c) for c in columns])


def fuse(weights: DataFrame, scaled: DataFrame) -> DataFrame:
    """TF-IDF beside attributes; attribute features are named with two leading underscores."""
    names = [c for c in scaled.columns if c != "item_id"]
    rows = F.array(*[F.struct(F.lit(f"__{c}").alias("feature"), F.col(c).alias("weight")) for c in names])
    return weights.unionByName(scaled.select("item_id", F.inline(rows)).filter("weight <> 0"))


def top_keywords(weights: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc(F.round("weight", 6)), "feature")
    words = weights.filter(~F.col("feature").startswith("__"))
    return words.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)


def density(weights: DataFrame, n_items: int) -> DataFrame:
    counts = weights.filter("weight <> 0").agg(F.count("*").alias("nnz"), F.countDistinct("feature").alias("n_features"))
    return counts.select(F.lit(n_items).cast("long").alias("n_items"), "n_features", "nnz", F.round(F.col("nnz") / (n_items * F.col("n_features")), 8).alias("density"))


def flat_categories(df: DataFrame, key: str = "item_id", column: str = "categories") -> DataFrame:
    """(key, category): a row a category of a list; rows without any are left out."""
    return df.select(key, F.explode(column).alias("category"))


def attribute_checks(scaled: DataFrame) -> DataFrame:
    """(attribute, n, n_missing, least, greatest, ok): scaled attributes have to lie within 0 and 1."""
    names = [c for c in scaled.columns if c != "item_id"]
    facts = [F.struct(F.lit(c).alias("attribute"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.min(c).alias("least"), F.max(c).alias("greatest")) for c in names]
    rows = scaled.agg(F.array(*facts).alias("rows")).select(F.inline("rows"))
    return rows.withColumn("ok", (F.col("n_missing") == 0) & F.coalesce((F.col("least") >= 0) & (F.col("greatest") <= 1), F.lit(False)))


#: The older representation: characters of a description, least and most documents of a term, terms kept.
OLDER_LENGTH, OLDER_MIN_DF, OLDER_TERMS = 2000, 2, 40_000


def older_corpus(items: DataFrame, columns: list[str], long: str = "description") -> DataFrame:
    """(item_id, text): the text columns that are there, prepared one by one and joined by spaces."""
    parts = [plain(F.col(c), OLDER_LENGTH if c == long else None) for c in columns if c in items.columns]
    return items.select("item_id", F.concat_ws(" ", *parts).alias("text"))


def older_counts(corpus: DataFrame) -> DataFrame:
    """(item_id, term, tf) of words of two plain letters at least; letters with marks and digits belong to a word, which is then left out."""
    found = corpus.select("item_id", F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))).alias("term"))
    return found.groupBy("item_id", "term").agg(F.count("*").alias("tf")).filter(F.col("term").rlike("^[a-zA-Z]{2,}$"))


def standardised(items: DataFrame, columns: list[str]) -> DataFrame:
    """(item_id, columns): text that is no number and gaps become the median, then mean 0 and population deviation 1 (0 if constant)."""
    cast = items.select("item_id", *[F.col(c).try_cast("double").alias(c) for c in columns])
    middle = cast.agg(*[F.percentile(c, F.lit(0.5)).alias(f"_{c}") for c in columns])
    filled = cast.join(F.broadcast(middle)).select("item_id", *[F.coalesce(c, f"_{c}").alias(c) for c in columns])  # one row
    ends = filled.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = [F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.expr(f"nullif(_s_{c}, 0)"), F.lit(0.0)).alias(c) for c in columns]
    return filled.join(F.broadcast(ends)).select("item_id", *scaled)


def idf_ends(vocab: DataFrame, n: int = 10) -> DataFrame:
    """(side, rank, term, idf): the n terms of lowest and of highest idf, ties by term; two top-k queries."""
    def side(name: str, *order) -> DataFrame:
        top = vocab.select("term", "idf").orderBy(*order).limit(n)
        place = F.row_number().over(Window.orderBy(*order)).cast("long")  # n rows
        return top.select(F.lit(name).alias("side"), place.alias("rank"), "term", "idf")

    return side("lowest", F.asc("idf"), "term").union(side("highest", F.desc("idf"), "term"))


def corpus_facts(corpus: DataFrame, weights: DataFrame) -> DataFrame:
    """(n_items, tokens_avg, tokens_median, n_features, nnz, density, sparsity_pct): what a corpus and its matrix look like."""
    size = F.regexp_count("text", F.lit(r"\S+"))
    lengths = corpus.agg(F.count("*").alias("n_items"), F.round(F.avg(size), 1).alias("tokens_avg"), F.round(F.percentile(size, F.lit(0.5)), 1).alias("tokens_median"))
    matrix = weights.agg(F.countDistinct("feature").alias("n_features"), F.count("*").alias("nnz"))
    cells = F.expr("nullif(n_items * n_features, 0)")
    both = lengths.join(F.broadcast(matrix))  # one row each
    share = F.col("nnz") / cells
    return both.select("*", F.round(share, 6).alias("density"), F.round(100 * (1 - share), 2).alias("sparsity_pct"))
