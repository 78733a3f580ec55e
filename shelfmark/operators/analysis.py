"""Per-user statistics, category shares and quality of recommendation lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.plans.lineage import cut


def user_stats(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Items, mean and sample deviation of ratings (0 for one row), distinct categories, share of the most frequent one (both 0 without any)."""
    base = df.groupBy("user_id").agg(
        F.countDistinct("item_id").alias("n_items"),
        F.round(F.avg("rating"), 6).alias("mean_rating"),
        F.round(F.coalesce(F.stddev_samp("rating"), F.lit(0.0)), 6).alias("std_rating"),
    )
    counts = df.join(labels, "item_id").groupBy("user_id", "category").agg(F.count("*").alias("n"))
    shares = counts.groupBy("user_id").agg(F.count("*").alias("n_categories"), F.round(F.max("n") / F.sum("n"), 6).alias("dominant_ratio"))
    return base.join(shares, "user_id", "left").na.fill(0, ["n_categories"]).na.fill(0.0, ["dominant_ratio"])


def shares(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(user_id, category, n, share)"""
    counts = df.join(labels, "item_id").groupBy("user_id", "category").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))


def top_categories(df: DataFrame, labels: DataFrame, n: int = 3) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "category"))
    top = shares(df, labels).withColumn("rank", place.cast("long")).filter(F.col("rank") <= n)
    return top.select("user_id", "rank", "category", F.round("share", 6).alias("share"))


def representative_users(stats: DataFrame) -> DataFrame:
    """(label, user_id, reason): up to five kinds of user in order of priority, each the first candidate that no earlier kind took.

    Big reader: items at the 0.95 quantile or above, most first. Moderate: nearest to the median. Small: 3 to 5 items, fewest first; if
    there is none, whoever has fewest. Eclectic: categories at the 0.95 quantile or above, most first. Specialised: 0.8 or more of
    the items in one category, most first. Ties go to the smaller id. Each kind is one top-k query over the statistics.
    """
    stats = cut(stats)
    q = stats.agg(
        F.percentile("n_items", F.lit(0.95)).alias("items"), F.percentile("n_items", F.lit(0.5)).alias("middle"), F.percentile("n_categories", F.lit(0.95)).alias("categories")
    ).first()
    few = F.col("n_items").between(3, 5)
    fewest = few if not stats.filter(few).isEmpty() else F.col("n_items") > 0
    fits = lambda c, limit: F.col(c) >= F.lit(limit)
    kinds = [
        ("U1_big_reader", fits("n_items", q["items"]), F.desc("n_items"), f"n_items >= q95 ({q['items'] or 0:.1f})"),
        ("U2_moderate_reader", F.lit(True), F.abs(F.col("n_items") - F.lit(q["middle"])), f"n_items near median ({q['middle'] or 0:.1f})"),
        ("U3_small_reader", fewest, F.asc("n_items"), "n_items 3-5 (or least available)"),
        ("U4_eclectic_reader", fits("n_categories", q["categories"]), F.desc("n_categories"), f"n_categories >= q95 ({q['categories'] or 0:.1f})"),
        ("U5_specialised_reader", fits("dominant_ratio", 0.8), F.desc("dominant_ratio"), "0.8 or more of the items in one category"),
    ]
    used, rows = [], []
    for label, rule, order, reason in kinds:
        free = stats.filter(rule & ~F.col("user_id").isin(used)) if used else stats.filter(rule)
        for r in free.orderBy(order, "user_id").limit(1).select("user_id").collect():
            used.append(r["user_id"])
            rows.append((label, r["user_id"], reason))
    return stats.sparkSession.createDataFrame(rows, f"label string, user_id {stats.schema['user_id'].dataType.simpleString()}, reason string")


def category_overlap(train: DataFrame, recs: DataFrame, labels: DataFrame) -> DataFrame:
    ours = train.join(labels, "item_id").select("user_id", "category").distinct()
    theirs = recs.join(labels, "item_id").select("user_id", "category").distinct().withColumn("hit", F.lit(1))
    met = ours.join(theirs, ["user_id", "category"], "left")
    return met.groupBy("user_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("overlap"))


def intra_list(recs: DataFrame, vectors: DataFrame, dot) -> DataFrame:
    """Mean and largest cosine of a list's pairs. Lists have a fixed length, so pairs do too."""
    rows = recs.join(vectors, "item_id").select("user_id", "rank", "vec")
    other = rows.select("user_id", F.col("rank").alias("rank2"), F.col("vec").alias("vec2"))
    pairs = rows.join(other, "user_id").filter("rank < rank2")
    norm = F.sqrt(dot("vec", "vec")) * F.sqrt(dot("vec2", "vec2"))
    cos = F.coalesce(dot("vec", "vec2") / F.when(norm != 0, norm), F.lit(0.0))
    return pairs.withColumn("c", cos).groupBy("user_id").agg(F.round(F.avg("c"), 6).alias("mean_similarity"), F.round(F.max("c"), 6).alias("max_similarity"))


def concentration(train: DataFrame, recs: DataFrame, labels: DataFrame, limit: float = 0.70) -> DataFrame:
    """Share of a user's most frequent category among the recommendations, and whether it reaches ``limit``."""
    top = top_categories(train, labels, 1).select("user_id", "category")
    have = shares(recs, labels).select("user_id", "category", F.col("share").alias("found"))
    out = top.join(have, ["user_id", "category"], "left").withColumn("concentration", F.round(F.coalesce("found", F.lit(0.0)), 6))
    return out.select("user_id", "category", "concentration", (F.col("concentration") >= limit).alias("over_specialised"))


def hit_rate(recs: DataFrame, test: DataFrame, n: int) -> DataFrame:
    hits = recs.join(test.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi").groupBy("user_id").agg(F.count("*").alias("hits"))
    users = recs.select("user_id").distinct().join(hits, "user_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return users.withColumn("hit_rate", F.round(F.col("hits") / n, 6))


def ranking_metrics(recs: DataFrame, test: DataFrame, n: int) -> DataFrame:
    """Precision, recall and NDCG at n of users with a test row (beyond parity)."""
    wanted = test.select("user_id", "item_id").distinct()
    sizes = wanted.groupBy("user_id").agg(F.count("*").alias("wanted"))
    hits = recs.join(wanted, ["user_id", "item_id"], "left_semi").groupBy("user_id").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    out = sizes.join(hits, "user_id", "left").na.fill(0, ["hits"]).na.fill(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("wanted", F.lit(n)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return out.select("user_id", F.round(F.col("hits") / n, 6).alias("precision"), F.round(F.col("hits") / F.col("wanted"), 6).alias("recall"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def favourite_proximity(train: DataFrame, recs: DataFrame, vectors: DataFrame, dot, n: int = 3) -> DataFrame:
    """(user_id, favourite, place, item_id, similarity): the ``n`` recommendations nearest to the item that the user rated highest.

    Ties go to the smaller item id. Users whose favourite has no vector are left out.
    """
    best = F.min_by("item_id", F.struct((-F.col("rating")).alias("order"), "item_id"))
    favourite = train.filter("rating is not null").groupBy("user_id").agg(best.alias("item_id")).join(vectors, "item_id").select(
        "user_id",
        F.col("item_id").alias("favourite"),
        F.col("vec").alias("vec2"),
    )
    rows = recs.select("user_id", "item_id").join(vectors, "item_id").join(favourite, "user_id")
    norm = F.sqrt(dot("vec", "vec")) * F.sqrt(dot("vec2", "vec2"))
    near = rows.withColumn("similarity", F.round(F.coalesce(dot("vec", "vec2") / F.when(norm != 0, norm), F.lit(0.0)), 6))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("similarity"), "item_id")).cast("long")  # a list has a fixed length
    return near.withColumn("place", place).filter(F.col("place") <= n).select("user_id", "favourite", "place", "item_id", "similarity")


def qualitative_summary(train: DataFrame, recs: DataFrame, test: DataFrame, labels: DataFrame, vectors: DataFrame, dot, n: int = 10) -> DataFrame:
    """A row a user with recommendations: overlap of categories, similarity within the list, concentration on the train favourite, hits."""
    out = hit_rate(recs, test, n)
    for part in (category_overlap(train, recs, labels), intra_list(recs, vectors, dot), concentration(train, recs, labels).drop("category")):
        out = out.join(part, "user_id", "left")
    zero = ["overlap", "mean_similarity", "max_similarity", "concentration"]
    return out.na.fill(0.0, zero).na.fill(False, ["over_specialised"])


def formatted_top(df: DataFrame, labels: DataFrame, n: int = 3) -> DataFrame:
    """(user_id, top): a user's most frequent categories as text with their percentages."""
    top = top_categories(df, labels, n)
    percent = F.format_number(F.round(100 * F.col("share"), 4), 1)  # rounds the number itself, as C does; format_string rounds its shortest decimal form
    one = F.format_string("%s (%s%%)", F.col("category"), percent)
    return top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("text")))), lambda x: x["text"]), ", ").alias("top"))  # n rows


def relevance_features(rows: DataFrame, train: DataFrame, scores: DataFrame) -> DataFrame:
    """(user_id, item_id, rating, similarity, user_mean, item_mean, item_count): what a learned relevance model sees of a pair.

    All of it comes from train rows and content; users and items without train rows get the mean of all ratings.
    """
    users = train.groupBy("user_id").agg(F.avg("rating").alias("user_mean"))
    items = train.groupBy("item_id").agg(F.avg("rating").alias("item_mean"), F.count("*").cast("double").alias("item_count"))
    whole = train.agg(F.avg("rating").alias("_all"))  # one row
    out = rows.select("user_id", "item_id", F.col("rating").cast("double").alias("rating")).join(users, "user_id", "left").join(items, "item_id", "left")
    out = out.join(scores.select("user_id", "item_id", F.col("score").alias("similarity")), ["user_id", "item_id"], "left").join(F.broadcast(whole))
    return out.select(
        "user_id", "item_id", "rating", F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("user_mean", "_all").alias("user_mean"), F.coalesce("item_mean", "_all").alias("item_mean"), F.coalesce("item_count", F.lit(0.0)).alias("item_count"),
    )


def relevance_models(train_features: DataFrame, test_features: DataFrame, seed: int = 42) -> DataFrame:
    """(model, n, rmse, mae) on test pairs of two learned models of the rating, and of the item's mean as a baseline."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    gather = VectorAssembler(inputCols=["similarity", "user_mean", "item_mean", "item_count"], outputCol="features")
    learn, test = cut(train_features), cut(test_features)
    error = F.col("prediction") - F.col("rating")
    scores = lambda name, df: df.agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"))
    out = scores("item_mean", test.withColumn("prediction", F.col("item_mean")))
    if learn.isEmpty():
        return out
    models = {"linear": LinearRegression(labelCol="rating", regParam=0.01), "forest": RandomForestRegressor(labelCol="rating", numTrees=20, maxDepth=5, seed=seed)}
    for name, model in models.items():
        out = out.union(scores(name, model.fit(gather.transform(learn)).transform(gather.transform(test))))
    return out


def metrics_by_activity(train: DataFrame, metrics: DataFrame, bounds: tuple[int, int] = (20, 50)) -> DataFrame:
    """Mean ranking metrics of users with few, some and many train rows (below, from, and from the second bound on; beyond parity)."""
    low, high = bounds
    n = F.coalesce("n", F.lit(0))
    segment = F.when(n < low, "few").when(n < high, "some").otherwise("many")
    rows = metrics.join(train.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").withColumn("segment", segment)
    return rows.groupBy("segment").agg(F.count("*").alias("users"), *[F.round(F.avg(c), 5).alias(c) for c in ("precision", "recall", "ndcg")])
