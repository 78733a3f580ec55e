"""The three runs a user starts: raw files to samples and splits, joining with reports, and recommendations with their analysis.

Each run writes its artifacts under one folder and leaves finished ones alone, so it can be started again after a failure. Names of raw
columns are given by ``Names``; from the first step on they are user_id, item_id, rating and ts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import analysis, features, interactions, latent, quality, recommend, reports
from shelfmark.plans.lineage import cut
from shelfmark.sources import manifest, sinks, tables
from shelfmark.sources.manifest import Source, exists



@dataclass(frozen=True)
class Names:
    """Raw names of what the engine calls user_id, item_id, rating and ts (seconds or milliseconds, text, or a timestamp)."""

    user: str = "user_id"
    item: str = "parent_asin"
    rating: str = "rating"
    time: str = "timestamp"
    numeric: tuple[str, ...] = ("rating", "timestamp", "average_rating", "rating_number", "price", "helpful_vote")


@dataclass(frozen=True)
class Settings:
    """Bounds of the runs, with their usual values."""

    min_reviews: int = 20
    users: int = 50_000
    first_year: int = 2020
    last_year: int = 2023
    first_day: str = "1995-07-01"
    last_day: str = "2025-12-31"
    per_user: int = 20
    per_item: int = 5
    seed: int = 42
    top_n: int = 10
    cold_below: int = 1
    sizes: tuple[int, ...] = latent.SIZES
    min_df: int = features.MIN_DF


def named(df: DataFrame, names: Names) -> DataFrame:
    """The four columns under the engine's names, times converted; other columns stay."""
    kinds = dict(df.dtypes)
    out = df.withColumn("ts", quality.as_time(names.time, kinds[names.time])) if names.time in kinds else df
    renamed = {names.user: "user_id", names.item: "item_id", names.rating: "rating"}
    out = out.withColumnsRenamed({a: b for a, b in renamed.items() if a in kinds and a != b})
    return out.drop(names.time) if names.time in kinds and names.time != "ts" else out


def convert(spark: SparkSession, source: str, target: str, fields: list[str], names: Names = Names()) -> bool:
    """JSON lines to Parquet, once; whether it was written."""
    return sinks.write_once(tables.read_jsonl(spark, source, fields, [f for f in fields if f in names.numeric]), target)


def sample_and_split(spark: SparkSession, interactions_path: str, out: str, names: Names = Names(), settings: Settings = Settings()) -> dict[str, dict]:
    """Both samples (``active`` users, ``temporal``: those of some years), cleaned, cut to their core, split at random, as matrices.

    Under ``out``: {sample}_filtered, {sample}_split (a folder a part), {sample}_matrices, {sample}_report.json. Returns the reports.
    """
    raw, found = named(spark.read.parquet(interactions_path), names), {}
    samples = {
        "active": lambda: interactions.sample_active(raw, settings.users, settings.min_reviews, settings.seed),
        "temporal": lambda: interactions.sample_temporal(raw, settings.users, settings.first_year, settings.last_year, settings.min_reviews, settings.seed),
    }
    for name, sample in samples.items():
        report = f"{out}/{name}_report.json"
        if not exists(spark, report):
            rows = cut(sample())
            core, rounds = interactions.k_core(interactions.clean(rows, settings.first_day, settings.last_day), settings.per_user, settings.per_item)
            core = core.withColumn("_order", F.struct("ts", "rating"))
            core = cut(interactions.one_a_pair(core, F.desc("_order")).drop("_order"))
            sinks.write_once(core, f"{out}/{name}_filtered")
            split = cut(interactions.random_split(core, seed=settings.seed))
            sinks.save_split(split, f"{out}/{name}_split")
            cells, users, items = interactions.matrices_over_shared_ids(split)
            sinks.save_matrix(cells, f"{out}/{name}_matrices", users=users, items=items)
            facts = {
                "cleaning": interactions.clean_report(rows, settings.first_day, settings.last_day).first().asDict(),
                "core": {"rounds": rounds, **interactions.shape(core).first().asDict()},
                "split": interactions.split_report(split).first().asDict(),
                "checks": {r["check"]: r["n"] for r in interactions.split_checks(split).collect()},
            }
            sinks.save_json(spark, facts, report)
        found[name] = sinks.read_json(spark, report)
    return found


def join_and_report(spark: SparkSession, source: Source, catalogue: Source, out: str, names: Names = Names(), wanted: dict[str, str] | None = None, reasons: dict[str, str] | None = None) -> str:
    """Interactions joined to the catalogue, cleaned and split by time, with all checks on the way; returns the Markdown report.

    Under ``out``: joined, split, diagnostics.md, diagnostics.json.
    """
    wanted, reasons = wanted or {}, reasons or {}
    missing = {k: v for k, v in manifest.missing_paths(spark, [source, catalogue]).items() if v}
    if missing:
        raise FileNotFoundError(f"not there: {missing}")
    if exists(spark, f"{out}/diagnostics.md"):
        return sinks.read_text(spark, f"{out}/diagnostics.md")
    items = named(catalogue.load(spark), names)
    rows = named(source.load(spark), names)
    rows = rows.withColumn("item_id", F.col("item_id").cast("string"))
    items = items.withColumn("item_id", F.col("item_id").cast("string"))
    kinds = {c: k for c, k in {"item_id": "key", "title": "text", "subtitle": "text", "description": "text", "categories": "text", "price": "number"}.items()}
    joined = cut(quality.join_catalogue(rows.drop(*[c for c in items.columns if c != "item_id"]), items))
    recent = [F.desc("ts"), F.desc("rating"), F.desc(F.xxhash64(*[c for c in rows.columns if c in joined.columns]))]
    clean = cut(quality.clean_joined(joined, *recent))
    probe = sinks.save_joined(clean, f"{out}/joined")
    split = cut(interactions.temporal_split(clean, "rating", "item_id"))
    sinks.save_split(split, f"{out}/split")
    facts = manifest.source_facts(spark, [source, catalogue])
    texts = [c for c in ("title", "description", "categories") if dict(joined.dtypes).get(c) == "string"]
    sections = {
        "A": [("Sources", facts), ("Taken over", manifest.reuse_note(facts, source.role))],
        "B": [
            ("Interactions", quality.schema_checks(rows, source.name, list(quality.KEYS))),
            ("Catalogue", quality.schema_checks(items, catalogue.name, ["item_id"])),
            ("Columns of the catalogue", quality.column_selection(items, wanted, reasons)),
            ("Columns written", probe),
        ],
        "C": [("Catalogue", quality.missingness_strategy(quality.missingness(items, kinds), reasons))],
        "D": [("Interactions", interactions.duplicate_report(rows)), ("Catalogue", interactions.duplicate_report(items))],
        "E": [("Ratings", quality.rating_validation(rows)), ("Times", quality.timestamp_validation(rows))],
        "F": [("Texts before cleaning", quality.text_quality(joined, texts))] if texts else [],
        "G": [("Coverage", quality.join_quality(rows, items))],
        "H": [("Rows", quality.clean_joined_report(joined)), ("After cleaning", quality.post_clean_checks(clean, items)), ("Items", quality.lost_items(joined, clean))],
        "I": [("Parts", interactions.split_report(split))],
    }
    kept = {k: [(heading, cut(df)) for heading, df in frames] for k, frames in sections.items()}  # a few rows each, shown twice
    values = {k: {heading: [r.asDict(True) for r in df.collect()] for heading, df in frames} for k, frames in kept.items()}
    page = reports.diagnostics(f"Joining {source.name} to {catalogue.name}", kept)
    sinks.save_json(spark, values, f"{out}/diagnostics.json")
    sinks.save_text(spark, page, f"{out}/diagnostics.md")
    return page


def represent(joined: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary, TF-IDF weights, scaled attributes) of the distinct items of joined rows."""
    items = cut(quality.first_by(joined, "item_id", "title"))
    describe = F.col("description") if "description" in items.columns else F.lit("")
    describe = F.array_join(describe, " ") if dict(items.dtypes).get("description", "").startswith("array") else describe
    whole = text.combined(F.col("title"), describe, text.as_list("categories", dict(items.dtypes)["categories"]))
    counts = cut(features.term_counts(items.select("item_id", whole.alias("text"))))
    vocab = cut(features.vocabulary(counts, items.count(), settings.min_df))
    names = [c for c in ("average_rating", "price") if c in items.columns]
    return vocab, cut(features.tfidf(counts, vocab)), cut(features.min_max(items, names))


def recommend_and_analyse(spark: SparkSession, prepared: str, out: str, settings: Settings = Settings()) -> str:
    """Representation, profiles, rankings in both spaces, sweep and checks, and the page on typical users; returns that page.

    ``prepared`` is what ``join_and_report`` wrote. Under ``out``: vocabulary, tfidf, items, profiles, recommendations,
    latent_items, latent_profiles, latent_recommendations, sweep.json, projection.json, users.md.
    """
    if exists(spark, f"{out}/users.md"):
        return sinks.read_text(spark, f"{out}/users.md")
    joined = spark.read.parquet(f"{prepared}/joined")
    train, test = (cut(sinks.load_split(spark, f"{prepared}/split", part)) for part in ("train", "test"))
    vocab, weights, scaled = represent(joined, settings)
    fused = cut(features.fuse(weights, scaled))
    sinks.save_vocabulary(vocab, f"{out}/vocabulary")
    sinks.save_matrix(weights, f"{out}/tfidf", attributes=scaled)
    titles = cut(quality.first_by(joined, "item_id", "title").select("item_id", "title", "categories"))
    sinks.write_once(titles, f"{out}/items")
    profiles = cut(recommend.sparse_profiles(train, fused))
    sinks.write_once(profiles, f"{out}/profiles")
    recs = cut(recommend.top_sparse(profiles, fused, train, settings.top_n))
    sinks.save_recommendations(recs, titles, f"{out}/recommendations")
    basis = latent.truncated_svd(weights, max(settings.sizes))
    table = recommend.trade_off(latent.sweep(basis, spark, settings.sizes))
    rows = [r.asDict() for r in table.orderBy("n_components").collect()]
    sinks.save_json(spark, {"sizes": rows}, f"{out}/sweep.json")
    best = basis.first(next(r["n_components"] for r in rows if r["recommended"]))
    vectors = cut(latent.project(weights, best, "item_id"))
    users = cut(latent.profiles(train, vectors))
    sinks.write_once(vectors, f"{out}/latent_items")
    sinks.write_once(users, f"{out}/latent_profiles")
    numbered = cut(interactions.dense_ids(vectors, "item_id", "idx"))
    dense = vectors.join(numbered, "item_id").select(F.col("idx").alias("item_id"), "vec")
    seen = train.join(numbered, "item_id").select("user_id", F.col("idx").alias("item_id"))
    found = recommend.top(users.withColumnRenamed("vec", "profile"), dense, seen, settings.top_n)
    found = found.withColumnRenamed("item_id", "idx").join(numbered, "idx").drop("idx")
    sinks.save_recommendations(found, titles, f"{out}/latent_recommendations")
    checks = {
        "report": latent.projection_report(users, vectors, train, test).first().asDict(),
        "users": latent.validate_vectors(users, "user_id", len(best.sigma)).first().asDict(),
        "items": latent.validate_vectors(vectors, "item_id", len(best.sigma)).first().asDict(),
    }
    sinks.save_json(spark, checks, f"{out}/projection.json")
    labels = cut(titles.select("item_id", F.explode(text.as_list("categories", dict(titles.dtypes)["categories"])).alias("category")).filter("category <> ''"))
    page = typical_users(train, test, recs, titles, labels, vectors, settings.top_n)
    page.save(spark, f"{out}/users.md")
    return page.to_markdown()


def typical_users(train: DataFrame, test: DataFrame, recs: DataFrame, titles: DataFrame, labels: DataFrame, vectors: DataFrame, n: int) -> reports.Journal:
    """A page on up to five kinds of users: their history, what is recommended to them, what they took later, and how the lists fare."""
    page = reports.Journal("Typical users")
    picked = analysis.representative_users(analysis.user_stats(train, labels)).collect()  # five rows at most
    whose = F.col("user_id").isin([r["user_id"] for r in picked])
    few = lambda df: cut(df.filter(whose))
    ours, theirs, later = few(train), few(recs), few(test)
    summary = cut(analysis.qualitative_summary(ours, theirs, later, labels, vectors, recommend.dot, n))
    near = cut(analysis.favourite_proximity(ours.select("user_id", "item_id", "rating"), theirs, vectors, recommend.dot))
    with_title = lambda df, *columns: df.join(titles.select("item_id", "title"), "item_id", "left").select(*columns)
    plain = ours.select("user_id", "item_id", "rating")
    for r in picked:
        mine = F.col("user_id") == F.lit(r["user_id"])
        page.log(f"## {r['label']}: {r['user_id']}").log(r["reason"])
        page.add_table("Train history", with_title(plain.filter(mine), "title", "rating").orderBy(F.desc("rating"), "title"))
        page.add_table("Recommendations", with_title(theirs.filter(mine), "rank", "title", "score").orderBy("rank"))
        page.add_table("Taken later", with_title(later.select("user_id", "item_id", "rating").filter(mine), "title", "rating").orderBy(F.desc("rating"), "title"))
        page.add_table("Four axes", summary.filter(mine))
        page.add_table("Nearest to the favourite", with_title(near.filter(mine), "place", "title", "similarity").orderBy("place"))
        page.add_table("Train categories", analysis.formatted_top(ours.filter(mine), labels))
        page.add_table("Recommended categories", analysis.formatted_top(theirs.filter(mine), labels))
    return page
