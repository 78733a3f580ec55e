import json
import random

from pyspark.sql import functions as F

from shelfmark import __main__, workflow
from shelfmark.sources import sinks
from shelfmark.sources.manifest import Source

WORDS = ["river", "garden", "winter", "castle", "letter", "sailor", "forest", "silver", "shadow", "harbour", "lantern", "mirror"]


def raw(tmp_path, n_users=30, n_items=40):
    rng = random.Random(3)
    lines = []
    for u in range(n_users):
        for i in rng.sample(range(n_items), rng.randint(4, 25)):
            lines.append({"user_id": f"u{u:02d}", "parent_asin": f"b{i:02d}", "rating": str(rng.randint(1, 5)), "timestamp": str(1_600_000_000_000 + rng.randint(0, 10**10)), "text": "fine"})
    lines += [lines[0], {"user_id": "u00", "parent_asin": None, "rating": "4", "timestamp": "1600000000000"}, {"user_id": "u01", "parent_asin": "b01", "rating": "bad", "timestamp": "1600000000000"}]
    (tmp_path / "reviews.jsonl").write_text("\n".join(map(json.dumps, lines)))
    items = []
    for i in range(n_items):
        about = " ".join(rng.choices(WORDS, k=8))
        items.append((f"b{i:02d}", f"{rng.choice(WORDS)} {i}", [about], ["Books", f"Kind {i % 4}"], {"name": f"A{i % 5}"} if i % 6 else None, {"Publisher": "P", "Language": None}, 5.0 + i if i % 7 else None, 3.0 + i % 3))
    return items


CATALOGUE = "parent_asin string, title string, description array<string>, categories array<string>, author struct<name:string>, details struct<Publisher:string,Language:string>, price double, average_rating double"


def test_all_runs(spark, tmp_path):
    to = lambda name: str(tmp_path / name)
    spark.createDataFrame(raw(tmp_path), CATALOGUE).write.parquet(to("meta.parquet"))
    fields = ["user_id", "parent_asin", "rating", "timestamp", "text"]
    assert workflow.convert(spark, to("reviews.jsonl"), to("reviews.parquet"), fields) and not workflow.convert(spark, to("reviews.jsonl"), to("reviews.parquet"), fields)

    small = workflow.Settings(min_reviews=4, users=25, first_year=2020, last_year=2021, per_user=3, per_item=2, sizes=(2, 4), min_df=2)
    facts = workflow.sample_and_split(spark, to("reviews.parquet"), to("a"), settings=small)
    assert facts["active"]["core"]["n_users"] == 25 and facts["active"]["checks"]["shared_pairs"] == 0 and facts["active"]["split"]["train_rows"] > facts["active"]["split"]["test_rows"] > 0
    cells = sinks.load_matrix(spark, to("a/active_matrices"))
    assert cells.count() == facts["active"]["core"]["n_rows"] and sinks.load_matrix(spark, to("a/active_matrices"), "users").count() == 25

    reviews, meta = Source("reviews", "interactions", (to("reviews.parquet"),)), Source("meta", "metadata", (to("meta.parquet"),))
    page = workflow.join_and_report(spark, reviews, meta, to("b"), wanted={"title": "text"}, reasons={"title": "main text"})
    assert page == workflow.join_and_report(spark, reviews, meta, to("b")) and all(f"## {x}." in page for x in "ABCDEFGHI") and "main text" in page
    values = sinks.read_json(spark, to("b/diagnostics.json"))
    rows = values["H"]["Rows"][0]
    assert rows["dropped_missing_key"] == 1 and rows["dropped_duplicates"] == 1 and values["D"]["Interactions"][0]["exact"] == 1
    joined = spark.read.parquet(to("b/joined"))
    assert joined.filter("price is null or title = ''").isEmpty() and joined.groupBy("user_id", "item_id").count().filter("count > 1").isEmpty()

    users = workflow.recommend_and_analyse(spark, to("b"), to("c"), small)
    assert users.count("## U") >= 4 and users == workflow.recommend_and_analyse(spark, to("b"), to("c"), small)
    for name in ("recommendations", "latent_recommendations"):
        recs = spark.read.parquet(to(f"c/{name}"))
        seen = sinks.load_split(spark, to("b/split"), "train")
        assert recs.join(seen, ["user_id", "item_id"], "left_semi").isEmpty() and recs.agg(F.max("rank")).first()[0] == 10 and recs.filter("title = ''").isEmpty()
    checks = sinks.read_json(spark, to("c/projection.json"))
    assert checks["report"]["same_vector_space"] and checks["report"]["no_test_data_used"] and checks["users"]["ok"] and checks["items"]["ok"]
    assert [r["n_components"] for r in sinks.read_json(spark, to("c/sweep.json"))["sizes"]] == [2, 4]
    __main__.main(["recommend", to("b"), to("c")])
