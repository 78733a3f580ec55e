import datetime as dt
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import analysis, features, interactions, latent, quality, recommend, reports
from shelfmark.plans import lineage
from shelfmark.plans.components import components
from shelfmark.sources import manifest, sinks, tables

DAY = dt.datetime(2000, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def events(spark, sizes):
    data = [(u, i, 5.0, DAY + dt.timedelta(days=i), i) for u, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(data, "user_id long, item_id long, rating double, ts timestamp_ntz, k long")


def test_split_sizes(spark):
    df = events(spark, {1: 1, 2: 2, 3: 3, 5: 5, 10: 10, 20: 20})
    test = lambda s: {r["user_id"]: r["n"] for r in s.groupBy("user_id").agg(F.sum((F.col("split") == "test").cast("int")).alias("n")).collect()}
    assert test(interactions.temporal_split(df, "k")) == {1: 0, 2: 0, 3: 1, 5: 1, 10: 2, 20: 4}
    assert test(interactions.random_split(df)) == {1: 0, 2: 1, 3: 1, 5: 1, 10: 1, 20: 3}


def test_clean_bounds(spark):
    stamps = [dt.datetime(1995, 6, 30, 23, 59, 59), dt.datetime(1995, 7, 1), dt.datetime(2025, 12, 31), dt.datetime(2025, 12, 31, 0, 0, 1), None]
    data = [(4.0, t) for t in stamps] + [(r, stamps[1]) for r in (0.0, -1.0, None, float("nan"))]
    df = spark.createDataFrame(data, "rating double, ts timestamp_ntz")
    assert interactions.clean(df, "1995-07-01", "2025-12-31").count() == 2
    assert rows(interactions.clean_report(df, "1995-07-01", "2025-12-31")) == [(9, 4, 3, 2)]


def test_k_core_is_a_fixpoint(spark):
    df = events(spark, {u: u for u in range(1, 9)})
    core, _ = interactions.k_core(df, 4, 3)
    again, rounds = interactions.k_core(core, 4, 3)
    assert core.count() == again.count() and rounds == 1
    assert interactions.k_core(df, 100, 100)[0].isEmpty()
    with pytest.raises(RuntimeError):
        interactions.k_core(df, 4, 3, max_rounds=1)


def test_k_core_after_some_rounds(spark):
    pairs = [(u, i) for u in range(30) for i in (u, u + 1)]  # a chain of users and items, which shrinks from its ends
    df = spark.createDataFrame(pairs, "user_id long, item_id long")
    want = set(pairs)
    for n in range(1, 4):
        for at, least in ((1, 2), (0, 2)):
            count = {k: sum(p[at] == k for p in want) for k in {p[at] for p in want}}
            want = {p for p in want if count[p[at]] >= least}
        got, rounds = interactions.k_core(df, 2, 2, rounds=n)
        assert rounds == n and {tuple(r) for r in got.select("user_id", "item_id").collect()} == want and want
    assert interactions.k_core(df, 2, 2)[0].isEmpty()


def test_percentages_round_as_in_c(spark):
    counts = {(s, n) for s in (16, 80, 120, 140) for n in range(1, s)}
    df = spark.createDataFrame([(s * 1000 + n, i) for s, n in counts for i in [0] * n + [1] * (s - n)], "user_id long, item_id long")
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "item_id long, category string")
    got = {r["user_id"]: r["top"] for r in analysis.formatted_top(df, labels).collect()}
    percent = lambda n, s: f"{round(100 * round(n / s, 6), 4):.1f}%"
    assert all(f"a ({percent(n, s)})" in got[s * 1000 + n] for s, n in counts) and "a (6.2%)" in got[16_001]


def test_sparse_profiles_shuffle_packed_items(spark):
    weights = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (2, "b", 1.0)], "item_id long, feature string, weight double")
    train = spark.createDataFrame([(7, 1, 4.0), (7, 2, 1.0), (7, 9, 5.0), (8, 2, 0.0), (9, 9, 1.0)], "user_id long, item_id long, rating double")
    out = recommend.sparse_profiles(train, weights)
    assert rows(out.select("user_id", "feature", "weight")) == [(7, "a", 0.4), (7, "b", 0.4), (8, "b", 0.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "user_id" in plan and not any("hashpartitioning(user_id" in line and "feature" in line for line in plan.splitlines())


def test_rankings_in_bounded_memory(spark):
    rng = np.random.default_rng(5)
    x, u = np.round(rng.normal(size=(30_000, 4)), 1), np.round(rng.normal(size=(256, 4)), 1)
    x[7] = 0
    want = np.round(np.nan_to_num((u @ x.T) / (np.linalg.norm(u, axis=1)[:, None] * np.maximum(np.linalg.norm(x, axis=1), 1e-300))), 6)
    users = pa.table({"user_id": np.arange(256), "profile": list(u), "k": np.arange(256) % 3})
    items = recommend.Items(np.arange(30_000), x.copy())
    tracemalloc.start()
    got = items.best(users, 4).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * recommend.SCORE_BYTES  # 61 MB of scores in all
    for i, mine in got.groupby("user_id"):
        order = np.argsort(-want[i], kind="stable")[: 4 + i % 3]
        assert mine["item_id"].tolist() == order.tolist() and np.allclose(mine["score"], want[i][order], atol=1.1e-6)
    vec = spark.createDataFrame([(1, [1.0, 0.0])], "item_id long, vec array<double>")
    plan = recommend.dense_profiles(spark.createDataFrame([(7, 1, 5.0)], "user_id long, item_id long, rating double"), vec)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_sparse_rankings_in_groups(spark):
    rng = np.random.default_rng(9)
    x, p = (np.round(rng.normal(size=(m, 30)), 1) * (rng.random((m, 30)) < 0.1) for m in (80, 20))
    cells = lambda m, key: spark.createDataFrame([(int(i), f"f{j:02d}", float(m[i, j])) for i, j in zip(*m.nonzero(), strict=True)], f"{key} long, feature string, weight double")
    seen = spark.createDataFrame([(u, i) for u in range(20) for i in range(u % 4)], "user_id long, item_id long")
    want = []
    for u in range(20):
        scores = []
        for i in range(80):
            if ((p[u] != 0) & (x[i] != 0)).any() and i >= u % 4:
                scores.append((-round(float(p[u] @ x[i] / np.linalg.norm(p[u]) / np.linalg.norm(x[i])), 6), i))
        want += [(u, i, abs(s) if s == 0 else -s, r) for r, (s, i) in enumerate(sorted(scores)[:5], 1)]
    for most in (10, 1000):
        out = recommend.top_sparse(cells(p, "user_id"), cells(x, "item_id"), seen, 5, most)
        got = rows(out.select("user_id", "item_id", "score", "rank"))
        assert [(u, i, r) for u, i, _, r in got] == [(u, i, r) for u, i, _, r in sorted(want, key=repr)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want, key=repr)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "feature" not in plan  # no row a user, item and feature


def test_tfidf_counts_tokens_once(spark):
    counts = features.term_counts(spark.createDataFrame([(i, "river garden " * (i + 1)) for i in range(6)], "item_id long, text string"))
    vocab = features.vocabulary(counts, 6, 1, 1.0)
    raw = features.raw_weights(counts, vocab).withColumnsRenamed({"term": "feature", "w": "weight"})
    for out, n in ((features.tfidf(counts, vocab), 12), (features.density(raw, 6), 1)):
        assert len(out.collect()) == n and "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_matrices_read_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)
    data = [("train", 1, 5, 2.0), ("train", 1, 6, 1.0), ("test", 2, 5, 3.0)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(data, 2).map(lambda r: (read.add(1), r)[1]), "split string, user_id long, item_id long, rating double")
    assert rows(interactions.matrices_over_shared_ids(df)[0]) == [("test", 1, 0, 3.0), ("train", 0, 0, 2.0), ("train", 0, 1, 1.0)] and read.value == 3
    assert rows(interactions.rating_matrix(df)) == [(0, 0, 2.0), (0, 1, 1.0), (1, 0, 3.0)] and read.value == 6


def test_dedup_and_ids(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 3), (1, 1, 2), (2, 1, 1)], "user_id long, item_id long, ts long")
    assert rows(interactions.one_a_pair(df, F.desc("ts"))) == [(1, 1, 3), (2, 1, 1)]
    ids = interactions.dense_ids(spark.range(100, 0, -7).withColumnRenamed("id", "x"), "x", "n")
    assert [n for _, n in rows(ids.select("x", "n").orderBy("x"))] and sorted(r["n"] for r in ids.collect()) == list(range(15))


def test_lists_structs_and_missing(spark):
    df = spark.sql("""SELECT * FROM VALUES (array('a', '', null, 'b'), named_struct('name', 'Q')), (array(), named_struct('name', null)), (null, null) t(l, s)""")
    assert rows(df.select(quality.joined_list("l"), quality.struct_field("s", "name"))) == [("", ""), ("", "None"), ("a | b", "Q")]
    m = quality.missingness(spark.createDataFrame([(None,), ("",), ("  ",), ("x",)], "c string"), {"c": "text", "d": "text"})
    assert rows(m) == [("c", 1, 25.0, 2, 50.0, 75.0, "empty string"), ("d", None, None, None, None, None, "absent")]
    assert [r["reason"] for r in quality.missingness_strategy(m, {"c": "why"}).collect()] == ["why", "-"]


def test_price_median_weighs_interactions(spark):
    items = spark.sql("SELECT * FROM VALUES (1, 'a', array('x'), null, null, 10.0D), (2, 'b', array('x'), null, null, 20.0D), (3, 'c', null, null, null, null) t(item_id, title, categories, author, details, price)").withColumns({"author": F.expr("cast(null as struct<name:string>)"), "details": F.expr("cast(null as struct<Publisher:string,Language:string>)")})
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (3,)], "item_id int")
    assert {r["price"] for r in quality.join_catalogue(df, items).filter("item_id = 3").collect()} == {10.0}


def test_text(spark):
    df = spark.createDataFrame([("Don't buy http://x.y 42 sooo NAÏVE œuvre the cat",), ("don’t",), (None,)], "t string")
    counted = features.term_counts(df.select(F.lit(1).alias("item_id"), F.col("t").alias("text")).limit(1))
    assert sorted(r["term"] for r in counted.collect()) == ["buy", "cat", "dont", "naive", "oeuvre"]
    c = spark.createDataFrame([("['Books, \"X\"','Y ']",), (None,), ("A | B",)], "t string")
    assert [r[0] for r in c.select(text.categories(F.col("t"))).collect()] == [["Books", "X", "Y"], [], ["A | B"]]


def test_profiles_and_blocks(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "item_id long, vec array<double>")
    train = spark.createDataFrame([(7, 1, 5.0), (7, 2, 1.0), (8, 3, 0.0)], "user_id long, item_id long, rating double")
    p = {r["user_id"]: r["profile"] for r in recommend.dense_profiles(train, vec).collect()}
    assert np.allclose(p[7], [5 / 6, 1 / 6]) and p[8] == [0.0, 0.0]
    assert {r["user_id"]: r["profile"] for r in recommend.dense_profiles(train, vec, 2).collect()}[8] == [0.5, 0.5]
    one = rows(recommend.top_block(recommend.dense_profiles(train, vec), vec, train, 2))
    assert one == rows(recommend.top_block(recommend.dense_profiles(train, vec), vec, train, 2, block_bytes=16))
    assert one == rows(recommend.top_dense(recommend.dense_profiles(train, vec), vec, train, 2).select("user_id", "item_id", "score", "rank"))
    assert one == rows(recommend.top(recommend.dense_profiles(train, vec), vec, train, 2, most_bytes=1))
    with pytest.raises(ValueError):
        recommend.top_dense(recommend.dense_profiles(train, vec), vec, train, 2, most_bytes=1)
    assert recommend.top(recommend.dense_profiles(train, vec), vec.limit(0), train).isEmpty()
    assert recommend.top_block(recommend.dense_profiles(train, vec), vec, None, 9).count() == 8 and recommend.score_bytes(2, 4) == 64 and recommend.frame_bytes(vec) > 0
    assert {(u, i) for u, i, *_ in one} == {(7, 3), (7, 4), (8, 1), (8, 2)}


def long_form(x):
    return [(i, f"t{j:03d}", float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j]]


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 40)) * np.geomspace(10, 0.1, 40) * (rng.random((200, 40)) < 0.4)
    df = spark.createDataFrame(long_form(x), "item_id long, feature string, weight double")
    basis = latent.truncated_svd(df, 6)
    _, want, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(basis.sigma, want[:6]) and np.allclose(np.abs(np.sum(basis.v * vt[:6].T, axis=0)), 1, atol=1e-6)
    rows_there = [i for i in range(200) if x[i].any()]
    y = x[rows_there] @ vt[:6].T
    n = len(rows_there)
    assert basis.n_rows == n and np.allclose(basis.ratio, y.var(0) / x[rows_there].var(0).sum(), atol=1e-8)
    got = {r["item_id"]: r["vec"] for r in latent.project(df, basis, "item_id").collect()}
    assert sorted(got) == rows_there and np.allclose(np.abs([got[i] for i in rows_there]), np.abs(y), atol=1e-4)
    sweep = {r["n_components"]: r["variance_pct"] for r in latent.sweep(basis, spark, (2, 4, 6, 300)).collect()}
    assert list(sweep) == [2, 4, 6] and abs(sweep[4] - 100 * basis.ratio[:4].sum()) < 0.01


def test_svd_of_little(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 1.0)], "item_id long, feature string, weight double")
    one = latent.truncated_svd(df, 50)
    assert np.allclose(one.sigma, [5**0.5]) and one.v.shape == (1, 1)
    none = latent.truncated_svd(df.limit(0), 50)
    assert none.sigma.size == 0 and latent.metrics(none, spark).isEmpty()


def test_item_matrix_modes(spark):
    x = np.random.default_rng(2).normal(size=(30, 8))
    df = spark.createDataFrame(long_form(x), "item_id long, feature string, weight double")
    numeric = spark.createDataFrame([(i, i / 29) for i in range(30)], "item_id long, price double")
    basis = latent.truncated_svd(df, 5)
    width = lambda mode, **k: len(latent.item_matrix(mode, df, basis, **k).first()["vec"])
    assert width("svd") == 5 and width("svd_3d") == 3 and width("svd_auto", recommended=2) == 2 and width("svd+numeric", numeric=numeric) == 6
    assert latent.item_matrix("tfidf", df).count() == 240 and latent.item_matrix("tfidf+numeric", df, None, numeric).count() == 269
    for bad in ("svd_9d", "svd_auto", "other", "svd+x"):
        with pytest.raises(ValueError):
            latent.item_matrix(bad, df, basis)


def test_projection_checks(spark):
    v = lambda rows, key: spark.createDataFrame(rows, f"{key} long, vec array<float>")
    users, items = v([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "user_id"), v([(5, [1.0, 0.0])], "item_id")
    pairs = lambda rows: spark.createDataFrame(rows, "user_id long, item_id long")
    ok = latent.projection_report(users, items, pairs([(1, 5), (2, 5)]), pairs([(1, 6)])).first()
    assert ok["same_vector_space"] and ok["no_test_data_used"] and ok["consistent_with_train"]
    bad = latent.projection_report(users, v([(5, [1.0])], "item_id"), pairs([(1, 5)]), pairs([(1, 5)])).first()
    assert not bad["same_vector_space"] and not bad["no_test_data_used"] and not bad["consistent_with_train"]
    odd = v([(1, [1.0, float("nan")]), (1, [float("-inf"), 0.0]), (2, [1.0])], "user_id")
    assert tuple(latent.validate_vectors(odd, "user_id", 2).first()) == (3, 1, 1, 1, 1, False)
    assert latent.validate_vectors(users, "user_id", 2).first()["ok"] and not latent.validate_vectors(users.limit(0), "user_id", 2).first()["ok"]


def test_min_max_constant_and_trade_off(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 3.0), (3, 3.0, None)], "item_id long, a double, b double")
    assert rows(features.min_max(df, ["a", "b"])) == [(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 0.0)]
    t = spark.createDataFrame([(50, 10.3), (100, 13.3), (200, 17.7), (300, 21.0)], "n_components long, variance_pct double")
    assert [r["n_components"] for r in recommend.trade_off(t).filter("recommended").collect()] == [300]


def test_single_row_user(spark):
    df = spark.createDataFrame([(1, 1, 4.0)], "user_id long, item_id long, rating double")
    labels = spark.createDataFrame([(1, "a")], "item_id long, category string")
    assert rows(analysis.user_stats(df, labels)) == [(1, 1, 4.0, 0.0, 1, 1.0)]


def test_jsonl_and_verification(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "rating": "n/a"}\n\n{"id": "b", "rating": 4.5}\n{"id": "c"}\n')
    df = tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), ["id", "rating"], ["rating"])
    assert rows(df.filter("id is not null")) == [("a", None), ("b", 4.5), ("c", None)]
    assert tables.non_blank_lines(spark, str(tmp_path / "x.jsonl")) == 3
    assert all(tables.verify_conversion(df, df).values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 150)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"), "a", "b")))
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()


def test_representative_users(spark):
    stats = [(i, 10, 4.0, 0.0, 2, 0.5) for i in range(1, 30)] + [(50, 99, 4.0, 0.0, 9, 0.2), (51, 40, 4.0, 0.0, 20, 0.1), (52, 4, 4.0, 0.0, 1, 1.0), (53, 5, 4.0, 0.0, 1, 1.0)]
    df = spark.createDataFrame(stats, "user_id long, n_items long, mean_rating double, std_rating double, n_categories long, dominant_ratio double")
    picked = lambda d: {r["label"][:2]: r["user_id"] for r in analysis.representative_users(d).collect()}
    assert picked(df) == {"U1": 50, "U2": 1, "U3": 52, "U4": 51, "U5": 53}
    assert picked(df.filter("user_id < 30"))["U3"] == 3 and picked(df.limit(0)) == {}


def test_times_of_all_kinds(spark):
    check = lambda d: quality.timestamp_validation(d).first()
    ms = check(spark.createDataFrame([(1_600_000_000_000,), (1_500_000_000,), (None,), (2**62,)], "ts long"))
    assert (ms["n"], ms["min_year"], ms["max_year"], ms["n_bad"], ms["ok"]) == (3, 2017, 2020, 1, False)
    text_times = check(spark.createDataFrame([("2001-02-03 04:05:06",), ("1999-01-01",), ("x",), (None,)], "ts string"))
    assert (text_times["n"], text_times["n_before"], text_times["n_bad"]) == (3, 1, 1)
    assert check(spark.createDataFrame([], "ts timestamp_ntz"))["ok"] is False
    t = spark.createDataFrame([(0,), (1_600_000_000_123,), (None,)], "ms long").select(interactions.epoch_time(F.col("ms")).alias("t"))
    assert [r["t"] for r in t.collect()] == [dt.datetime(1970, 1, 1), dt.datetime(2020, 9, 13, 12, 26, 40, 123000), None]


def test_duplicates_and_schema(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, 2.0), (1, 1, 3.0), (2, 1, None), (2, 1, None)], "user_id long, item_id long, rating double")
    assert tuple(interactions.duplicate_report(df).first()) == (5, 2, 40.0, 3, 60.0, 4, 80.0)
    assert tuple(interactions.duplicate_report(df.drop("user_id")).first()) == (5, 2, 40.0, 4, 80.0)
    found = quality.schema_checks(spark.createDataFrame([("a",), (None,)], "item_id string"), "x", ["item_id", "rating"]).first()
    assert (found["missing"], found["ok"], found["n_missing_keys"], found["missing_key_pct"], found["n_changed"]) == (["rating"], False, 1, 50.0, 0)
    assert quality.schema_checks(df.select("user_id"), "x", ["item_id"]).first()["n_missing_keys"] is None


def test_clean_joined(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 5), (1, 1, 3.0, 9), (1, None, 3.0, 9), (2, 1, None, 1), (2, 2, 4.0, 1)], "user_id long, item_id long, rating double, ts long")
    kept = quality.clean_joined(df, F.desc("ts"))
    assert rows(kept) == [(1, 1, 3.0, 9), (2, 2, 4.0, 1)]
    report = quality.clean_joined_report(df).first().asDict()
    assert report == {"rows_before": 5, "users_before": 2, "items_before": 2, "rows_after": 2, "users_after": 2, "items_after": 2, "dropped_missing_key": 2, "dropped_duplicates": 1}
    assert tuple(quality.lost_items(df, kept.filter("item_id = 1")).first()) == (2, 1, 1, 50.0, False)


def test_split_checks(spark):
    df = spark.createDataFrame([(1, 1, "train"), (1, 2, "test"), (2, 1, "train"), (3, 2, "test"), (1, 1, "test")], "user_id long, item_id long, split string")
    assert {r["check"]: r["n"] for r in interactions.split_checks(df).collect()} == {"one_part_users": 2, "strange_test_users": 1, "shared_pairs": 1}
    r = interactions.split_report(df).first()
    assert (r["train_rows"], r["test_rows"], r["test_only_items"], r["test_only_items_pct"], r["train_ratio"]) == (2, 3, 1, 50.0, 0.4)


def test_manifest(spark, tmp_path):
    a, b, gone = (str(tmp_path / x) for x in ("a.parquet", "b.parquet", "gone.parquet"))
    spark.createDataFrame([(1, "x", 2.0)], "item_id long, title string, only_a double").write.parquet(a)
    spark.createDataFrame([(2, "y", 3)], "item_id long, title string, only_b int").write.parquet(b)
    both = manifest.Source("both", "interactions", (a, b), variant="v", required=("item_id", "z"))
    assert rows(both.load(spark)) == [(1, "x"), (2, "y")] and both.load(spark, ["title", "only_a"]).columns == ["title"]
    assert manifest.missing_paths(spark, [both, manifest.Source("g", "metadata", (gone,))]) == {"both": [], "g": [gone]}
    facts = manifest.source_facts(spark, [both, manifest.Source("g", "metadata", (gone,))])
    f = {r["name"]: r for r in facts.collect()}
    assert (f["both"]["kind"], f["both"]["n_rows"], f["both"]["shared"], f["both"]["first_only"], f["both"]["last_only"], f["both"]["missing"]) == ("union", 2, ["item_id", "title"], ["only_a"], ["only_b"], ["z"])
    assert not f["g"]["found"] and f["both"]["size_bytes"] > 0 and [r["name"] for r in manifest.reuse_note(facts).collect()] == ["both"]
    assert [p.rsplit("/", 1)[1] for p in manifest.glob_paths(spark, f"{tmp_path}/*.parquet")] == ["a.parquet", "b.parquet"] and manifest.glob_paths(spark, gone) == []
    spark.createDataFrame([], "x long").write.parquet(f"{tmp_path}/none")
    assert manifest.usable_paths(spark, [a, gone, f"{tmp_path}/none"], 1) == [a] and manifest.usable_paths(spark, [a], 10**9) == []
    assert rows(manifest.items_or_fallback(spark, gone, b)) == [(2, "y")]
    with pytest.raises(FileNotFoundError):
        manifest.items_or_fallback(spark, gone)
    assert rows(manifest.misaligned(spark.read.parquet(a), spark.read.parquet(b))) == [(1, "matrix"), (2, "items")]


def test_sinks(spark, tmp_path):
    to = lambda name: str(tmp_path / name)
    df = spark.createDataFrame([(1, "train", [1]), (2, "test", None)], "user_id long, split string, l array<int>")
    sinks.save_split(df, to("split"))
    assert [tuple(r) for r in sinks.load_split(spark, to("split"), "test").collect()] == [(2, None)]
    probe = {r["column"]: (r["type"], r["n_null"], r["n_distinct_about"]) for r in sinks.save_joined(df, to("joined")).collect()}
    assert probe == {"user_id": ("bigint", 0, 2), "split": ("string", 0, 2), "l": ("array<int>", 1, 1)}
    assert sinks.write_once(df, to("once")) and not sinks.write_once(df.limit(0), to("once")) and spark.read.parquet(to("once")).count() == 2
    sinks.save_matrix(df.select("user_id"), to("m"), users=df.select("split"))
    assert sinks.load_matrix(spark, to("m"), "users").count() == 2
    terms = spark.createDataFrame([("b",), ("a",), ("c",)], "term string")
    sinks.save_vocabulary(terms, to("vocab"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "vocab").glob("part-*"))) == "a\nb\nc\n"
    recs = spark.createDataFrame([(1, 1, 7, 0.5), (1, 2, 8, 0.4)], "user_id long, rank long, item_id long, score double")
    sinks.save_recommendations(recs, spark.createDataFrame([(7, "seven")], "item_id long, title string"), to("recs"), "?")
    assert rows(spark.read.parquet(to("recs"))) == [(1, 1, 7, 0.5, "seven"), (1, 2, 8, 0.4, "?")]
    sinks.save_json(spark, {"a": [1, None], "é": True}, to("r.json"))
    assert sinks.read_json(spark, to("r.json")) == {"a": [1, None], "é": True}
    assert [sinks.truthy(x) for x in (True, " Yes ", "no", None, 1, "passed")] == [True, True, False, False, True, True]


def test_numpy_artifacts(spark, tmp_path):
    dense = np.array([[1.0, 0.0], [0.0, 2.5]])
    np.save(tmp_path / "x.npy", dense)
    np.savez(tmp_path / "x.npz", data=np.array([1.0, 2.5]), indices=np.array([0, 1]), indptr=np.array([0, 1, 2]), shape=np.array([2, 2]))
    for name in ("x.npy", "x.npz"):
        assert rows(sinks.read_numpy(spark, str(tmp_path / name)).drop("file")) == [(0, 0, 1.0), (1, 1, 2.5)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 12345, 0.5, None, True)], "name string, n long, share double, gap string, ok boolean")
    page = reports.diagnostics("Checks", {"A": [("Files", df)]})
    assert "## I. Split" in page and "| a\\|b | 12,345 | 0.5 | - | yes |" in page and page.count("Nothing to report.") == 8
    assert "12,345" in reports.console({"B": [("x", df)]}) and reports.percent(0.1234) == "12.34 %" and reports.percent(None) == "-"
    journal = reports.Journal("Users").log("first").add_table("Rows", df.union(df), most=1)
    journal.save(spark, str(tmp_path / "j.md"))
    assert sinks.read_text(spark, str(tmp_path / "j.md")) == journal.to_markdown() and "Only the first 1 rows" in journal.to_markdown() and "..." in journal.to_text()


def test_older_text_and_numbers(spark):
    df = spark.createDataFrame([(1, "A, b", "x" * 2500), (2, None, "na\u00efve Plain-words 3d")], "item_id long, title string, description string")
    corpus = {r["item_id"]: r["text"] for r in features.older_corpus(df, ["title", "description", "absent"]).collect()}
    assert corpus == {1: "a b " + "x" * 2000, 2: " na\u00efve plain words 3d"}
    counts = features.older_counts(features.older_corpus(df.filter("item_id = 2"), ["title", "description"]))
    assert sorted(r["term"] for r in counts.collect()) == ["plain", "words"]
    numbers = spark.createDataFrame([(1, "1"), (2, "3"), (3, "bad")], "item_id long, x string")
    assert np.allclose([r["x"] for r in features.standardised(numbers, ["x"]).orderBy("item_id").collect()], [-1.5**0.5, 1.5**0.5, 0])


def test_second_stop_list(spark):
    counts = spark.createDataFrame([(i, t, 1) for i in range(6) for t in ("would", "reader")], "item_id long, term string, tf long")
    stop = features.second_stop_words(spark)
    assert "would" in stop and [r["term"] for r in features.vocabulary(counts, 100, stop=stop).collect()] == ["reader"]


def test_columns_and_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", [1])], "a int, b string, c array<int>")
    assert tables.flat_columns(df).columns == ["a", "b"] and tables.tolerant_select(df, ["b", "z"]).columns == ["b"] and quality.missing_columns(df, ["z", "a"]) == ["z"]
    tables.write_parquet(df, str(tmp_path / "t"))
    tables.write_parquet(df.limit(0), str(tmp_path / "t"), "ignore")
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1, "x", [1])] and list((tmp_path / "t").glob("*.snappy.parquet"))
    lists = spark.createDataFrame([("a, b",)], "l string")
    assert lists.select(text.as_list("l", "string")).first()[0] == ["a", "b"] and df.select(text.as_list("c", "array<int>")).first()[0] == [1]


def test_flat_categories_and_checks(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "item_id long, categories array<string>")
    assert rows(features.flat_categories(df)) == [(1, "a"), (1, "b")]
    scaled = spark.createDataFrame([(1, 0.0, 0.5), (2, 1.0, None)], "item_id long, price double, rating double")
    assert {r["attribute"]: r["ok"] for r in features.attribute_checks(scaled).collect()} == {"price": True, "rating": False}


def test_ids_by_first_appearance(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 0)], "x string, at long")
    assert rows(interactions.dense_ids(df, "x", "n", "at")) == [("a", 2), ("b", 1), ("c", 0)]


def test_relevance_models_need_no_test_rows(spark):
    train = spark.createDataFrame([(u, i, float(1 + (u + i) % 5)) for u in range(12) for i in range(12)], "user_id long, item_id long, rating double")
    scores = train.select("user_id", "item_id", (F.col("rating") / 5).alias("score"))
    learn = analysis.relevance_features(train.filter("(user_id + item_id) % 4 <> 0"), train.filter("(user_id + item_id) % 4 <> 0"), scores)
    unseen = analysis.relevance_features(train.filter("(user_id + item_id) % 4 = 0"), train.filter("(user_id + item_id) % 4 <> 0"), scores)
    found = {r["model"]: r["rmse"] for r in analysis.relevance_models(learn, unseen).collect()}
    assert set(found) == {"item_mean", "linear", "forest"} and found["linear"] < 0.2 < found["item_mean"]
    assert [r["model"] for r in analysis.relevance_models(learn.limit(0), unseen).collect()] == ["item_mean"]


def test_checkpoints_on_a_cluster_need_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Empty:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: Empty()})()

        def getConf(self):
            return Conf()

    with pytest.raises(RuntimeError):
        lineage.shared_dir(type("Session", (), {"sparkContext": Context()})())


def test_svd_in_groups_with_the_basis_spread_out(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((60, 40)) * (rng.random((60, 40)) < 0.3)
    rows, cols = x.nonzero()
    df = spark.createDataFrame([(int(i), f"f{j:02d}", float(x[i, j])) for i, j in zip(rows, cols, strict=True)], "item_id long, feature string, weight double")
    monkeypatch.setattr(latent, "ENTRIES", 100)
    monkeypatch.setattr(latent, "PART_BYTES", 1000)
    basis = latent.truncated_svd(df, 5)
    _, want, vt = np.linalg.svd(x[np.unique(rows)], full_matrices=False)
    assert basis.spread.count() == 40 and basis.turn.shape == (15, 5)  # a row a feature; only the small matrix is here
    assert np.allclose(basis.sigma, want[:5], rtol=1e-3) and np.allclose(basis.v.T @ basis.v, np.eye(5), atol=1e-9)
    items = latent.project(df, basis, "item_id")
    got = {r["item_id"]: r["vec"] for r in items.collect()}
    assert set(got) == {int(i) for i in rows} and all(np.allclose(v, x[i] @ basis.v, atol=1e-5) for i, v in got.items())
    train = spark.createDataFrame([(1, 3, 5.0), (1, 4, 2.0), (2, 9, 1.0), (3, 999, 4.0)], "user_id long, item_id long, rating double")
    both = [{r["user_id"]: r["vec"] for r in t.collect()} for t in (latent.profiles(train, items), latent.project(recommend.sparse_profiles(train, df), basis, "user_id"))]
    assert set(both[0]) == set(both[1]) and all(np.allclose(v, both[1][u], atol=1e-6) for u, v in both[0].items())
