import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate as dc
from shelfmark.llm.common import first_ids
from shelfmark.llm import interpolation, language, licenses, mixing, quality, quotation, sharding, simhash, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string"


def docs(spark, seed=1, n=120, longest=5000):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 60))) for _ in range(n)]
    texts[3] = texts[4] = texts[5]
    texts[6], texts[7], texts[8] = None, "", " \n "
    texts[9] = " ".join(rng.choices(vocab, k=longest))
    data = [(i, t, "en", None if i % 17 == 0 else f"s{i % 3}" if i % 2 else "hot", 0, "x", "y") for i, t in enumerate(texts)]
    data += [data[10], data[10], (None, "null id", "en", "s1", 0, "x", "y")]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(spark):
    for slack in (0.0, 0.1):
        out = sharding.shard_ring(docs(spark), 7, slack=slack).collect()
        counts = Counter(r["shard"] for r in out)
        assert sum(counts.values()) == 123 and (slack or max(counts.values()) - min(counts.values()) <= 1)
        for s in counts:
            assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    assert "_in_shard" in sharding.shard_ring(docs(spark)).columns and sharding.shard_ring(empty(spark)).isEmpty()


def test_ring_moves_few_and_passes_full_shards_only():
    counts = {c: 1 + c % 3 for c in range(0, sharding.CELLS, 5)}
    home = lambda plan: {(c, r): s for c, a, b, s, _ in plan for r in range(a, b + 1)}
    a, b = home(sharding.ring_plan(counts, 10)), home(sharding.ring_plan(counts, 11))
    assert len(a) == len(b) == sum(counts.values())
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.35  # one more shard of eleven needs 0.09 at least


def brute_targets(sizes, weights, cap=3):
    left, free, out = sum(sizes), set(range(len(sizes))), {}
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i]]
        if not over:
            return [out.get(i, left * weights[i] / w) for i in range(len(sizes))]
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
            free.remove(i)
    return [out[i] for i in range(len(sizes))]


def test_mixing(spark):
    out = mixing.mix_sources(docs(spark, longest=100)).withColumn("size", mixing.words()).collect()
    assert len(out) == 123
    sources = sorted({r["source"] for r in out}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in out if r["source"] == s) for s in sources]
    want = brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])
    for s, t, z in zip(sources, want, sizes, strict=True):
        mine = [r for r in out if r["source"] == s]
        assert mine[0]["_target"] == pytest.approx(t) and mine[0]["_source_size"] == z
        assert abs(sum(r["size"] * r["_repeats"] for r in mine) - t) <= 40 and max(r["_repeats"] for r in mine) <= 3
    assert mixing.mix_sources(empty(spark)).isEmpty()
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix_sources(docs(spark, longest=100)).withColumn("size", mixing.words()).collect()))


def brute_classes(fps, distance):
    parent = {i: i for i, _ in fps}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i, a in fps:
        for j, b in fps:
            if (a ^ b) & (2**64 - 1) and ((a ^ b) & (2**64 - 1)).bit_count() > distance:
                continue
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in fps}


@pytest.mark.parametrize("bucket", [1, 3, 128])
@pytest.mark.parametrize("distance", [2, 4])
def test_simhash_classes(spark, bucket, distance):
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, 1, 2**64 - 1]
    fps = [(i, c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))) for i, c in enumerate(rng.choices(centres, k=150))]
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in fps]
    got = simhash.classes(spark.createDataFrame(signed, "id long, fp long"), distance, None, bucket)
    assert {r["id"]: r["component_id"] for r in got.collect()} == brute_classes(fps, distance)


def test_simhash_edges(spark):
    out = {r["id"]: r for r in simhash.classes(simhash.fingerprints(docs(spark))).collect()}
    assert out[6]["fp"] == out[7]["fp"] == out[8]["fp"] == 0 and out[8]["component_id"] == 6 and out[5]["component_id"] == 3
    assert simhash.classes(simhash.fingerprints(empty(spark))).isEmpty()
    best, chosen = simhash.allocate([[0, 5, 9, 20], [0, 1, 2, 3], [0, 7, 8, 9]], 0)
    assert sum(chosen) == 0 and best == min(a + b + c for x, a in zip((-1, 0, 1, 2), [0, 5, 9, 20], strict=True) for y, b in zip((-1, 0, 1, 2), [0, 1, 2, 3], strict=True) for z, c in zip((-1, 0, 1, 2), [0, 7, 8, 9], strict=True) if x + y + z == 0)


def test_similar_texts(spark):
    rng = random.Random(5)
    base = [f"v{rng.randint(0, 5000)}" for _ in range(400)]
    near = [*base[:200], "changed", *base[201:]]
    other = [f"v{rng.randint(0, 5000)}" for _ in range(400)]
    data = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(base)), (4, " ".join(base)), (None, "a"), (5, None), (6, "")]
    kept = simhash.drop_similar(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 3, 5, None]
    assert simhash.drop_similar(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def naive_tiling(a, b, least):
    fa, fb, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return total
        fa[i : i + n], fb[j : j + n] = [False] * n, [False] * n
        total += n


def test_tiling_against_naive():
    rng = random.Random(2)
    for _ in range(40):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(2))
        mine = dc.tile(dc.tokens(" ".join(a)), dc.tokens(" ".join(b)), 3)
        assert sum(n for _, _, n in mine) == naive_tiling(a, b, 3)


def test_decontamination(spark):
    item = [f"t{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, "x y z u v w q")], "item_id long, text string")
    filler = " filler one two three four "
    data = [(1, filler + " ".join(item[15:]) + filler + " ".join(item[:15]).upper()), (2, filler.join(item)), (3, None), (4, " ".join(item[:10])), (5, "")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    found = [tuple(r) for r in dc.contaminated(d, bench).collect()]
    assert found == [(1, 1, 30, 2, 30, 15, 1.0)]
    assert [tuple(r) for r in dc.contaminated(d, bench, broadcast_bytes=0).collect()] == found
    assert sorted(r["doc_id"] for r in dc.drop_contaminated(d, bench).collect()) == [2, 3, 4, 5]
    assert dc.contaminated(d, bench.limit(0)).isEmpty() and dc.contaminated(d.limit(0), bench).isEmpty()


def test_top_k(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 340)]
    data += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (None, [1.0] * 6), (403, [2.0, 1.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    good = {i: np.floor(64 * np.array([*v, *[0.0] * (6 - len(v))])) for i, v in data if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    for wave in (8192, 5):
        out = topk.top_k(table, table.filter("vec_id % 20 = 0"), k=7, wave=wave).collect()
        for q in (i for i in good if i % 20 == 0):
            want = sorted(((-int(v @ good[q]), i) for i, v in good.items() if i != q))[:7]
            assert [(-r["score"], r["id"]) for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert topk.top_k(table.limit(0), table).isEmpty()
    big = spark.createDataFrame([(0, [1e6, 1.0]), (20, [1e6, 2.0])], "vec_id long, embedding array<double>")
    assert {(r["query_id"], r["score"]) for r in topk.top_k(big, big).collect()} == {(q, (64 * 10**6) ** 2 + 64 * 128) for q in (0, 20)}


def test_interpolation_against_counts(spark):
    d = docs(spark)
    for chunk in (10**6, 200):
        model = interpolation.fit(d, chunk=chunk, bucket=500)
        out = interpolation.score(model).collect()
        texts = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in d.collect()]
        c, pairs, starts = Counter(), Counter(), 0
        for i, w in texts:
            if interpolation.fold_of(i) != 2:
                c.update([*w, None])
                pairs.update(zip([0, *w], [*w, None], strict=True))
                starts += 1
        n, v = sum(c.values()), len(c)
        assert (model.n, model.v) == (n, v) and len(out) == len(texts)
        got = {r["doc_id"]: r for r in out}
        for i, w in texts:
            seq = [*w, None]
            assert got[i]["n_tokens"] == len(seq) and got[i]["n_known"] == sum(c[x] > 0 for x in seq)
            assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in seq))
            total = 0.0
            for h, x in zip([0, *w], seq, strict=True):
                ch = starts if h == 0 else c[h]
                l0, l1, l2 = model.weights[int(interpolation.bucket_of(np.array([ch]))[0])]
                total += math.log10(l0 / (v + 1) + l1 * c[x] / n + l2 * (pairs[h, x] / ch if ch else 0))
            assert got[i]["score"] == pytest.approx(total)
        assert np.allclose(model.weights.sum(1), 1)
    assert interpolation.score(interpolation.fit(empty(spark))).isEmpty()


def labelled(n=300):
    rng = random.Random(4)
    make = {"xx": "aeiou", "yy": "bcdfg"}
    return [(i, " ".join("".join(rng.choices(make[k] + "mn", k=6)) for _ in range(rng.randint(1, 80))), k) for i in range(n) for k in [("xx", "yy")[i % 2]]]


def test_language(spark):
    df = spark.createDataFrame(labelled() + [(900, None, "xx"), (901, "12 !!", "yy"), (902, "z" * 100_000, None), (None, "aeiou aeiou", "xx")], "doc_id long, text string, lang string")
    model = language.learn(df)
    out = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    held = [i for i, _, _ in labelled() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([out[i]["_language"]["lang"] == out[i]["lang"] for i in held]) > 0.97
    assert out[900]["_language"]["lang"] == out[901]["_language"]["lang"] == "und" and 0 <= out[902]["_language"]["score"] <= 1
    none = language.learn(df.limit(0))
    assert {r["_language"]["lang"] for r in language.identify(df, none).collect()} == {"und"}


def test_network_gradients():
    model = language.ByteCNN(["a", "b"], seed=3)
    x, y = np.random.default_rng(0).integers(97, 120, (4, language.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])
    loss = lambda: -np.log(model.probabilities(x)[np.arange(4), y]).mean()
    grads = model.gradients(x, y)
    for key in ("kernel", "out", "bias", "embed"):
        at = np.unravel_index(np.abs(grads[key]).argmax(), grads[key].shape)
        old = model.p[key][at]
        model.p[key][at] = old + 1e-2
        up = loss()
        model.p[key][at] = old - 1e-2
        down = loss()
        model.p[key][at] = old
        assert (up - down) / 2e-2 == pytest.approx(grads[key][at], rel=0.1)


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "mat", "hat"]) + rng.choice("abcde") for _ in range(rng.randint(20, 80)))
    bad = lambda: " ".join(rng.choice(["$$$", "###", "!!!"]) + rng.choice("vwxyz") for _ in range(rng.randint(20, 80)))
    data = [(i, good() if i % 2 else bad(), i % 2) for i in range(400)]
    df = spark.createDataFrame(data + [(900, None, 1), (901, "", None), (None, "x", 0)], "id long, text string, label int")
    out = {r["id"]: r["score"] for r in quality.score_quality(df, quality.fit(df.filter("id < 200 or id is null"))).collect()}
    assert np.mean([(out[i] >= 0.5) == bool(i % 2) for i in range(200, 400)]) > 0.95
    assert out[900] == out[901] and all(0 <= s <= 1 for s in out.values())
    assert 0 <= quality.score_quality(df, quality.fit(df.limit(0))).first()["score"] <= 1


def test_quotation(spark):
    data = [
        (1, 0, "user", "Hello there.\nHow do I join tables?"),
        (1, 1, "assistant", "Ann wrote:\n> How do I JOIN tables?\nWith a key."),
        (1, 2, "user", "> > How do I join tables?\n> With a key.\n\nThanks!"),
        (1, 3, "user", None),
        (2, 5, "user", "> With a key.\nAgreed."),
        (2, 6, "user", "> nobody said this"),
        (2, 6, "user", "> nobody said this"),
        (None, 1, "user", "x"),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["turn"]): r for r in quotation.threads(quotation.link_quotes(df)).collect()}
    assert len(out) == 6 and out[1, 1]["text"] == "With a key." and out[1, 2]["text"] == "Thanks!"
    link = lambda k: (out[k]["parent_conv"], out[k]["parent_turn"], out[k]["linked_by"])
    assert [link(k) for k in sorted(out)] == [(None, None, None), (1, 0, "quote"), (1, 1, "quote"), (1, 2, "order"), (1, 1, "quote"), (2, 5, "order")]
    assert [out[k]["depth"] for k in sorted(out)] == [0, 1, 2, 3, 2, 3] and out[2, 6]["thread_conv"] == 1
    assert [out[k]["position"] for k in sorted(out)] == [0, 1, 2, 3, 0, 1] and out[1, 2]["n_quotes"] == 2
    assert quotation.threads(quotation.link_quotes(df.limit(0))).isEmpty()


def test_licenses(spark):
    data = [(1, "LICENSE", "Released under the MIT License."), (2, "a/LICENSE.txt", "x\nLicensed under the Apache License, Version 2.0. More."), (3, "a/b/c.py", "code"), (4, "d/e.py", None), (5, "a/b/f.py", "# Licensed under CC BY-NC 4.0."), (6, None, "code"), (7, "a/COPYING", "nothing"), (8, "ab/c.py", "my license to kill a mockingbird in town")]
    out = {r["id"]: tuple(r)[2:] for r in licenses.scan(spark.createDataFrame(data, "k long, path string, text string"), "k").collect()}
    assert out[1][0] == "MIT" and out[2][0] == "Apache-2.0" and out[3][0] == "Apache-2.0" and out[3][2:] == ("inherited", "a")
    assert out[4][0] == "MIT" and out[4][3] == "" and out[5][0] == "CC-BY-NC-4.0" and out[6] == (None, None, None, None)
    assert out[7][0] == "Apache-2.0" and out[8][0] == "MIT" and out[8][2] == "inherited"


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    bench = {r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    docs_in = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept, names = docs_in, []
    for name, stage in cp.STAGES:
        out = stage(spark, kept, "/root/testdata/sf0.001").cache()
        names.append(name)
        if name != "sharding":
            assert out.columns == docs_in.columns
        if name == "decontamination":
            assert not any(b in r["text"] for r in out.collect() for b in bench)
        kept = out
    assert len(names) == 5 and kept.filter(F.col("shard").isNull()).isEmpty() and kept.count() > 100

def shingles_of(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def jaccard(a, b):
    a, b = shingles_of(a), shingles_of(b)
    return len(a & b) / len(a | b)


def changed(rng, words, n):
    """The words with ``n`` of them, more than a shingle apart, replaced."""
    out = list(words)
    for k in rng.sample(range(1, len(words) // 6 - 1), n):
        out[6 * k + 2] = f"c{rng.getrandbits(40)}"
    return " ".join(out)


def test_variants_of_one_text_all_meet(spark):
    rng = random.Random(8)
    words = [f"v{rng.getrandbits(30)}" for _ in range(240)]
    data = [(0, " ".join(words))] + [(i, changed(rng, words, 4 + i % 2 + 2 * (i > 420))) for i in range(1, 451)]
    near = [jaccard(t, data[0][1]) for _, t in data]
    parent = {i: i for i, _ in data}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    sets = [shingles_of(t) for _, t in data]
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    got = {r["id"]: r["component_id"] for r in simhash.similar_texts(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in parent} and sum(0.8 <= x <= 0.85 for x in near) == 420 and sum(x < 0.8 for x in near) == 30


def test_isolated_pairs_near_the_limit_are_found(spark):
    rng, data = random.Random(9), []
    for i in range(600):
        words = [f"v{rng.getrandbits(40)}" for _ in range(460 if i % 2 else 230)]
        data += [(2 * i, " ".join(words)), (2 * i + 1, changed(rng, words, 10 if i % 2 else 5))]
    assert all(0.8 <= jaccard(data[k][1], data[k + 1][1]) <= 0.81 for k in range(0, 1200, 2))
    got = {r["id"]: r["component_id"] for r in simhash.similar_texts(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(got[k + 1] == k for k in range(0, 1200, 2)) == 600


def test_near_dedup_takes_null_ids(spark):
    rng = random.Random(10)
    a, b, c = ([f"{k}{rng.getrandbits(30)}" for _ in range(120)] for k in "abc")
    one = lambda words: " ".join(words)
    near = lambda words: changed(rng, words, 1)
    data = [(None, one(a)), (7, near(a)), (3, one(a)), (None, near(a)), (None, one(b)), (None, one(b)), (None, near(b)), (None, one(c)), (3, one(c)), (None, None), (None, "")]
    kept = [(r["doc_id"], (r["text"] or "")[:1]) for r in simhash.drop_similar(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    assert sorted(kept, key=repr) == [(3, "a"), (3, "c"), (None, ""), (None, "b")]
    found = simhash.similar_texts(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r["component_id"] for r in found), key=repr) == [3] * 6 + [None] * 5


def test_decontamination_ways_agree_on_null_and_repeated_ids(spark):
    long = [" ".join(f"{k}{i}" for i in range(20)) for k in "abc"]
    bench = spark.createDataFrame([(None, long[0]), (1, long[1]), (1, long[2]), (2, long[2]), (None, None)], "item_id long, text string")
    data = [(None, long[0]), (None, "clean one two three four five"), (5, long[1]), (5, "clean"), (5, long[2]), (5, long[2]), (6, long[0]), (7, None), (None, None), (8, "x " + long[2])]
    d = spark.createDataFrame(data, "doc_id long, text string")
    ways = [sorted(map(repr, dc.contaminated(d, bench, broadcast_bytes=size).collect())) for size in (dc.BROADCAST_BYTES, 0)]
    kept = [sorted(map(repr, dc.drop_contaminated(d, bench, broadcast_bytes=size).collect())) for size in (dc.BROADCAST_BYTES, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == 9 and kept[0] == kept[1] and len(kept[0]) == 4


def test_licenses_full_texts(spark):
    body = dict(reversed(licenses.bodies()))
    wrap = lambda text, mark: "\n".join(f"{mark}{' '.join(p.split()[i : i + 11])}" for p in text.split("\n\n") for i in range(0, len(p.split()), 11))
    bsd = "Copyright (c) 2020, Ann Other.\n" + wrap(body["BSD-3-Clause"], "")
    mit = "# Copyright (c) 2021 Ann\n#\n" + wrap(body["MIT"], "# ") + "\n\nimport x\nx.run()\n"
    grant = "Copyright 2021 Ann\n\n" + wrap(body["MIT"].split("\n\n")[0], "") + "\n\ncode"
    data = [(1, "a/LICENSE", bsd), (2, "a/b.py", "code"), (3, "c/d.py", mit), (4, "c/e.txt", grant), (5, "f/COPYING", body["GPL-3.0"]), (6, "g/h.c", "/* " + wrap(body["BSD-2-Clause"], " * ") + " */\nint x;"), (7, "g/i.c", "Copyright Ann. All rights reserved.")]
    out = {r["k"]: (r["license"], r["basis"]) for r in licenses.scan(spark.createDataFrame(data, "k long, path string, text string"), "k").withColumnRenamed("id", "k").collect()}
    assert out == {1: ("BSD-3-Clause", "own"), 2: ("BSD-3-Clause", "inherited"), 3: ("MIT", "own"), 4: ("MIT", "own"), 5: ("GPL-3.0", "own"), 6: ("BSD-2-Clause", "own"), 7: ("Proprietary", "own")}


def test_quotes_of_later_conversations_count(spark):
    data = [(3, 0, "u", "hi"), (3, 1, "u", "> Use a window.\nok"), (7, 0, "u", "Use a window."), (7, 1, "u", "> ok\nfine")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["turn"]): r for r in quotation.threads(quotation.link_quotes(df)).collect()}
    assert out[3, 1]["n_linked"] == 1 and (out[3, 1]["parent_conv"], out[3, 1]["parent_turn"], out[3, 1]["linked_by"]) == (3, 0, "order")
    assert out[7, 1]["n_linked"] == 1 and (out[7, 1]["parent_conv"], out[7, 1]["parent_turn"], out[7, 1]["linked_by"]) == (3, 1, "quote")


def test_texts_in_an_unknown_script_go(spark):
    rows = labelled() + [(900, "\u041f\u0440\u0438\u0432\u0435\u0442, \u043a\u0430\u043a \u0434\u0435\u043b\u0430", None), (901, "\u4f60\u597d\u4e16\u754c", None), (902, None, None), (903, "7 + 5", None), (904, "aeiou mnaei", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_language", F.lit(1)).withColumn("_LANGUAGE_", F.lit(2))
    kept = language.keep_known(d, language.learn(d), 0.5)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {*range(300), 904}


def test_first_ids_whatever_repeats(spark):
    rows = [(i % 700, "a") for i in range(3000)] + [(5, "b")] * 2000 + [(i, "c") for i in range(40)]
    d = spark.createDataFrame(rows, "id long, k string")
    order = {r["id"]: r["h"] for r in d.select("id", F.xxhash64("id", F.lit(7)).alias("h")).collect()}
    want = {"a": sorted(range(700), key=order.get)[:600], "b": [5], "c": sorted(range(40), key=order.get)}
    assert first_ids(d, "k", 600) == want and first_ids(d.limit(0), "k", 3) == {}
    with pytest.raises(ValueError):
        first_ids(d, "k", 600, most=2)


def test_sketches_sift_no_similar_pair():
    rng, worst = np.random.default_rng(4), 0
    for _ in range(300):
        both, a, b = rng.integers(0, 2**32, 800), rng.integers(0, 2**32, 100), rng.integers(0, 2**32, 100)
        x, y = (simhash.sketch(np.unique(np.concatenate([both, z])).astype(np.uint32)) for z in (a, b))
        worst = max(worst, int(np.bitwise_count(x ^ y).sum()))
    assert worst <= simhash.most_differing(0.8) < 150


def slow_walk(rows, shards, vnodes, cells):
    """Shard of every row, one row at a time: in rounds, rows turned away go to the next shard clockwise of their cell."""
    points = sharding.ring_points(shards, vnodes, cells)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    home, waiting = {}, []
    for i, cell in sorted(enumerate(rows), key=lambda x: (x[1], x[0])):
        at = next((k for k, (c, _) in enumerate(points) if c >= cell), 0)
        waiting.append((i, [s for k, (_, s) in enumerate(points[at:] + points[:at])]))
    while waiting:
        left = []
        for i, ring in waiting:
            if room[ring[0]]:
                room[ring[0]] -= 1
                home[i] = ring[0]
            else:
                left.append((i, ring[next(k for k, s in enumerate(ring) if s != ring[0]) :]))
        waiting = left
    return home


@pytest.mark.parametrize("cells", [16384, 50])
def test_sharding_against_a_slow_walk(spark, cells):
    d = spark.createDataFrame([(i % 90, f"t{i}") for i in range(200)], "doc_id long, text string")
    out = sharding.shard_ring(d, 5, vnodes=8, cells=cells).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells))).collect()
    # Rows of a cell are alike to the ring, so what is compared is how many rows of each cell a shard has.
    home = slow_walk([r["cell"] for r in out], 5, 8, cells)
    assert Counter((r["cell"], r["shard"]) for r in out) == Counter((out[i]["cell"], s) for i, s in home.items())


def test_sharding_query_by_brute_force(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op3_shard_ring(spark, str(tmp_path)).collect()
    texts = Counter((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs(spark).collect())
    assert Counter((r["size"], r["text_crc32"]) for r in out) == texts and {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}


def clashing(spark, *names):
    return docs(spark, n=40, longest=50).drop("shard", "slot").select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


def test_clashing_names(spark):
    names = ("_source", "_key", "_id", "_part", "_last", "_row", "_REPEATS", "row", "from")
    d = clashing(spark, *names)
    out = mixing.mix_sources(d)
    assert out.columns == [*d.columns[:-3], "_in__REPEATS", "row", "from", "_source_size", "_target", "_repeats"] and {r["_source"] for r in out.select("_source").collect()} == {0}
    assert mixing.mixed_rows(d).columns == d.columns and mixing.mixed_rows(d).select("_id").distinct().count() == 1
    d = clashing(spark, "_cell", "_key", "_rank", "_slot", "_from", "_row", "SIZE")
    out = sharding.shard_ring(d)
    assert out.columns == [*d.columns[:-1], "_in_SIZE", "size", "text_crc32", "shard", "slot"] and out.filter("_cell <> 0 or _slot <> 3").isEmpty()
    d = clashing(spark, "_text_key", "id", "text_key")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert dc.drop_contaminated(d, bench, broadcast_bytes=0).columns == d.columns and dc.drop_contaminated(d, bench, broadcast_bytes=0).filter("_text_key <> 0").isEmpty()
    scored = quality.score_quality(clashing(spark, "score"), quality.fit(spark.createDataFrame([], "id long, text string, label int")), out_col="found")
    assert scored.filter("score <> 0").isEmpty() and "found" in scored.columns
    d = clashing(spark, "id", "_mark", "least")
    assert simhash.drop_similar(d).columns == d.columns


def test_repeated_query_ids_get_a_list_each(spark):
    table = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    for wave in (8192, 1):
        out = topk.top_k(table, table.filter("vec_id = 20"), k=2, wave=wave).collect()
        assert sorted((r["rank"], r["id"], r["score"]) for r in out) == [(1, 1, 8192), (1, 2, 12288), (2, 3, 4096), (2, 3, 4096)]


def test_repetitive_tiling_is_quick():
    import time

    a, b = dc.tokens("a " * 1200), dc.tokens("a " * 4800)
    began = time.time()
    assert dc.tile(a, b) == [(0, 0, 1200)] and time.time() - began < 1
    rng = random.Random(3)
    for pairs in (0, 10**9):
        for _ in range(40):
            x, y = ([rng.choice("ab") for _ in range(rng.randint(0, 40))] for _ in range(2))
            old, dc.PAIRS = dc.PAIRS, pairs
            try:
                mine = dc.tile(dc.tokens(" ".join(x)), dc.tokens(" ".join(y)), 3)
            finally:
                dc.PAIRS = old
            assert sum(n for _, _, n in mine) == naive_tiling(x, y, 3)


def test_decontamination_query_by_brute_force(spark, tmp_path):
    rng = random.Random(12)
    items = [(i, " ".join(rng.choices("abcdefghijklmnop", k=rng.choice([3, 5, 12, 30])))) for i in range(25)] + [(25, "x y " * 30), (26, None)]
    texts = [(i, " ".join(rng.choices("abcdefghijklmnop", k=30))) for i in range(30)]
    for i in range(30, 90):
        words = items[rng.randrange(26)][1].split()
        cut = rng.randrange(len(words))
        texts.append((i, " ".join([*rng.choices("qrstu", k=5), *words[cut:], *rng.choices("qrstu", k=5), *words[: rng.randint(0, cut)]])))
    texts += [(90, None), (91, ""), (92, "x y " * 45), (None, items[25][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["item_id"]): r["tiled"] for r in dc.op6_greedy_tiling(spark, str(tmp_path)).collect()}
    want = {}
    for i, t in texts:
        for k, x in items:
            a = (x or "").split()
            n = naive_tiling(a, (t or "").split(), 5)
            if n and n >= 0.5 * len(a):
                want[i, k] = n
    assert got == want and len(want) > 30
    joined = dc.contaminated(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"), broadcast_bytes=0)
    assert {(r["doc_id"], r["item_id"]): r["tiled"] for r in joined.collect()} == want


def slow_links(rows):
    """Parents of every message and its number of linked passages, by looking through all messages."""
    said = {k: {u["hash"] for u in quotation.parse(t)[1]} for k, t in rows.items()}
    out = {}
    for (conv, turn), text in rows.items():
        linked, best = 0, None
        for q in quotation.parse(text)[2]:
            found, any_found = None, False
            for u in q["units"]:
                sayers = sorted(k for k, h in said.items() if u["hash"] in h)
                here = [k for k in sayers if k[0] == conv and k[1] < turn and k == min(s for s in sayers if s[0] == conv)]
                origin = here[0] if here else sayers[0] if sayers and sayers[0] < (conv, turn) else None
                any_found |= bool(origin or (sayers and sayers[0] != (conv, turn)))
                if origin and (found is None or (u["words"], u["hash"]) > found[0]):
                    found = ((u["words"], u["hash"]), origin)
            linked += any_found
            if found and q["level"] == 1 and (best is None or (found[0][0], -q["quote"]) > best[0]):
                best = ((found[0][0], -q["quote"]), found[1])
        before = max((t for c, t in rows if c == conv and t < turn), default=None)
        out[conv, turn] = (linked, best[1] if best else (conv, before) if before is not None else None)
    return out


def test_quotation_query_by_brute_force(spark, tmp_path):
    rng = random.Random(7)
    lines = [f"line {i} of what was said" for i in range(25)]
    rows = {}
    for conv in range(12):
        for turn in range(rng.randint(1, 8)):
            body = [rng.choice(["", "> ", "> > "]) + rng.choice(lines) for _ in range(rng.randint(1, 5))]
            rows[conv, turn * 2] = "\n".join(body)
    data = [(c, t, "user", x) for (c, t), x in rows.items()]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {(r["conv_id"], r["turn"]): r for r in quotation.op2_quotation_links(spark, str(tmp_path)).collect()}
    want = slow_links(rows)
    parent = lambda r: (r["parent_conv"], r["parent_turn"]) if r["parent_turn"] is not None else None
    assert {k: (r["n_linked"], parent(r)) for k, r in out.items()} == want
    depth = lambda k: 0 if want[k][1] is None else 1 + depth(want[k][1])
    root = lambda k: k if want[k][1] is None else root(want[k][1])
    for conv in range(12):
        mine = sorted((k for k in rows if k[0] == conv), key=lambda k: (root(k), depth(k), k[1]))
        assert [out[k]["position"] for k in mine] == list(range(len(mine))) and all(out[k]["depth"] == depth(k) for k in mine)


def test_fingerprint_bits(spark):
    import xxhash

    texts = ["One  two\tTHREE four", "one two", "", None, "É a b c É a b"]
    got = {r["id"]: r["fp"] % 2**64 for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).split()
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    empty(spark).write.parquet(f"{d}/documents.parquet")
    for name, schema in {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "conversations": "conv_id long, turn long, role string, text string", "embeddings": "vec_id long, embedding array<float>, label int"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    from shelfmark.llm.catalogue import QUERIES

    for name, query in QUERIES.items():
        assert query(spark, d).isEmpty(), name


def test_every_full_licence_text_is_found_and_prose_is_not(spark):
    files = [(i, f"p{i}/LICENSE", text, name) for i, (name, text) in enumerate(licenses.bodies())]
    prose = "She read the licence on the wall, asked for permission to copy it, and went home. The rights of the reader were never in doubt. " * 20
    files += [(90, "q/notes.txt", prose, None), (91, "r/LICENSE", prose, None), (92, "s/x.py", None, None), (92, "s/x.py", "x = 1", None)]
    df = spark.createDataFrame(files, "k long, path string, text string, want string")
    out = licenses.scan(df, "k").collect()
    assert len(out) == len(files) and {r["id"]: r["license"] for r in out} == {k: want for k, _, _, want in files}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0"} <= {want for *_, want in files}


def test_quality_and_language_queries(spark):
    d = "/root/testdata/sf0.001"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = language.op7_language_cnn(spark, d).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and truth[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.9
    out = quality.op10_quality_zstd(spark, d).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_near_dedup_against_exhaustive_search(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: (r["text"] or "").lower().split() for r in rows.collect()}
    parts = {i: shingles_of(" ".join(w)) if w else None for i, w in texts.items()}
    holders, parent = {}, {i: i for i in parts}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i, mine in parts.items():
        for j in {j for s in mine or ["nothing"] for j in holders.get(s, ())}:
            both = len(mine & parts[j]) if mine else 1
            if not mine or both >= 0.8 * (len(mine) + len(parts[j]) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
        for s in mine or ["nothing"]:
            holders.setdefault(s, []).append(i)
    got = {r["id"]: r["component_id"] for r in simhash.similar_texts(rows).collect()}
    assert got == {i: find(i) for i in parts} and len(set(got.values())) < len(got)


def test_near_dedup_gets_its_pairs_from_fingerprints_alone(spark, monkeypatch):
    rng, data = random.Random(30), []
    for i in range(60):
        words = [f"v{rng.getrandbits(40)}" for _ in range(120)]
        data += [(2 * i, " ".join(words)), (2 * i + 1, changed(rng, words, 1))]
    for i in range(60, 360):  # four and five shingles, of which four are shared
        words = [f"v{rng.getrandbits(40)}" for _ in range(9)]
        data += [(2 * i, " ".join(words[:8])), (2 * i + 1, " ".join(words))]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r["id"]: r["component_id"] for r in simhash.similar_texts(d).collect()}
    assert got == {i: i - i % 2 for i in range(720)}
    monkeypatch.setattr(simhash, "wide_links", lambda *_: spark.createDataFrame([], "a long, b long, n long"))
    assert simhash.drop_similar(d).count() == 720


def test_wide_fingerprints_by_brute_force(spark):
    rng, m = random.Random(31), 4
    texts = []
    for _ in range(40):
        words = [f"v{rng.getrandbits(40)}" for _ in range(150)]
        texts += [" ".join(words), *(changed(rng, words, rng.randint(1, 10)) for _ in range(3))]
    sets = [np.unique(simhash.hashes(t, 5)) for t in texts]
    differ, worst, few = simhash.bit_odds(0.8)
    fps = np.array([simhash.wide_fingerprint(h, simhash.words_needed(m, differ)) for h in sets])
    for h, fp in zip(sets, fps, strict=True):
        for k in (0, len(fp) - 1):
            x = simhash.remix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64), 0).tolist()
            ones = [2 * sum(v >> b & 1 for v in x) for b in range(64)]
            tie = int(simhash.remix(h[:1] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64), 0)[0])
            assert int(fp[k]) == sum((n > len(x) or n == len(x) and tie >> b & 1) << b for b, n in enumerate(ones))
    plan = simhash.plan_wide(fps, 10**6, m)
    for k in range(fps.shape[1]):
        parts = [(part, t) for word, part, t in plan if word == k]
        assert len({b for part, _ in parts for b in part}) == sum(len(part) for part, _ in parts) <= 64
        assert sum(t for _, t in parts) - (m - len(parts)) == 0  # thresholds for m - 1 bits; a partition that is not looked at has -1
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = simhash.wide_links(rows, rows, len(texts), 5, 0.8, m).collect()
    root = simhash.components(spark.createDataFrame([(r["a"], r["b"]) for r in found], "a long, b long"), "a", "b").collect()
    root = {r["node"]: r["root"] for r in root}
    of = [root.get(x, x) for x in (int(simhash.digest(t)[0]) for t in texts)]
    apart = np.bitwise_count(fps[:, None] ^ fps[None])
    sure = [(i, j) for i in range(len(fps)) for j in range(i) if (apart[i, j] < m).any() and apart[i, j, : simhash.CHECK].sum() <= 40]
    alike = [(i, j) for i in range(len(fps)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert len(sure) > 10 and len(alike) > 20 and all(of[i] == of[j] for i, j in sure + alike)


def test_crowded_signatures_connect_as_pairs_do():
    rng = np.random.default_rng(32)
    found = np.zeros(600, simhash._SIGNATURE)
    found["key"], found["node"], found["check"] = rng.integers(0, 60, 600), rng.integers(0, 400, 600), 1
    (a, b, n), *others = (simhash.meet(found, 0, crowd, held) for crowd, held in ((4096, 10**6), (4096, 1), (3, 10**6)))
    assert (n > 0).all() and all((a == x).all() and (b == y).all() and (n == z).all() for x, y, z in others)
    found["check"][:, 0] = np.arange(600)
    assert len(simhash.meet(found, 0)[0]) == 0


def test_very_long_texts_are_taken_whole(spark):
    rng = random.Random(20)
    words = [f"w{rng.randint(0, 50_000)}" for _ in range(200_000)]
    long = " ".join(words)
    item = "alpha beta gamma delta epsilon zeta eta theta"
    d = spark.createDataFrame([(1, f"{long} {item}"), (2, long), (3, f"{long} {item} again"), (4, "short")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    for size in (dc.BROADCAST_BYTES, 0):
        assert sorted((r["doc_id"], r["tiled"]) for r in dc.contaminated(d, bench, broadcast_bytes=size).collect()) == [(1, 8), (3, 8)]
    files = d.withColumn("path", F.format_string("d%s/x.txt", "doc_id")).withColumn("text", F.concat("text", F.lit("\nReleased under the MIT License.")))
    assert {r["license"] for r in licenses.scan(files, "doc_id").collect()} == {"MIT"}
    talk = spark.createDataFrame([(1, 0, "u", f"{long}\nThe key is missing."), (1, 1, "u", f"{long}\nno quote"), (1, 2, "u", f"{long}\n> The key is missing.\nyes")], "conv_id long, turn long, role string, text string")
    assert {(r["turn"], r["parent_turn"], r["linked_by"]) for r in quotation.link_quotes(talk).collect()} == {(0, None, None), (1, 0, "order"), (2, 0, "quote")}
    assert {r["size"] for r in sharding.shard_ring(d, 2).filter("doc_id = 2").collect()} == {len(long) + 1}
    fps = {r["id"]: r["fp"] % 2**64 for r in simhash.fingerprints(d).collect()}
    assert fps[2] == simhash.fold_bits(simhash.hashes(long)) and {r["id"]: r["component_id"] for r in simhash.similar_texts(d).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    model = quality.fit(spark.createDataFrame([(i, "good text here" if i % 2 else "$$$ ###", i % 2) for i in range(60)], "id long, text string, label int"))
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(d, model).collect())


def test_ties(spark):
    files = spark.createDataFrame([(1, "a/LICENSE", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (2, "a/b.c", "x")], "k long, path string, text string")
    out = {r["id"]: (r["license"], r["score"]) for r in licenses.scan(files, "k").collect()}
    assert out == {1: ("CC-BY-NC-4.0", 1.0), 2: ("CC-BY-NC-4.0", 1.0)}
    x = dc.tokens("a b c d e a b c d e")
    assert dc.tile(dc.tokens("a b c d e"), x) == [(0, 0, 5)] and dc.tile(x, dc.tokens("a b c d e")) == [(0, 0, 5)]
    rows = [(i, "same text", "s") for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert Counter(r["shard"] for r in sharding.shard_ring(d, 4).collect()) == {0: 3, 1: 3, 2: 2, 3: 2}
    said = [(1, 0, "u", "hello world"), (1, 1, "u", "hello world"), (1, 2, "u", "> hello world\n> hello world\nhi")]
    linked = {r["turn"]: r["parent_turn"] for r in quotation.link_quotes(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()}
    assert linked == {0: None, 1: 0, 2: 0}
