"""Each operator against a brute-force version, on a corpus with every awkward row."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colinear.llm import decontaminate, langid, lines, mix, quality, shard, simhash, suffixes, toolcalls, topk

UP = {i: i + 32 for i in range(65, 91)}


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


# -- 1 sharding


def test_shards_hold_every_row_once_in_gapless_slots(docs, corpus):
    out = shard.shuffle_into_shards(docs, 5, bucket_bytes=4000).select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r[0], r[1]) for r in out) == Counter((r[0], r[1]) for r in corpus.rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = shard.shuffle_into_shards(docs.repartition(7), 5, bucket_bytes=4000).select("doc_id", "text", "shard", "slot").collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(3000).select(shard.shard_of(F.col("id"), 24, 7).alias("a"), shard.shard_of(F.col("id"), 25, 7).alias("b")).collect()
    assert all(r.a == r.b or r.b == 24 for r in ids)
    assert len({r.a for r in ids}) == 24 and 60 < sum(r.b == 24 for r in ids) < 190


def test_slots_are_shuffled_and_written(spark, docs, tmp_path):
    ids = spark.range(400).withColumnRenamed("id", "doc_id")
    out = shard.shuffle_into_shards(ids, 1, content=None, bucket_bytes=3200)
    order = [r.doc_id for r in out.orderBy("slot").collect()]
    assert sorted(order) == list(range(400)) and order != sorted(order)
    shard.write_shards(out, str(tmp_path / "s"), records_per_file=150)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 400


def test_hot_rows_spread_over_buckets(spark):
    data = [(None, "same text " * 20, i % 2) for i in range(9000)] + [(i, f"text {i}", 0) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, other int")
    out = shard.shuffle_into_shards(df, 3, bucket_bytes=100_000).collect()
    assert Counter((r.doc_id, r.text, r.other) for r in out) == Counter(data)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


# -- 2 repeated passages


def brute_spans(data, least=50):
    texts = {t for _, t, *_ in data if t is not None}
    words = {t: t.encode().lower().split() for t in texts}
    where = defaultdict(set)
    for t, w in words.items():
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(t)
    out = []
    copies = Counter(t for _, t, *_ in data)
    for d, t, *_ in data:
        if t is None or len(words[t]) < least:
            continue
        w = words[t]
        if copies[t] > 1:
            out.append((d, 0, len(w), True))
            continue
        hit = sorted({j for i in range(len(w) - least + 1) if len(where[tuple(w[i : i + least])]) > 1 for j in range(i, i + least)})
        start = None
        for a, b in zip([None, *hit], [*hit, None]):
            if b is not None and (a is None or b != a + 1):
                start = b
            if a is not None and (b is None or b != a + 1):
                out.append((d, start if b is None else start_of(hit, a), a + 1, False))
    return out


def start_of(hit, a):
    s = set(hit)
    while a - 1 in s:
        a -= 1
    return a


def test_repeated_passages_equal_all_shared_windows(docs, corpus):
    got = rows(suffixes.repeats(docs), "doc_id", "start", "end", "whole")
    want = sorted({x if x[3] else (x[0], start_of(set(range(x[1], x[2])), x[2] - 1), x[2], False) for x in brute_spans(corpus.rows)}, key=repr)
    assert {g[0] for g in got} == {w[0] for w in want}
    assert set(got) == set(want)


def spans_of(df):
    return {(r[0], r[1], r[2], r[3]) for r in suffixes.repeats(df).select("doc_id", "start", "end", "whole").collect()}


def wanted_spans(data):
    return {x if x[3] else (x[0], start_of(set(range(x[1], x[2])), x[2] - 1), x[2], False) for x in brute_spans(data)}


def test_variants_that_share_more_on_one_side_hide_no_passage(spark):
    """A passage whose partner is next in neither order: others share more to the right only, or to the left only."""
    import random

    rng = random.Random(21)
    data = []
    for c in range(220):
        new = lambda n: [f"c{c}w{rng.randint(0, 10**9)}" for _ in range(n)]
        left, passage, right = new(60), new(50 + c % 3), new(60)
        texts = [left + passage + right, new(60) + passage + new(60)]
        for _ in range(rng.randint(2, 5)):
            k = rng.randint(8, 40)
            texts.append(new(60) + passage[k:] + right[: rng.randint(1, min(k, 40))] + new(60))
            k = rng.randint(8, 40)
            texts.append(new(60) + left[len(left) - rng.randint(1, min(k, 40)) :] + passage[:-k] + new(60))
        rng.shuffle(texts)
        data += [(20 * c + i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert spans_of(df) == wanted_spans(data)


def test_long_and_periodic_passages_keep_their_true_ends(spark):
    import random

    from .conftest import prose

    rng = random.Random(2)
    new = lambda n: " ".join(f"x{rng.randint(0, 10**9)}" for _ in range(n))
    long, few = new(6000), prose(rng, 300)
    data = [(0, f"{new(7)} {long} {new(9)}"), (1, f"{long} {new(3)}"), (2, f"{new(70)} {new(4)}"), (3, "a b " * 400), (4, "b a " * 90 + new(60)),
            (5, "a b " * 30 + new(80)), (6, f"{few} {few} {few}"), (7, f"{new(5)} {few}"), (8, None), (9, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = spans_of(df)
    assert got == wanted_spans(data) and {(0, 7, 6007, False), (1, 0, 6000, False)} <= got


def test_repeats_of_empty_tables(docs, empty):
    assert suffixes.repeats(empty).count() == 0 and suffixes.repeats(empty).columns == ["doc_id", "start", "end", "whole"]
    assert suffixes.repeats(docs.select("doc_id", "text", F.lit(1).alias("start"), F.lit("x").alias("text_key"), F.lit(2).alias("seed"))).count() > 0


def test_minimisers_cover_every_window():
    rng = np.random.default_rng(1)
    for h in (rng.integers(0, 2**63, 300).astype(np.uint64), np.zeros(120, np.uint64), rng.integers(0, 3, 200).astype(np.uint64)):
        p = set(suffixes.minimisers(h, 43).tolist())
        assert all(p & set(range(i, i + 43)) for i in range(len(h) - 42))


# -- 3 mixing


def test_capped_shares_fill_up_by_weight():
    got = mix.capped_shares({"a": 10, "b": 1000, None: 100}, {"a": 3, "b": 1, None: 2}, 1110, 2.0)
    assert got["a"] == 20 and got[None] == 200 and got["b"] == pytest.approx(890)


def test_min_cost_flow_is_cheapest_and_greatest():
    flows = mix.min_cost_flow([10, 10, 5], [[0], [0, 1], [1]], [14, 11], 2)
    assert sum(f.get(0, 0) for f in flows) == 14 and sum(f.get(1, 0) for f in flows) == 11
    used = [sum(f.values()) for f in flows]
    assert all(u <= 20 for u in used) and sum(min(u, c) for u, c in zip(used, [10, 10, 5])) == 25  # nothing repeats while first copies are left


def test_mix_comes_near_targets_with_whole_documents(docs, corpus):
    sources = F.array("source")
    plan = mix.mix(docs, sources, mix.cycle_weights([3, 1, 2], 1.5, 2.0), docs_a_bucket=5)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken, largest = Counter(), Counter()
    for r in plan.times_of(docs, sources).select("source", "text", "__times").collect():
        assert r[2] in (0, 1, 2)
        taken[r[0]] += size(r[1]) * r[2]
        largest[r[0]] = max(largest[r[0]], size(r[1]))
    for s, want in plan.targets.items():
        assert abs(taken[s] - want) <= largest[s]
    assert mix.mixed(docs, sources, plan).columns == docs.columns


def test_many_patterns_are_solved_in_seconds():
    import random
    import time

    rng = random.Random(1)
    n, m = 10_000, 40
    capacity = [rng.randint(1, 1000) for _ in range(n)]
    members = [sorted(rng.sample(range(m), rng.randint(1, 4))) for _ in range(n)]
    quota = [rng.randint(1, 3 * sum(capacity) // m) for _ in range(m)]
    began = time.time()
    flows = min_cost = mix.min_cost_flow(capacity, members, quota, 2)
    assert time.time() - began < 60
    used = [sum(f.values()) for f in flows]
    assert all(u <= 2 * c for u, c in zip(used, capacity)) and all(sum(f.get(s, 0) for f in min_cost) <= q for s, q in enumerate(quota))


def test_equal_rows_are_told_apart(spark):
    """A share ends between rows equal in doc_id and text."""
    data = [(7, "w " * 10, "a")] * 40 + [(None, "x " * 10, "b")] * 30 + [(i, "y", "b") for i in range(5)] + [(None, None, None)] * 3
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    sources = F.array("source")
    plan = mix.mix(df, sources, lambda sizes, total: {"a": 333.0, "b": 472.0, None: 0.0}, docs_a_bucket=1)
    for out in (plan.times_of(df, sources), plan.times_of(df.coalesce(1), sources)):
        got = Counter()
        for r in out.select("source", "text", "__times").collect():
            got[r.source] += len((r.text or "").split()) * r["__times"]
        assert abs(got["a"] - 333) <= 5 and abs(got["b"] - 472) <= 5


def test_mix_of_overlapping_sources(spark):
    data = [(i, "word " * 10, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"]) for i in range(90)]
    df = spark.createDataFrame(data, "doc_id long, text string, sources array<string>")
    plan = mix.mix(df, F.col("sources"), lambda sizes, total: {"a": 500.0, "b": 350.0})
    got = Counter()
    for members, source, tokens in plan.flows:
        assert source in members
        got[source] += tokens
    assert got == {"a": 500, "b": 350}
    assert sum(r[0] for r in plan.times_of(df, F.col("sources")).select("__times").collect()) == pytest.approx(85, abs=2)
    routed = Counter()
    for r in mix.mixed(df, F.col("sources"), plan, routed="for").collect():
        assert r["for"] in r.sources
        routed[r["for"]] += 10
    assert abs(routed["a"] - 500) <= 20 and abs(routed["b"] - 350) <= 20


# -- 4 quality


def test_quality_model_orders_grades_and_holds_out(spark):
    rng = np.random.default_rng(3)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 30))
    data = []
    for i in range(600):
        grade = i % 3
        text = good() + (" horrid" if grade == 0 else " ### $$$ !!" * 4 if grade == 1 else "")
        data.append((i, text, grade))
    df = spark.createDataFrame(data, "doc_id long, text string, grade int")
    model = quality.train(df, df.where("doc_id < 400").select("doc_id", "grade"), 3)
    assert model.thresholds[0] < model.thresholds[1]
    out = quality.score(df.where("doc_id >= 400"), model).select("grade", "expected_grade", "tail").collect()
    assert np.mean([round(r[1]) == r[0] for r in out]) > 0.95
    assert all(1 >= r.tail[0] >= r.tail[1] >= 0 and abs(sum(r.tail) - r.expected_grade) < 1e-9 for r in out)


def test_fit_is_the_maximum_of_the_penalised_likelihood():
    """An independent likelihood: no small step from the fit betters it by much, and far ones lose."""
    rng = np.random.default_rng(4)
    rows_ = [np.sort(rng.choice(40, rng.integers(1, 12), replace=False)) for _ in range(300)]
    grades = np.array([int(np.clip(round(sum(x < 10 for x in r) / 2 + rng.normal() * 0.5), 0, 2)) for r in rows_])
    model = quality.fit(rows_, grades, 3, least_docs=1, rounds=3000, rate=0.05, ridge=1e-2)

    def loss(w, theta):
        total = 0.0
        for r, g in zip(rows_, grades):
            s = sum(w[list(model.ids).index(x)] for x in r)
            upto = [0.0] + [1 / (1 + np.exp(-(t - s))) for t in theta] + [1.0]
            total -= np.log(upto[g + 1] - upto[g])
        return total / len(rows_) + 1e-2 * sum(x * x for x in w) / 2

    best = loss(model.weights, model.thresholds)
    for _ in range(12):
        step = rng.normal(size=len(model.weights)) * 0.05
        assert loss(model.weights + step, model.thresholds) > best - 1e-4
        assert loss(model.weights, np.sort(model.thresholds + rng.normal(size=2) * 0.1)) > best - 1e-4
    assert best < loss(np.zeros(len(model.weights)), model.thresholds) - 0.1


def test_scores_equal_a_plain_scorer(spark):
    data = [(i, t) for i, t in enumerate(["alpha beta BETA!!", "gamma 42 ### delta", None, "", "  ", "alpha " * 5000 + "omega"])]
    rated = [(i + 100, ("alpha beta" if i % 2 else "gamma delta ###") + f" x{i}") for i in range(200)]
    df = spark.createDataFrame(data + rated, "doc_id long, text string")
    model = quality.train(df, spark.createDataFrame([(i, 2 if (i % 2) else 0) for i, _ in rated], "doc_id long, grade int"), 3)
    weight = dict(zip(model.ids.tolist(), model.weights.astype(np.float32).tolist()))
    features = quality.Featurizer()
    for r in quality.score(df, model).collect():
        ids = features((r.text or "").encode()).tolist()
        tails = [1 / (1 + np.exp(t - sum(weight.get(i, 0.0) for i in ids))) if ids else 0.0 for t in model.thresholds]
        assert r.tail == pytest.approx(tails, abs=1e-5) and r.expected_grade == pytest.approx(sum(tails), abs=1e-5)


def test_training_rows_are_bounded(spark):
    df = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("word").alias("text")).union(
        spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string"))
    grades = spark.createDataFrame([(i, i % 3) for i in range(50)] * 3 + [(5, 0), (None, 1), (7, None)], "doc_id long, grade int")
    seen = []
    whole = quality.fit
    try:
        quality.fit = lambda rows_, grades_, *a, **k: seen.append(len(rows_)) or whole(rows_, grades_, *a, **k)
        quality.train(df, grades, 3, max_train=20)
        quality.train(df, grades, 3)
    finally:
        quality.fit = whole
    assert seen == [20, 50]


def test_quality_of_awkward_rows(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = quality.train(docs, none, 3)
    out = quality.score(docs.select("doc_id", "text", "tail"), model).select("text", "tail").collect()
    assert all((r.tail[1] > 0.99) == bool((r.text or "").split()) for r in out)
    assert quality.score(empty, model).count() == 0


# -- 5 top-k


def brute_topk(v, k=10):
    """Of rows (id, vector), ids divisible by 100 ask; each meets every row but its own."""
    out = []
    for i, (q, x) in enumerate(v):
        if q is None or q % 100:
            continue
        cand = sorted((-sum(a * b for a, b in zip(x, y)), c) for j, (c, y) in enumerate(v) if c is not None and i != j)[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(cand)]
    return sorted(out, key=repr)


def with_rows(spark, v):
    return spark.createDataFrame([(i, x, n) for n, (i, x) in enumerate(v)], "id long, v array<long>, row long").withColumn("g", F.lit("mine"))


def test_topk_equals_brute_force_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    v = [(int(i), [int(x) for x in rng.integers(-3, 4, 6)]) for i in range(0, 900, 7)] + [(100, [0] * 6), (None, [1] * 6), (700, [1] * 6), (700, [1] * 6)]
    v += [(1001, [1, 2, 3, 0, 0, 0]), (1002, [1, 2, 3, 0, 0, 0]), (1003, [5])]
    df = with_rows(spark, v)
    assert rows(topk.search(df, df.where("id % 100 = 0"), k=10, rows_a_block=17, queries_a_block=2)) == brute_topk(v)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0 and topk.search(df, df.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    v = [(100, [2**40, 3, 0]), (1, [2**22, 7, 1]), (2, [-(2**22), 1, 1]), (3, [5, 5, 2**40])]
    df = with_rows(spark, v)
    assert rows(topk.search(df, df.where("id = 100"))) == brute_topk(v)
    with pytest.raises(Exception, match="64 bits"):
        big = with_rows(spark, [(100, [2**40]), (1, [2**40])])
        topk.search(big, big.where("id = 100")).collect()


def test_usable_and_quantised(spark):
    data = [(1, [0.5, -0.0001]), (2, None), (3, [None, 1.0]), (4, [float("nan")]), (5, [float("inf")]), (6, [])]
    df = spark.createDataFrame(data, "id long, e array<float>").where(topk.usable(F.col("e")))
    assert rows(df.select("id", topk.quantised(F.col("e")))) == [(1, [512, -1]), (6, [])]


# -- 6 language


def plain_phrases(ref, c):
    n, i, s = 0, 0, ref.astype(np.uint16).tobytes()
    inside = lambda x: any(s.startswith(x, k) for k in range(0, len(s), 2)) if s.find(x) % 2 else s.find(x) >= 0
    while i < len(c):
        j = i + 1
        while j < len(c) and inside(c[i:j].tobytes()) and inside(c[i : j + 1].tobytes()):
            j += 1
        i, n = j, n + 1
    return n


def test_cross_parsing_counts_phrases_of_whole_texts_like_a_plain_parser():
    rng = np.random.default_rng(4)
    ref = np.concatenate([rng.integers(1, 5, 200), [300, 301, 300], np.tile([1, 2, 3], 9)]).astype(np.uint16)
    parser = langid.CrossParser(None, ["x"], [langid.automaton(ref, 400)], [200])
    texts = [rng.choice([1, 2, 3, 4, 5, 300, 301], n, p=[0.3, 0.3, 0.2, 0.15, 0.02, 0.02, 0.01]).astype(np.uint16)
             for n in (1, 2, 30, 64, 65, 300, 513, 2000)]
    texts += [np.tile([1, 2, 3], 400).astype(np.uint16), np.full(900, 4, np.uint16), np.full(70, 399, np.uint16)]
    want = [plain_phrases(ref, t) for t in texts]
    for lane in (7, 64, 512):
        assert parser.phrases(texts, lane=lane)[:, 0].tolist() == want


def test_phrases_of_very_long_texts_do_not_depend_on_lanes():
    rng = np.random.default_rng(5)
    ref = rng.integers(1, 30, 5000).astype(np.uint16)
    parser = langid.CrossParser(None, ["x"], [langid.automaton(ref, 40)], [5000])
    for text in (np.concatenate([ref[i : i + 9] for i in rng.integers(0, 4990, 112_000)]), np.tile(ref[:7], 150_000)):
        text = text[:1_000_000].astype(np.uint16)
        counts = {parser.phrases([text, ref], lane=n)[0, 0] for n in (512, 4099, 50_000)}
        assert len(text) == 1_000_000 and len(counts) == 1


def test_six_scripts_are_told_apart(spark):
    rng = np.random.default_rng(7)
    letters = {"latin": "abcdefghij", "cyrillic": "абвгдежзик", "ukrainian": "абвгдеїєіґ", "greek": "αβγδεζηθικ", "han": "的一是不了人我在有他", "hindi": "कखगघचछजझटठ",
               "gothic": "𐌰𐌱𐌲𐌳𐌴𐌵𐌶𐌷𐌸𐌹"}
    word = lambda x: "".join(rng.choice(list(letters[x]), 4))
    words = {x: [word(x) for _ in range(40)] for x in letters}
    data = [(i, " ".join(rng.choice(words[x], 30)).upper(), x) for i, x in enumerate(list(letters) * 20)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 84"))
    assert model.alphabet.size == langid.LETTERS + len(set("".join(letters.values())))
    assert all(r.lang == r.lang_pred for r in langid.identify(df.where("doc_id >= 84"), model).collect())


def test_sample_for_languages_is_bounded(spark):
    df = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("word " * 50).alias("text"), F.lit("en").alias("lang"))
    df = df.union(spark.createDataFrame([(i, f"des mots {i} " * 100, "fr") for i in range(500)] + [(900 + i, None, "de") for i in range(300)] + [(2000, "ein Haus", "de")], "doc_id long, text string, lang string"))
    model = langid.train(df, chars_per_language=5000)
    assert model.languages == ["de", "en", "fr"] and max(model.lengths) <= 5000 and model.lengths[1] == 251
    with pytest.raises(ValueError):
        langid.train(df, max_languages=2)


def test_language_of_held_out_texts(spark, docs, empty):
    rng = np.random.default_rng(6)
    words = {"en": ["the", "and", "of", "with", "house"], "de": ["und", "über", "nicht", "haus", "straße"], "fr": ["été", "maison", "qui", "avec", "leçon"]}
    data = [(i, " ".join(rng.choice(words[x], 25)), x) for i, x in enumerate(["en", "de", "fr"] * 60)]
    data += [(900, None, "en"), (901, "12 34 !!", "de"), (902, "", None), (903, "THE House", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 4 <> 2"))
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert np.mean([out[i].lang_pred == x for i, _, x in data[:180] if i % 4 == 2]) > 0.95
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"] and out[900].score == 0
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(docs.drop("score"), nothing).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


# -- 7 decontamination


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))


def brute_contamination(data, bench, width=10):
    wins = defaultdict(set)
    for item, t in bench:
        w = words_of(t)
        for i in range(max(1, len(w) - width + 1)):
            if w:
                wins[tuple(w[i : i + width])].add(item)
    out = []
    for d, t, *_ in data:
        w = words_of(t)
        hit, items = set(), set()
        for k, ids in wins.items():
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i : i + len(k)]) == k:
                    hit |= set(range(i, i + len(k)))
                    items |= ids
        out.append((d, len(w), len(hit), sorted(str(x) for x in items if x is not None)))
    return sorted(out, key=repr)


def bench_rows(corpus):
    return [(1, corpus.passage), (2, corpus.passage.upper()), (10, "one two"), (3, None), (4, "..."), (None, "no id here at all"),
            (5, "a b c d e f g h i j k"), (6, "it's x-y never seen words zz"), (5, "one two")]


def test_contamination_equals_brute_force(spark, docs, corpus):
    bench = spark.createDataFrame(bench_rows(corpus), "item_id long, text string").withColumn("phrase", F.lit(1))
    out = decontaminate.contamination(docs, bench)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out.collect()), key=repr)
    assert got == brute_contamination(corpus.rows, bench_rows(corpus))
    small = decontaminate.contamination(docs, bench, small_bytes=0)
    assert rows(small, "doc_id", "n_hit") == rows(out, "doc_id", "n_hit")
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(1 for g in got if not g[2])


def test_contamination_of_empty_tables(spark, docs, empty, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(docs, none).collect()} == {0}
    assert decontaminate.contamination(empty, none).count() == 0


def test_proximity_matches_allow_moved_words(spark):
    base = "alpha beta gamma delta eps zeta eta theta"
    data = spark.createDataFrame([(1, "x " + base), (2, "alpha gamma beta delta eps zeta eta theta y"), (3, "alpha beta gamma")], "doc_id long, text string")
    phrases = decontaminate.windows(spark.createDataFrame([(1, base)], "item_id long, text string"))
    for limit in (None, 0):
        ix = decontaminate.index(data, phrases, slack=2, small_bytes=limit)
        got = {r.doc_id: r.missing for r in decontaminate.proximity_matches(ix, slack=2).collect()}
        assert got == {1: 0, 2: 2}
        assert [(r.doc_id, r.start, r.length) for r in decontaminate.exact_matches(ix).collect()] == [(1, 1, 8)]
    with pytest.raises(ValueError):
        decontaminate.proximity_matches(ix, slack=3)


def test_items_of_one_or_two_common_words(spark):
    data = [(i, "the end the the start of the end " * (i % 4), None) for i in range(20)] + [(99, None, None), (None, "the", None)]
    bench = [(1, "The"), (2, "the end"), (3, "the the start"), (4, "end of"), (5, "")]
    df, b = spark.createDataFrame(data, "doc_id long, text string, tid int"), spark.createDataFrame(bench, "item_id long, text string")
    for limit in (None, 0):
        out = decontaminate.contamination(df, b, small_bytes=limit)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out.collect()), key=repr) == brute_contamination(data, bench)


def test_postings_list_every_test_term_near_an_anchor(spark):
    data = spark.createDataFrame([(1, "q a b c d q q a x b c d e")], "doc_id long, text string")
    phrases = decontaminate.windows(spark.createDataFrame([(1, "a b c d e")], "item_id long, text string"))
    ix = decontaminate.index(data, phrases)
    (anchor,) = ix.phrases.select("term").collect()
    assert anchor.term == "e" and [tuple(r) for r in ix.anchors.select("term", "pos").collect()] == [("e", 12)]
    assert sorted(r.pos for r in ix.postings.collect()) == [9, 10, 11, 12]  # x is no test term
    assert decontaminate.exact_matches(ix).count() == 0


# -- 8 tool calls


def test_calls_link_in_order_and_validate(spark):
    msgs = [
        (1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":"{\\"y\\": 2, \\"x\\": \\"s\\"}"},{"id":"b","name":"f","arguments":"{\\"x\\": 1}","after":["a"]},'
                                  '{"id":"z","name":"g","arguments":"nope","after":["b","a"]}]}'),
        (1, 2, "tool", '{"tool_call_id":"a","content":"A"}'), (1, 3, "tool", '{"tool_call_id":"q","content":"?"}'), (1, 3, "tool", "not json"),
        (2, 0, "assistant", '{"tool_calls":[{"id":"u","name":"f","arguments":"{}","after":["v"]},{"id":"v","name":"f","arguments":"[]","after":["u"]}]}'),
        (None, None, None, None),
    ]
    m = spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string")
    schema = spark.createDataFrame([("f", "x", "string", True), ("f", "y", "integer", False)], "name string, field string, type string, required boolean")
    out = {r.call_id: r for r in toolcalls.format_calls(*toolcalls.tool_messages(m), schema).collect()}
    assert {k: (r.status, r.level) for k, r in out.items()} == {
        "a": ("linked", 0), "b": ("unanswered", 1), "z": ("unanswered", 2), "q": ("orphan", None), "u": ("unanswered", None), "v": ("unanswered", None)}
    assert out["a"].faults == [] and out["b"].faults == ["x not string"] and out["z"].faults == ["no schema"]
    assert out["u"].faults == ["x missing"] and out["v"].faults == ["arguments not an object"]
    assert out["a"].json == '{"arguments":{"x":"s","y":2},"call_id":"a","content":"A","name":"f","status":"linked"}'
    assert [out[k].position for k in "abz"] == [0, 1, 2]


def test_levels_of_chains_and_joins(spark):
    after = {0: [], 1: [0], 2: [1], 3: [], 4: [2, 3], 5: [4], 6: [5, 0], 7: [7], 8: [7], 9: [10], 10: [11], 11: [9], 12: [9, 0], 13: [99]}
    after |= {i: [i - 1] for i in range(101, 170)} | {100: []}
    df = spark.createDataFrame([(1, str(i), [str(a) for a in x], "linked") for i, x in after.items()], "conv_id long, call_id string, after array<string>, status string")
    got = {int(r.call_id): r.level for r in toolcalls.levels(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 3, 5: 4, 6: 5, 13: 0} | {i: i - 100 for i in range(100, 170)}


def test_a_long_ladder_takes_few_steps(spark):
    import time

    df = spark.range(10_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit(0).alias("ordinal"), F.col("id").cast("string").alias("call_id"),
        F.array((F.col("id") - 1).cast("string"), (F.col("id") - 2).cast("string")).alias("after"), F.lit("linked").alias("status"))
    began = time.time()
    got = toolcalls.levels(df).agg(F.sum(F.when(F.col("level") == F.col("call_id").cast("int"), 1).otherwise(0)).alias("ok")).first()
    assert got.ok == 10_000 and time.time() - began < 120


def test_levels_of_joins_in_small_chunks(spark):
    import random

    rng, rows_, want = random.Random(12), [], {}
    for conv in range(5):
        turns = sorted(rng.randint(0, 60) for _ in range(40))
        level = []
        for i in range(40):
            after = rng.sample(range(i), min(i, rng.randint(0, 3)))
            level.append(1 + max((level[a] for a in after), default=-1))
            rows_.append((conv, turns[i], i, f"n{i:02}", [f"n{a:02}" for a in after] + ["unknown"], "linked"))
            want[(conv, f"n{i:02}")] = level[-1]
    df = spark.createDataFrame(rows_, "conv_id long, turn long, ordinal int, call_id string, after array<string>, status string")
    assert {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(df, block=16).collect()} == want


def test_repeated_and_empty_messages(spark):
    m = spark.createDataFrame([(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "x"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    schema = spark.createDataFrame([], "name string, field string, type string, required boolean")
    (r,) = toolcalls.format_calls(*toolcalls.plain_messages(m), schema).collect()
    assert (r.status, r.repeats, r.faults) == ("linked", 2, ["no schema"])
    assert toolcalls.format_calls(*toolcalls.plain_messages(m.limit(0)), schema).count() == 0


# -- 9 line templates


def brute_recurring(data, least_docs, similarity=0.7, least_tokens=3):
    """(doc_id, text, line number) of lines whose template recurs, from the rule in words."""
    lines_of = defaultdict(set)
    for d, t, *_ in data:
        for i, line in enumerate((t or "").split("\n")):
            tok = tuple("<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^\x20\x09-\x0D]+", line))
            if len(tok) >= least_tokens:
                lines_of[tok].add((d, t, i))
    docs_of = {k: {x[:2] for x in v} for k, v in lines_of.items()}
    count = Counter()
    for k in docs_of:
        for at, x in enumerate(k):
            count[(len(k), k[:3], at, x)] += len(docs_of[k])
    template = {}
    for k in docs_of:
        kept = tuple((at, x) for at, x in enumerate(k) if count[(len(k), k[:3], at, x)] >= least_docs)
        if len(kept) >= similarity * len(k) - 1e-9:
            template[k] = (len(k), k[:3], kept)
    of = defaultdict(set)
    for k, t in template.items():
        of[t] |= docs_of[k]
    return {x for k, t in template.items() if len(of[t]) >= least_docs for x in lines_of[k]}


def test_recurring_lines_equal_brute_force_in_any_partitioning(spark):
    import random

    rng = random.Random(4)
    data = []
    for i in range(80):
        own = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.3:
                own.append(f"Posted by user{rng.randint(0, 99)} on {rng.choice(['Monday', 'Tuesday'])} at noon in {rng.choice(['Rome', 'Bonn', 'Oslo', 'Wien'])}")
            elif kind < 0.5:
                own.append("all rights are " + " ".join(rng.choice(["reserved", "yours", "kept", "given"]) for _ in range(4)))
            elif kind < 0.6:
                own.append(rng.choice(["Share this", "one two three", "", "\t\x0b one  two\rthree "]))
            else:
                own.append(" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 7))))
        data.append((i, "\n".join(own)))
    data += [(1, data[1][1]), (200, None), (201, ""), (None, data[0][1]), (202, "all rights are reserved yours kept given\n" * 3000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    keys = {r[2]: (r[0], r[1]) for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text")).collect()}
    for n, least in ((1, 5), (7, 8)):
        got = {(*keys[r.doc], r.line_no) for r in lines.recurring(df.repartition(n), least_docs=least).collect()}
        assert got == brute_recurring(data, least) and got


def test_patterns_name_the_variable_fields(spark):
    data = [(i, f"Posted by {'abcdefghijklmnopqrst'[i] * 3} on day {i} for all\n{'xyz'[i % 3]} q w") for i in range(20)]
    got = lines.patterns(spark.createDataFrame(data, "doc_id long, text string"), least_docs=12).collect()
    assert [(r.pattern, r.n_docs, r.n_lines) for r in got] == []  # the third token leads
    data = [(i, f"Posted on day {i} by {'abcdefghijklmnopqrst'[i] * 3} for all readers") for i in range(20)]
    got = lines.patterns(spark.createDataFrame(data, "doc_id long, text string"), least_docs=12).collect()
    assert [(r.pattern, r.n_docs, r.n_lines) for r in got] == [("Posted on day <*> by <*> for all readers", 20, 20)]


def test_recurring_templates_are_dropped(spark, docs, empty, corpus):
    own = lambda i: " ".join("abcdefghijkl"[i] * k for k in (3, 4, 5, 6))
    data = [(i, f"{own(i)}\nPage {i} of 99 pages\n\nAll rights are reserved {'x' if i % 2 else 'y'} now and ever", 5) for i in range(12)]
    data += [(50, None, None), (51, "", None), (52, "Page 7 of 99 pages", None), (0, data[0][1], None)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_lines int")
    got = {r.doc_id: r for r in lines.drop_lines(df, least_docs=12).collect()}
    assert got[3].text == own(3) + "\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[52].text == "" and got[50].text is None and got[51].text == ""
    same = lines.drop_lines(docs, least_docs=50).select("doc_id", "text", "n_dropped").collect()
    assert Counter((r[0], r[1]) for r in same) == Counter((r[0], r[1]) for r in corpus.rows) and not any(r[2] for r in same)
    assert lines.drop_lines(empty).count() == 0


# -- 10 simhash


def brute_groups(data, radius=3):
    import xxhash

    def fp(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [fp(r[1]) for r in data]
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], fps[i] - (1 << 64) if fps[i] >> 63 else fps[i], least.get(root(i))) for i, r in enumerate(data)), key=repr)


def test_groups_equal_brute_force(docs, corpus):
    want = brute_groups(corpus.rows)
    for how in ({}, {"shard_rows": 4}, {"shard_rows": 4, "again": 2, "tile_queries": 7}):
        assert rows(simhash.near_groups(docs, **how), "doc_id", "fp", "component_id") == want


def parts(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    groups = defaultdict(set)
    for x in up:
        groups[root(x)].add(x)
    return sorted(sorted(g) for g in groups.values())


def dense_and_sparse():
    rng = np.random.default_rng(9)
    flip = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    return np.unique(np.concatenate([base, base[:5].repeat(60) ^ flip(300) ^ flip(300), base[:200] ^ flip(200) ^ flip(200) ^ flip(200)]))


def test_links_of_dense_and_sparse_fingerprints(spark):
    s = dense_and_sparse()
    fps = spark.createDataFrame([(int(x),) for x in s.view(np.int64)], "fp long")
    full = parts((int(s.view(np.int64)[i]), int(s.view(np.int64)[j])) for i in range(len(s)) for j in range(i) if bin(int(s[i] ^ s[j])).count("1") <= 3)
    for how in ({}, {"shard_rows": 4}, {"shard_rows": 20, "again": 2, "tile_queries": 30}, {"shard_rows": 50_000}):
        edges = [(r.src, r.dst) for r in simhash.links(fps, 3, **how).collect()]
        assert parts(edges) == full
        assert how.get("shard_rows") != 50_000 or len(edges) < len(s)  # stars, not pairs


def test_every_near_pair_meets_where_one_of_them_lives(spark):
    s = dense_and_sparse()
    fps = spark.createDataFrame([(int(x),) * 2 for x in s.view(np.int64)], "id long, fp long")
    for how in ({"shard_rows": 8}, {"shard_rows": 8, "again": 3, "max_points": 9}):
        placed = simhash.shards(fps, 3, **how).collect()
        lives, there = defaultdict(set), defaultdict(set)
        for r in placed:
            there[r.shard].add(r.id)
            if r.home:
                lives[r.id].add(r.shard)
        assert all(len(lives[int(x)]) == 1 for x in s.view(np.int64)) and len(there) > 20
        for i in range(len(s)):
            for j in range(i):
                if bin(int(s[i] ^ s[j])).count("1") <= 3:
                    a, b = int(s.view(np.int64)[i]), int(s.view(np.int64)[j])
                    assert any(a in there[h] for h in lives[b]) or any(b in there[h] for h in lives[a])


def test_tree_search_finds_what_a_scan_finds():
    s = dense_and_sparse()
    for radius in (0, 3, 8):
        got = sorted((int(a), int(b)) for q, i in simhash.vantage_hits(s, s[::2], radius, leaf=16) for a, b in zip(q, i))
        assert got == sorted(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(s[::2][:, None] ^ s[None, :]) <= radius))))
    same = np.zeros(500, np.uint64)
    assert sum(len(q) for q, _ in simhash.vantage_hits(same, same[:3], 3, leaf=16)) == 1500


def shingle_sets(t, n=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def brute_near(data, similarity=0.8):
    """Least doc_id (nulls last) of each component of texts that share that much of their five-word shingles."""
    texts = sorted({r[1] for r in data}, key=repr)
    sets = [shingle_sets(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    place = {t: i for i, t in enumerate(texts)}
    least = {}
    for r in data:
        k = (r[0] is None, r[0] or 0)
        g = root(place[r[1]])
        least[g] = min(least.get(g, k), k)
    return least


def test_one_row_of_each_group_stays(docs, empty, corpus):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted(brute_near(corpus.rows).values())
    assert sorted((r[0] is None, r[0] or 0) for r in kept.select("doc_id").collect()) == want
    assert simhash.keep_one(empty).count() == 0 and simhash.near_groups(empty).count() == 0


def test_near_copies_go_and_clean_documents_stay(spark):
    import random

    rng = random.Random(3)
    word = lambda: f"v{int(4000 ** rng.random())}"
    data = []
    for i in range(60):
        words = [word() for _ in range(300)]
        data.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            data.append((10 * i + k, " ".join(w if rng.random() > 0.015 else word() for w in words)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = {k for _, k in brute_near(data).values()}
    for how in ({}, {"shard_rows": 16, "again": 2, "tile_queries": 40}):
        got = {r.doc_id for r in simhash.keep_one(df, **how).select("doc_id").collect()}
        assert want <= got and len(got - want) <= 4 and len(want) < 90


def test_digest_of_items(spark):
    assert spark.range(1).select(F.sha2(F.lit("1,2"), 256)).first()[0] == hashlib.sha256(b"1,2").hexdigest()
    assert spark.range(1).select(F.crc32(F.lit("é").cast("binary"))).first()[0] == zlib.crc32("é".encode())


def test_no_link_is_lost_to_a_more_similar_partner(spark):
    import random

    rng = random.Random(12)
    texts = []
    for _ in range(12):
        base = [f"v{rng.randrange(400)}" for _ in range(90)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for a, b in ((a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    edges = simhash.near_texts(df, radius=64, check_radius=128, hashes=1)  # every pair is a candidate
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == label


@pytest.mark.parametrize("blocks", [{}, {"block": 1500, "small_block": 400, "small_blocks": 3}])
def test_candidates_of_a_dense_group_are_never_rows(spark, monkeypatch, blocks):
    """All 11 175 pairs are candidates and few of them links: every link counts, and no table holds the pairs."""
    import functools
    import random

    rng = random.Random(5)
    base, texts = [f"v{i}" for i in range(60)], []
    for _ in range(150):
        own = list(base)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(60)] = f"x{rng.randrange(12)}"
        texts.append(" ".join(own))
    stored, rows = simhash.stored, {}

    def counted(df, tag):
        made = stored(df, tag)
        rows[tag] = max(rows.get(tag, 0), made.count())
        return made

    monkeypatch.setattr(simhash, "stored", counted)
    if blocks:
        monkeypatch.setattr(simhash, "_between", functools.partial(simhash._between, **blocks))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    edges = stored(simhash.near_texts(df, similarity=0.7, radius=64, check_radius=128, hashes=1), "found")
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    want = brute_near(list(enumerate(texts)), 0.7)
    sets = [shingle_sets(t) for t in texts]
    assert all(len(sets[r.src] & sets[r.dst]) >= 0.7 * len(sets[r.src] | sets[r.dst]) for r in edges.collect())
    assert {got.get(i, i) for i in range(len(texts))} == {k for _, k in want.values()} and len(want) > 1
    assert max(rows.values()) <= 10 * len(texts), rows


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(4)
    for trial in range(30):
        base = rng.integers(0, 60, 25)
        sets = [np.unique(np.where(rng.random(25) < rng.choice([0.05, 0.15, 0.5]), rng.integers(0, 200, 25), base)) for _ in range(40)]
        side = np.full(40, 2) if trial % 2 else rng.integers(0, 2, 40)
        group = np.where(rng.random(40) < 0.2, 3, np.arange(40))
        want, brute = group.copy(), group.copy()
        checks = [np.zeros(40, np.uint64)]
        alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))
        for a in range(40):
            for b in range(a):
                if (side[a] == 2 or side[a] != side[b]) and alike(a, b):
                    brute[brute == brute[a]] = brute[b]
        found = list(simhash.forest(group.copy(), side, checks, np.concatenate(sets), np.array([len(s) for s in sets]), 0.6, 34))
        for a, b in found:
            assert alike(a, b) and want[a] != want[b]
            want[want == want[a]] = want[b]
        assert len({*zip(want.tolist(), brute.tolist())}) == len({*want.tolist()}) == len({*brute.tolist()})
