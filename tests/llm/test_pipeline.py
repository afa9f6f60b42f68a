"""The corpus pipeline against a plain version of its own, stage by stage."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from colinear.llm import mix, quality  # noqa: E402
from colinear.llm.queries import ratings  # noqa: E402

from .conftest import prose  # noqa: E402
from .test_operators import brute_contamination, brute_near  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    d = str(tmp_path_factory.mktemp("tables"))
    passage = prose(rng, 12)
    rows, labels = [], []
    for i in range(150):
        text, grade = prose(rng, rng.randint(20, 60)), (1, 0)
        if i % 7 == 0:
            text, grade = text + " horrid " + prose(rng, 5), (1, 1)
        elif i % 5 == 0:
            text, grade = " ".join(w + "###" for w in text.split()), (0, 0)
        elif i % 11 == 0:
            text = text + " " + passage
        elif i % 13 == 0:
            text = rows[i - 1][1]
        rows.append((i, text, "en", rng.choice(["a", "b", None]), len(text)))
        labels.append((i, *grade))
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, [(1, passage)], labels


def plain(spark, d, rows, bench):
    model = quality.train(spark.createDataFrame(rows, SCHEMA), ratings(spark, d), 3)
    features = quality.Featurizer()
    weight = dict(zip(model.ids.tolist(), model.weights.astype(np.float32).tolist()))

    def good(t):
        ids = features(t.encode()) if t else []
        return len(ids) and 1 / (1 + math.exp(model.thresholds[1] - sum(weight.get(int(i), 0.0) for i in ids))) >= 0.5

    kept = [r for r in rows if good(r[1])]
    least = {k[1] for k in brute_near(kept).values()}
    kept = [r for r in kept if r[0] in least]
    bad = {g[0] for g in brute_contamination(kept, bench) if g[2]}
    kept = [r for r in kept if r[0] not in bad]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for r in kept:
        by[r[3]].append(r)
    sizes = {s: sum(size(r[1]) for r in v) for s, v in by.items()}
    target = mix.cycle_weights([3, 1, 2], 1.5, 2.0)(sizes, sum(sizes.values()))
    out = Counter()
    for s, v in by.items():
        want, before = math.floor(target[s] + 0.5), 0
        times, rest = divmod(want, sizes[s])
        digest = lambda r: hashlib.md5(f"17:{'null' if r[0] is None else r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
        for r in sorted(v, key=digest):
            extra = rest > 0 and 2 * before + size(r[1]) <= 2 * rest
            before += size(r[1])
            out[(r[0], r[1])] += times + extra
    return +out


def test_pipeline_equals_the_plain_version(spark, sf_dir):
    d, rows, bench, _ = sf_dir
    out = pipeline.run(spark, d).collect()
    assert Counter((r.doc_id, r.text) for r in out) == plain(spark, d, rows, bench)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_stages_keep_columns_and_judge(spark, sf_dir):
    d, rows, _, labels = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, d)
        assert out.columns[: len(docs.columns)] == docs.columns and (i == len(pipeline.STAGES) - 1 or len(out.columns) == len(docs.columns))
        if i == 0:
            kept = {r.doc_id for r in out.select("doc_id").collect()}
            wrong = [x for x, q, t in labels if (x in kept) != (q == 1 and t == 0)]
            assert len(wrong) <= 5 and not kept & {500, 501}
        assert stage(spark, docs.limit(0), d).count() == 0
