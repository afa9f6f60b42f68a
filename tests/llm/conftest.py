import random
from types import SimpleNamespace

import pytest

WORDS = [f"w{i}" for i in range(60)] + ["été", "ÉTÉ", "It's", "x-y", "9", "Über"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents with nulls, empties, copies, near copies, ties, repeated rows and a very long text."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 120)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), 0) for i in range(60)]
    long = prose(rng, 9000)
    passage = prose(rng, 60)
    rows += [
        (60, None, "en", "a", 0), (61, "", "en", "b", 0), (62, "   \n\t ", None, "c", 0), (63, "...!!!", "en", "a", 0), (64, long, "en", "a", 0),
        (65, rows[3][1], "en", "b", 0), (66, rows[3][1], "en", "b", 0), (67, prose(rng, 20) + " " + passage + " " + prose(rng, 30), "fr", "a", 0),
        (68, passage + " tail words", "fr", None, 0), (69, "one", "en", "a", 0), (70, "one two", "en", "a", 0), (70, "one two", "en", "a", 0),
        (None, "no id here at all", "en", "a", 0), (None, "no id here at all", "en", "a", 0), (None, None, None, None, None),
        (71, long + " extra", "en", "a", 0), (72, "a b c d e f g h i j k a b c d e f g h i j k", "en", "a", 0),
    ]
    return SimpleNamespace(rows=rows, passage=passage, schema="doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus.rows, corpus.schema).repartition(3)
    return df.withColumns({c: F.lit("mine") for c in ("shard", "slot", "fp", "h", "term", "tail", "n_lines", "score", "size", "group", "key", "pos")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def tables(spark, corpus, tmp_path_factory):
    """A folder of small tables for the thin queries, with nulls, ties and repeated rows."""
    import numpy as np

    rng = random.Random(8)
    d = str(tmp_path_factory.mktemp("small"))
    lines = [f"Page {i} of 9\nall rights are reserved {'x' if i % 2 else 'y'} now\n{prose(rng, 9)}" for i in range(14)]
    rows = corpus.rows + [(300 + i, t, "en", "b", 0) for i, t in enumerate(lines)]
    spark.createDataFrame(rows, corpus.schema).write.parquet(f"{d}/documents.parquet")
    bench = [(1, corpus.passage), (2, corpus.passage.upper()), (10, "one two"), (3, None), (4, "..."), (5, "a b c d e f g h i j k"), (5, "one two")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(r[0], rng.randint(0, 1), rng.randint(0, 1)) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rs = np.random.default_rng(1)
    vectors = [(i * 20, [float(x) for x in rs.normal(size=8)]) for i in range(40)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (100, [0.5] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    chats = [(c, t, ("system" if t == 0 else "user" if t % 2 else "assistant"), f"said \"{c}\" {t}" if t % 5 else None) for c in range(8) for t in range(c + 1)]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d
