"""A training corpus from raw documents: filter, dedup, decontaminate, mix, shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.llm import decontaminate, mix, quality, shard, simhash
from colinear.llm.common import stored, table
from colinear.llm.queries import ratings

#: No SQL: the classifier, SimHash and Fisher-Yates shuffle can't be expressed in it.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents more likely good than not, by ordinal regression on the label table's grades.

    Null and wordless texts go; without any labels all texts with words stay.  Repeated rows are alike and stay
    repeated; a tie (0.5) stays; very long texts are scored whole; an empty table gives no rows; columns are kept,
    whatever they are named.
    """
    model = quality.train(docs, ratings(spark, sf_dir), n_grades=3)
    return quality.score(docs, model).where(F.col("tail")[1] >= 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id (nulls last).

    Links come from SimHash fingerprints through vantage-point shards, checked at a similarity of 0.8 of
    five-word shingles.  Equal texts are a group, null texts too; texts without words are alike.  Repeated
    rows leave one; an empty table gives none; columns are kept, whatever they are named.
    """
    return simhash.keep_one(docs, similarity=0.8, words_per_shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item (an item of fewer words is one window).

    Null and wordless texts stay; repeated rows go or stay together; very long texts are read whole; with an empty
    benchmark all stay; an empty table gives no rows; columns are kept, whatever they are named.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), width=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times): 150 % of all words, sources weighing 3, 1, 2.

    A null source is a source of its own, the last.  Texts without words have size 0 and go with their place in the
    order; a source without any words isn't taken.  Repeated rows are told apart where a share ends between them; an empty table gives no
    rows; columns are kept, whatever they are named.
    """
    sources = F.array("source")
    plan = mix.mix(docs, sources, mix.cycle_weights([3, 1, 2], 1.5, 2.0), repeats=2, seed=17)
    return mix.mixed(docs, sources, plan)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ``shard`` of 24 (int) and shuffled ``slot`` in it (long, gapless from 0).

    Null keys share a shard; each repeated row has a slot of its own; null, empty and very long texts are rows like any
    other; columns named ``shard`` or ``slot`` are replaced; an empty table gives no rows.
    """
    return shard.shuffle_into_shards(docs, 24, key="doc_id", content="text", seed=7)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are stored and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
