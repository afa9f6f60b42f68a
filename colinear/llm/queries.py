"""Thin queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lines, mix, quality, shard, simhash, suffixes, toolcalls, topk
from .common import null_safe, stored, table
from .sql import SQL

SHARDS, SEED = 24, 7


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, in 24 shards; the key alone decides, so a 25th takes rows only into itself."""
    out = shard.shuffle_into_shards(table(spark, sf_dir, "documents"), SHARDS, key="doc_id", content="text", seed=SEED)
    return out.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot",
        shard.shard_of(F.col("doc_id"), SHARDS + 1, SEED).alias("grown_shard"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that several documents share, as word spans."""
    return suffixes.repeats(table(spark, sf_dir, "documents"), least_words=50, gram=8)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what a mix of 150 % of all words, sources weighing 3, 1, 2, takes of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sources = F.array("source")
    plan = mix.mix(docs, sources, mix.cycle_weights([3, 1, 2], 1.5, 2.0), repeats=2, seed=17, keep=["doc_id", "source"])
    by_source = spark.createDataFrame(
        [(s, n, float(plan.targets[s])) for s, n in plan.sizes.items()],
        "source string, source_size long, target double")
    timed = plan.routed(plan.rows).select("doc_id", "source", F.col("__size").alias("size"), F.size("__routes").alias("__times"))
    return null_safe(timed, F.broadcast(by_source), ["source"], "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("__times")).cast("long").alias("taken"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with expected grade (0 toxic, 1 poor, 2 good), tail probabilities and ``keep``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, ratings(spark, sf_dir), n_grades=3)
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", "expected_grade", F.col("tail")[0].alias("p_not_toxic"), F.col("tail")[1].alias("p_good"),
        (F.col("tail")[1] >= 0.5).alias("keep"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best candidates for every hundredth vector, by exact integer inner product."""
    vectors = stored(table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select(
        F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("v"),
        F.monotonically_increasing_id().alias("row")), "vectors")
    return topk.search(vectors, vectors.where("id % 100 = 0"), k=10)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that lie in any 10-word window of a benchmark item."""
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Schemas of the two functions that a plain chat calls (fixed values).
CHAT_SCHEMAS = [
    ("configure", "text", "string", True), ("configure", "turn", "integer", True),
    ("answer", "text", "string", True), ("answer", "turn", "integer", True), ("answer", "tools", "array", False),
]


def op8_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as linked calls and results in dependency order, checked and as canonical JSON."""
    messages = table(spark, sf_dir, "conversations")
    schemas = spark.createDataFrame(CHAT_SCHEMAS, "name string, field string, type string, required boolean")
    calls, results = toolcalls.plain_messages(messages)
    more_calls, more_results = toolcalls.tool_messages(messages)
    done = toolcalls.format_calls(calls.unionByName(more_calls), results.unionByName(more_results), schemas)
    return done.select(
        "conv_id", "call_id", "turn", "result_turn", "name", "status", "repeats", "level", "position",
        F.array_join("faults", "; ").alias("faults"), "json")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines whose template ten or more documents have."""
    done = lines.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least_docs=10)
    return done.select("doc_id", "n_lines", "n_dropped", "text")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their SimHash fingerprint and near-duplicate component."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"), radius=3, words_per_shingle=3, seed=42)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_ALL = (
    op1_sharding, op2_suffixes, op3_mixing, op4_quality, op5_topk, op6_language, op7_decontamination,
    op8_toolcalls, op9_lines, op10_simhash)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
