"""Benchmark decontamination on a positional inverted index, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, null_safe, small, spread_join, stored

#: What lies between two words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for "the document itself" in the index; no word is a space.
DOCUMENT = " "


def tokens(text: Column) -> Column:
    """Words of ``text`` in order (null text: none)."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda t: t != "")


def windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``benchmark(item_id, text)`` -> ``(item_id, phrase array<string>)``.

    All runs of ``width`` consecutive words; an item of fewer, but not none, is one phrase.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - width, F.lit(0))
    return (
        items.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .select("item_id", F.slice("w", F.col("at") + 1, width).alias("phrase")).distinct()
    )


@dataclass
class Index:
    """``documents``: (doc_id, h, n_words), a row per document row; ``h`` is xxhash64(text).

    ``anchors``: (doc_id, h, term, pos), the posting lists of the terms that are a phrase's rarest one.
    ``postings``: (doc_id, h, tid, pos), the posting lists of all test terms, wherever a phrase could
    stand: within reach of an anchor's posting (a posting that two anchors reach may be listed twice).
    ``phrases``: (phrase_id, term, probes): a test phrase, its rarest term and all its terms
    from the rarest on as (count, tid, offset).  ``tid`` is xxhash64(term).
    """

    documents: DataFrame
    anchors: DataFrame
    postings: DataFrame
    phrases: DataFrame
    slack: int
    small_bytes: int | None


def _raw(docs: DataFrame) -> DataFrame:
    """Split texts with what must be skipped: only the first and last piece can be empty."""
    pieces = docs.select(
        "doc_id", F.xxhash64("text").alias("h"),
        F.split(ascii_lower(F.coalesce("text", F.lit(""))), GAP).alias("piece"))
    lead = F.when(F.col("piece")[0] == "", 1).otherwise(0)
    tail = F.when(F.element_at("piece", -1) == "", 1).otherwise(0)
    return pieces.withColumn("lead", lead).withColumn(
        "n_words", F.greatest(F.size("piece") - lead - tail, F.lit(0)))


def index(docs: DataFrame, phrases: DataFrame, slack: int = 0, small_bytes: int | None = None) -> Index:
    """Positional inverted index of ``docs(doc_id, text)`` for test ``phrases(phrase array<string>)``.

    One pass counts every test term over all documents; that tells each phrase's rarest term.
    A phrase with a term that no document has can't occur and is left out (lossless).  A second
    pass lists the postings of the rarest terms, with the words that a phrase around them could have
    (``slack`` words more for proximity); from those come the postings of all test terms.  Both are stored in the shared
    folder.  Test-side tables are broadcast only up to a size in bytes; beyond, the joins are salted shuffles.
    """
    phrases = stored(
        phrases.select("phrase").distinct().select(F.xxhash64("phrase").alias("phrase_id"), "phrase"), "phrases")
    terms = stored(phrases.select(F.explode("phrase").alias("term")).distinct(), "terms")
    n_terms, width = terms.agg(F.count("*"), F.coalesce(F.max(F.octet_length("term")), F.lit(0))).first()
    width += 32
    counted = stored(
        spread_join(_raw(docs).select("h", F.posexplode("piece").alias("at", "term")), terms, ["term"], n_terms, width, limit=small_bytes, salt=["h", "at"])
        .groupBy("term").agg(F.count("*").alias("n")), "counts")
    chosen = stored(
        spread_join(phrases.select("phrase_id", F.size("phrase").alias("size"), F.posexplode("phrase").alias("offset", "term")),
                 counted, ["term"], n_terms, width, limit=small_bytes)
        .groupBy("phrase_id", "size")
        .agg(F.array_sort(F.collect_list(F.struct("n", F.xxhash64("term").alias("tid"), "offset", "term"))).alias("p"))
        .where(F.size("p") == F.col("size"))
        .select("phrase_id", F.col("p")[0]["term"].alias("term"),
                F.transform("p", lambda x: F.struct(x["n"].alias("n"), x["tid"].alias("tid"), x["offset"].alias("offset"))).alias("probes")), "chosen")
    anchors = stored(
        chosen.groupBy("term").agg((F.max(F.size("probes")) - 1 + slack).alias("reach"))
        .union(docs.sparkSession.range(1).select(F.lit(DOCUMENT).alias("term"), F.lit(0).alias("reach"))), "anchors")
    pos = F.col("at") - F.col("lead")
    first = F.greatest(pos - F.col("reach"), F.lit(0))
    last = F.least(pos + F.col("reach"), F.col("n_words") - 1)
    listed = stored(
        spread_join(
            _raw(docs).select("doc_id", "h", "n_words", "lead", "piece",
                              F.posexplode(F.concat("piece", F.array(F.lit(DOCUMENT)))).alias("at", "term")),
            anchors, ["term"], n_terms + 1, width, limit=small_bytes, salt=["h", "at"])
        .select("doc_id", "h", "n_words", "term", pos.alias("pos"), first.alias("first"),
                F.when(F.col("term") != DOCUMENT, F.slice("piece", first + F.col("lead") + 1, last - first + 1))
                .alias("words")), "listed")
    around = listed.where(F.col("term") != DOCUMENT).select("doc_id", "h", "first", F.posexplode("words").alias("at", "term"))
    postings = stored(
        spread_join(around, terms, ["term"], n_terms, width, "left_semi", small_bytes)
        .select("doc_id", "h", F.xxhash64("term").alias("tid"), (F.col("first") + F.col("at")).alias("pos")), "postings")
    return Index(
        listed.where(F.col("term") == DOCUMENT).select("doc_id", "h", "n_words"),
        listed.where(F.col("term") != DOCUMENT).select("doc_id", "h", "term", "pos"), postings, chosen, slack, small_bytes)


def _starts(ix: Index) -> DataFrame:
    """``(doc_id, h, phrase_id, start, probes)``: the lists of the rarest terms, shifted to where their phrases would start."""
    n, width = ix.phrases.agg(F.count("*"), F.coalesce(F.max(F.size("probes")), F.lit(0))).first()
    start = F.col("pos") - F.col("probes")[0]["offset"]
    return spread_join(ix.anchors, ix.phrases, ["term"], n, 64 + 56 * width, limit=ix.small_bytes).select("doc_id", "h", "phrase_id", start.alias("start"), "probes")


def _intersected(ix: Index, asked: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``asked(doc_id, h, tid, pos, ...)`` whose term stands at that position: a join with the posting lists."""
    p = ix.postings
    on = asked["doc_id"].eqNullSafe(p["doc_id"]) & (asked["h"] == p["h"]) & (asked["tid"] == p["tid"]) & (asked["pos"] == p["pos"])
    return asked.join(p, on, "left_semi").select(*columns)


def exact_matches(ix: Index) -> DataFrame:
    """``(doc_id, h, phrase_id, start, length)`` of every occurrence of every phrase.

    The rarest term's list, shifted by its offset, gives the starts; it is intersected with the shifted list of the
    second rarest term, and what is left with those of all others, each of which must have the start.
    """
    key = ["doc_id", "h", "phrase_id", "start"]
    starts = _starts(ix).where("start >= 0")
    one = starts.where(F.size("probes") == 1).select(*key, F.lit(1).alias("length"))
    second = F.col("probes")[1]
    asked = starts.where(F.size("probes") > 1).select(
        *key, F.size("probes").alias("length"), second["tid"].alias("tid"), (F.col("start") + second["offset"]).cast("int").alias("pos"))
    left = stored(_intersected(ix, asked, [*key, "length"]).distinct(), "left")
    n, width = ix.phrases.agg(F.count("*"), F.coalesce(F.max(F.size("probes")), F.lit(0))).first()
    others = (
        left.where("length > 2").join(small(ix.phrases.drop("term"), n, 64 + 56 * width, ix.small_bytes), "phrase_id")
        .select(*key, "length", F.explode(F.slice("probes", 3, F.size("probes"))).alias("p"))
        .select(*key, "length", F.col("p.tid").alias("tid"), (F.col("start") + F.col("p.offset")).cast("int").alias("pos"))
    )
    rest = _intersected(ix, others, [*key, "length"]).groupBy(*key, "length").agg(F.count("*").alias("n")).where("n = length - 2")
    return one.union(left.where("length = 2")).union(rest.select(*key, "length")).distinct()


def proximity_matches(ix: Index, slack: int = 3) -> DataFrame:
    """``(doc_id, h, phrase_id, pos, missing)``: near occurrences around a rarest term at ``pos``.

    All terms of the phrase stand within ``slack`` words of their place, in any order;
    ``missing`` counts those not exactly at their place (0: an exact match).  The index must have at
    least this ``slack``.  The lists are intersected from the second rarest term on, as for exact matches.
    """
    if slack > ix.slack:
        raise ValueError(f"the index was built for a slack of {ix.slack}")
    key = ["doc_id", "h", "phrase_id", "pos0"]
    starts = _starts(ix).select("doc_id", "h", "phrase_id", (F.col("start") + F.col("probes")[0]["offset"]).alias("pos0"), "start", "probes")
    places = lambda probes: (
        starts.select(*key, "start", F.size("probes").alias("length"), F.explode(probes).alias("p"))
        .select(*key, "length", F.col("p.offset").alias("offset"), F.col("p.tid").alias("tid"), F.col("start"),
                F.explode(F.sequence(F.lit(-slack), F.lit(slack))).alias("off"))
        .select(*key, "length", "offset", "tid", F.abs("off").alias("off"), (F.col("start") + F.col("offset") + F.col("off")).cast("int").alias("pos")))
    found = lambda asked: _intersected(ix, asked, [*key, "length", "offset", "off"]).groupBy(
        *key, "length", "offset").agg(F.min("off").alias("off"))
    second = stored(found(places(F.slice("probes", 2, 1))), "second")
    ok = second.select(*key).distinct()
    rest = places(F.slice("probes", 3, F.size("probes")))
    rest = rest.join(ok.withColumnsRenamed({k: f"__{k}" for k in key}), F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("h") == F.col("__h"))
                     & (F.col("phrase_id") == F.col("__phrase_id")) & (F.col("pos0") == F.col("__pos0")), "left_semi")
    every = second.union(found(rest)).groupBy(*key, "length").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("off") > 0, 1).otherwise(0)).alias("missing")).where("n = length - 1")
    one = starts.where(F.size("probes") == 1).select(*key, F.lit(0).cast("long").alias("missing"))
    return every.select(*key, "missing").union(one).distinct().withColumnRenamed("pos0", "pos")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10,
                  small_bytes: int | None = None) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: ``doc_id, h, n_words, n_hit, items, n_items``.

    ``n_hit`` counts the words inside any occurrence of a window of ``benchmark(item_id, text)``;
    ``items`` are the sorted item_ids, as strings, with a window that occurs (an item without an
    id hits words but isn't listed).  Null and empty texts have no words; repeated rows each
    get their row; with an empty benchmark nothing is hit; other columns aren't read; very long texts
    are read whole; an empty table gives no rows.
    """
    items = stored(
        windows(benchmark, width).select("item_id", F.xxhash64("phrase").alias("phrase_id"), "phrase"), "windows")
    ix = index(docs.select("doc_id", "text"), items, small_bytes=small_bytes)
    found = stored(exact_matches(ix), "matches")
    key = ["doc_id", "h"]
    order = Window.partitionBy(*key).orderBy("start", "end")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("length")
    hit = (
        found.select(*key, "start", end.alias("end")).distinct()
        .withColumn("new", F.col("end") - F.greatest("start", F.coalesce(seen, F.lit(0))))
        .groupBy(*key).agg(F.sum(F.greatest("new", F.lit(0))).alias("n_hit"))
    )
    named = items.where("item_id is not null").select("phrase_id", F.col("item_id").cast("string").alias("item"))
    listed = (
        found.select(*key, "phrase_id").distinct().join(small(named, named.count(), 64, small_bytes), "phrase_id")
        .groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    out = null_safe(null_safe(ix.documents, hit, key, "left"), listed, key, "left")
    none = F.array().cast("array<string>")
    return out.select(
        *key, F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, least_hit: int = 1,
          small_bytes: int | None = None) -> DataFrame:
    """``docs`` without the rows of which at least ``least_hit`` words are hit; columns unchanged."""
    found = contamination(docs, benchmark, width, small_bytes).where(F.col("n_hit") >= least_hit)
    bad = found.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    return docs.join(
        bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__h"]), "left_anti")
