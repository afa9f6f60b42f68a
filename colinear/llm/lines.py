"""Line dedup with a log-template tree."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, spread_join, stored

FIELD = b"<*>"
_DIGIT = re.compile(rb"[0-9]")
#: Leading tokens that the tree parses after the number of tokens.
DEPTH = 3


def _hash(data: bytes) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(data)
    return x - (1 << 64) if x >> 63 else x


def masked(line: bytes) -> list[bytes]:
    """Tokens of a line; those with a digit are variable fields."""
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [FIELD if _DIGIT.search(t) else t for t in tokens]
    return tokens


def _parse(least_tokens: int):
    names = ["doc", "line_no", "line", "leaf", "codes"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []

            def batch() -> pa.RecordBatch:
                columns = list(zip(*rows)) if rows else [()] * len(names)
                codes = np.fromiter((c for x in columns[4] for c in x), np.uint32).view(np.int32)
                ends = np.cumsum([0, *map(len, columns[4])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes))
                made = pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns[:4], kinds)), lists], names=names)
                rows.clear()
                return made

            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                for i, line in enumerate((text.as_py() or b"").split(b"\n")):
                    tokens = masked(line)
                    if len(tokens) >= least_tokens:
                        rows.append((doc, i, _hash(b" ".join(tokens)), _hash(b"%d " % len(tokens) + b" ".join(tokens[:DEPTH])),
                                     list(map(zlib.crc32, tokens))))
                        if len(rows) >= 20_000:  # also within a very long text
                            yield batch()
            yield batch()

    return run


def parsed(docs: DataFrame, least_docs: int = 10, similarity: float = 0.7, least_tokens: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The template tree of all lines of ``docs(doc_id, text)``: ``(lines, have, templates)``.

    A line's tokens are split at ASCII white space; a token with a digit is a variable field.  The tree has a
    fixed depth: a leaf holds the lines of one number of tokens and the same leading three.  Within a leaf a
    token is constant at its position if its different lines have at least ``least_docs`` documents between them
    (counted line by line), and a variable field otherwise.  The constants with their positions are the line's
    template, if they are at least ``similarity`` of its tokens.  The rule looks at counts only, so it is the same for
    every order, partitioning and size.

    ``lines``: (doc, line_no, line, leaf, codes), all lines of ``least_tokens`` tokens or more; ``doc`` is
    xxhash64(doc_id, text), ``line`` the hash of the line with its fields masked.  ``have``: (leaf, line, doc), distinct.
    ``templates``: (line, leaf, template, n_tokens, n_constant), a row for each line that has one.
    """
    own = docs.select(F.xxhash64("doc_id", "text").alias("doc"), "text")
    lines = stored(own.mapInArrow(_parse(least_tokens), "doc long, line_no int, line long, leaf long, codes array<int>"), "lines")
    have = stored(lines.select("leaf", "line", "doc").distinct(), "have")
    support = stored(have.groupBy("leaf", "line").agg(F.count("*").alias("n_docs")), "support")
    # what a leaf's lines have in all bounds what any of its templates has
    leaves = stored(support.groupBy("leaf").agg(F.sum("n_docs").alias("s")).where(F.col("s") >= least_docs).select("leaf"), "leaves")
    members = stored(spread_join(support, leaves, ["leaf"], leaves.count(), 8, "left_semi"), "members")
    once = spread_join(
        lines.select("line", "codes", "doc", "line_no"), members.select("line"), ["line"], members.count(), 8, "left_semi", salt=["doc", "line_no"])
    words = stored(members.join(once.select("line", "codes").dropDuplicates(["line"]), "line"), "words")
    frequent = stored(
        words.select("leaf", "n_docs", F.posexplode("codes").alias("at", "code")).groupBy("leaf", "at", "code")
        .agg(F.sum("n_docs").alias("s")).where(F.col("s") >= least_docs).select("leaf", "at", "code"), "frequent")
    tokens = words.select("line", "leaf", F.size("codes").alias("n_tokens"), F.posexplode("codes").alias("at", "code"))
    constant = spread_join(tokens, frequent, ["leaf", "at", "code"], frequent.count(), 16, "left_semi")
    templates = stored(
        constant.groupBy("line", "leaf", "n_tokens")
        .agg(F.bit_xor(F.xxhash64("at", "code")).alias("a"), F.bit_xor(F.xxhash64("code", "at", F.lit(1))).alias("b"),
             F.count("*").alias("n_constant"))
        .where(F.col("n_constant") >= similarity * F.col("n_tokens") - 1e-9)
        .select("line", "leaf", F.xxhash64("leaf", "a", "b", "n_constant").alias("template"), "n_tokens", "n_constant"), "templates")
    return lines, have, templates


def recurring_lines(have: DataFrame, templates: DataFrame, least_docs: int) -> DataFrame:
    """``(line, template, n_docs)``: lines whose template at least ``least_docs`` different documents have."""
    n = templates.count()
    of = spread_join(have.select("line", "doc"), templates.select("line", "template"), ["line"], n, 16)
    often = of.select("template", "doc").distinct().groupBy("template").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least_docs)
    return stored(templates.select("line", "template").join(often, "template").select("line", "template", "n_docs"), "recurring")


def recurring(docs: DataFrame, least_docs: int = 10, similarity: float = 0.7, least_tokens: int = 3) -> DataFrame:
    """``(doc, line_no)`` of every line whose template recurs (see ``parsed``); ``doc`` is xxhash64(doc_id, text).

    Lines of fewer than ``least_tokens`` tokens never do.
    """
    lines, have, templates = parsed(docs, least_docs, similarity, least_tokens)
    found = recurring_lines(have, templates, least_docs)
    return spread_join(lines.select("doc", "line_no", "line"), found.select("line"), ["line"], found.count(), 8, "left_semi").select("doc", "line_no").distinct()


def patterns(docs: DataFrame, least_docs: int = 10, similarity: float = 0.7, least_tokens: int = 3) -> DataFrame:
    """``(template, pattern, n_docs, n_lines)``: the recurring templates, variable fields written ``<*>``."""
    lines, have, templates = parsed(docs, least_docs, similarity, least_tokens)
    found = recurring_lines(have, templates, least_docs)
    some = found.groupBy("template", "n_docs").agg(F.min("line").alias("line"), F.count("*").alias("n_lines"))
    first = lines.join(some, "line").groupBy("template", "n_docs", "n_lines", "line", "leaf").agg(F.min(F.struct("doc", "line_no", "codes")).alias("e"))
    spread = first.select("template", "leaf", F.posexplode("e.codes").alias("at", "code"))
    support = (
        lines.select("leaf", "line", "codes").dropDuplicates(["line"]).join(have.groupBy("line").agg(F.count("*").alias("n")), "line")
        .select("leaf", "n", F.posexplode("codes").alias("at", "code")).groupBy("leaf", "at", "code").agg(F.sum("n").alias("s"))
        .where(F.col("s") >= least_docs).drop("s")
    )
    fixed = spread.join(support, ["leaf", "at", "code"]).groupBy("template").agg(F.collect_set("at").alias("fixed"))
    texts = docs.select(F.xxhash64("doc_id", "text").alias("doc"), "text").dropDuplicates(["doc"])
    own = first.select("template", "n_docs", "n_lines", F.col("e.doc").alias("doc"), F.col("e.line_no").alias("line_no")).join(texts, "doc").join(fixed, "template")
    tokens = F.regexp_extract_all(F.split("text", "\n", -1)[F.col("line_no")], F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    shown = F.transform(tokens, lambda x, i: F.when(F.array_contains("fixed", i) & ~x.rlike("[0-9]"), x).otherwise("<*>"))
    return own.select("template", F.array_join(shown, " ").alias("pattern"), "n_docs", "n_lines")


def _without(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out_at = b.schema.get_field_index(text), b.schema.get_field_index("__out")
            texts, n_lines, n_dropped = [], [], []
            for x, out in zip(b.column(at).to_pylist(), b.column(out_at).to_pylist()):
                out = set(out or ())
                parts = [] if x is None else x.split("\n")
                texts.append(x if not out else "\n".join(p for i, p in enumerate(parts) if i not in out))
                n_lines.append(len(parts))
                n_dropped.append(len(out))
            columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns) if i != out_at]
            names = [n for i, n in enumerate(b.schema.names) if i != out_at]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int32()), pa.array(n_dropped, pa.int32())], names=[*names, "n_lines", "n_dropped"])

    return run


def drop_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with recurring template lines taken out of ``text``; adds ``n_lines``, ``n_dropped``.

    All other lines stay in order, joined by line feeds; a text of nothing else becomes empty.
    Null text stays null and has no lines.  Rows repeat as they did: equal rows (doc_id and
    text) count as one document.  Columns named ``n_lines`` or ``n_dropped`` are replaced.  An empty table gives
    no rows; a very long text is parsed in parts.
    """
    found = stored(recurring(docs, **how).groupBy("doc").agg(F.collect_list("line_no").alias("__out")), "out")
    n, most = found.agg(F.count("*"), F.coalesce(F.sum(F.size("__out")), F.lit(0))).first()
    kept = docs.drop("n_lines", "n_dropped")
    joined = kept.withColumn("__doc", F.xxhash64("doc_id", "text")).join(
        small(found.withColumnRenamed("doc", "__doc"), n, 24 + 4 * most // max(n, 1)), "__doc", "left").drop("__doc")
    schema = T.StructType([*kept.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("n_dropped", T.IntegerType())])
    return joined.select(*kept.columns, "__out").mapInArrow(_without("text"), schema)
