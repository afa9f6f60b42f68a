"""Text formats of the field as DataFrames.

All readers go through Spark's file sources, so any store works.  Formats in which a line belongs
to one before it read whole records or number the lines of a file within it; no file is ever
collected in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import CHAINED_HIT, GFF, PARAM_COMPLEXITY, PARAM_DUPS, PARAM_KMER, TABULAR_HIT


def fasta(spark: SparkSession, path: str, org: str | None = None) -> DataFrame:
    """``(org, ordinal, seqid, seq, length)``: one row a record, ``ordinal`` by place in the file."""
    rows = spark.read.option("lineSep", ">").text(path).withColumn("org", F.lit(org) if org else F.element_at(F.split(F.input_file_name(), "/"), -1))
    body = rows.where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    head = F.substring_index("value", "\n", 1)
    seq = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    got = body.select("org", "at", F.regexp_extract(head, r"^\s*(\S+)", 1).alias("seqid"), seq.alias("seq"))
    # ids run on within a task, so counts by task tell every record's place without sorting sequences
    task = F.shiftright("at", 33)
    before = Window.partitionBy("org").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = body.groupBy("org", task.alias("task")).agg(F.count("*").alias("n"), F.min("at").alias("least")).select(
        "org", "task", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return got.withColumn("task", task).join(bases, ["org", "task"]).select(
        "org", (F.col("base") + F.col("at") - F.col("least")).cast("int").alias("ordinal"), "seqid", "seq", F.length("seq").cast("long").alias("length"))


def chunks(sequences: DataFrame, size: int = 1 << 20, overlap: int = 1 << 10) -> DataFrame:
    """Sequences cut into overlapping chunks, so that no row holds a genome."""
    step = size - overlap
    n = F.greatest(F.ceil((F.col("length") - overlap) / F.lit(step)), F.lit(1)).cast("int")
    cut = sequences.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.select("org", "seqid", "chunk_no", (F.col("chunk_no") * F.lit(step)).cast("long").alias("start"),
                      F.substr("seq", F.col("chunk_no") * step + 1, F.lit(size)).alias("seq"))


def kmer_vector(spark: SparkSession, path: str, org: str, block: int = 1 << 20) -> DataFrame:
    """``(org, pos, freq)`` of a file of little-endian 16-bit counts, read in fixed-size records."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    n = F.ceil(F.octet_length("content") / F.lit(2 * block)).cast("int")
    parts = raw.select(F.explode(F.sequence(F.lit(0), n - 1)).alias("b"), "content").select(
        "b", F.substr("content", F.col("b") * 2 * block + 1, F.lit(2 * block)).alias("part"))
    two = F.transform(F.sequence(F.lit(0), (F.octet_length("part") / 2).cast("int") - 1),
                      lambda i: F.conv(F.concat(F.substring(F.hex(F.substr("part", i * 2 + 2, F.lit(1))), 1, 2), F.hex(F.substr("part", i * 2 + 1, F.lit(1)))), 16, 10).cast("int"))
    return parts.select(F.lit(org).alias("org"), "b", F.posexplode(two).alias("i", "freq")).select("org", (F.col("b").cast("long") * block + F.col("i")).alias("pos"), "freq")


def complexity(spark: SparkSession, path: str, known: DataFrame, org: str) -> DataFrame:
    """``chrom midpoint Cm``; a sequence that isn't in ``known(seqid)`` stops the job."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    p = F.split(F.trim("value"), r"\s+")
    got = rows.select(F.lit(org).alias("org"), p[0].alias("seqid"), p[1].cast("double").cast("long").alias("midpoint"), p[2].cast("double").alias("cm"))
    named = got.join(known.select("seqid", F.lit(True).alias("__ok")), "seqid", "left")
    return named.where(F.coalesce("__ok", F.raise_error(F.concat(F.lit("unknown sequence "), "seqid")).cast("boolean"))).select("org", "seqid", "midpoint", "cm")


def chained_hits(spark: SparkSession, path: str, least: float = 40.0) -> DataFrame:
    """Chained-hit text of 8 or more columns: 2 query, 3 subject, 4-7 ranges, 8 score; ``score > least``."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(p) >= 8))
    got = rows.select(p[1].alias("query"), p[2].alias("subject"), *[p[i + 3].cast("int").alias(c) for i, c in enumerate(("q_start", "q_end", "s_start", "s_end"))],
                      p[7].cast("double").alias("score"))
    flipped = F.col("s_start") > F.col("s_end")
    out = got.where(F.col("score") > least).select(
        "query", "subject", "q_start", "q_end", F.least("s_start", "s_end").alias("s_start"), F.greatest("s_start", "s_end").alias("s_end"),
        "score", F.when(flipped, "reverse").otherwise("forward").alias("orientation"))
    return out.to(_struct(CHAINED_HIT))


def _struct(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, value)``: lines in file order (the id's order; gaps don't matter)."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")


def _record(lines: DataFrame, begins: Column, name: str = "record") -> DataFrame:
    run = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.sum(F.when(begins, 1).otherwise(0)).over(run))


def chain_fragments(spark: SparkSession, path: str) -> DataFrame:
    """``C`` chain lines with the ``F`` fragment lines that follow: one row a chain, fragments as an array."""
    lines = _record(numbered(spark, path).where(~F.col("value").startswith("#")), F.col("value").startswith("C"))
    p = F.split("value", "\t")
    row = F.struct("line_no", p[1].alias("query"), p[2].alias("subject"), *[p[i + 3].cast("int").alias(c) for i, c in enumerate(("q_start", "q_end", "s_start", "s_end"))],
                   p[7].cast("double").alias("score"))
    chain, part = F.col("value").startswith("C"), F.col("value").startswith("F")
    return lines.where("record > 0").groupBy("file", "record").agg(
        F.min(F.when(chain, row)).alias("c"), F.array_sort(F.collect_list(F.when(part, row))).alias("fragments")).select("file", "record", "c.*", "fragments").drop("line_no")


def tabular_hits(spark: SparkSession, path: str, schema: str = TABULAR_HIT) -> DataFrame:
    """Tab-separated hits; a line with another number of columns or a bad value stops the job."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("mode", "FAILFAST").csv(path)


def gff3(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 features with ``attrs map``; comments and lines of fewer than 9 columns are skipped."""
    rows = spark.read.schema(GFF).option("sep", "\t").option("comment", "#").option("mode", "DROPMALFORMED").csv(path)
    return rows.where("attributes is not null").withColumn("attrs", F.str_to_map(F.regexp_replace("attributes", ";$", ""), F.lit(";"), F.lit("=")))


def spliced_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF of a spliced aligner: each ``##STA`` protein line goes with the next mRNA; CDS by parent."""
    lines = numbered(spark, path)
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    sta = F.when(F.col("value").startswith("##STA"), F.regexp_extract("value", r"^##STA\s+(\S+)", 1))
    p = F.split("value", "\t")
    attrs = F.str_to_map(F.regexp_replace(p[8], ";$", ""), F.lit(";"), F.lit("="))
    rows = lines.withColumn("protein", F.last(sta, ignorenulls=True).over(order)).where(~F.col("value").startswith("#") & (F.size(p) >= 9)).select(
        "file", p[0].alias("seqid"), p[2].alias("type"), p[3].cast("long").alias("start"), p[4].cast("long").alias("end"), p[6].alias("strand"), attrs.alias("attrs"), "protein")
    cds = rows.where("type = 'CDS'").groupBy("file", F.col("attrs")["Parent"].alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cds"))
    a = F.col("attrs")
    return rows.where("type = 'mRNA'").select(
        "file", a["ID"].alias("id"), "seqid", "start", "end", "strand", "protein", a["Identity"].cast("double").alias("identity"),
        F.coalesce(a["Frameshift"].cast("int"), F.lit(0)).alias("frameshifts"), F.coalesce(a["StopCodon"].cast("int"), F.lit(0)).alias("stop_codons"),
        a["Rank"].cast("int").alias("rank"), a["Target"].alias("target")).join(cds, ["file", "id"], "left")


def collinearity(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Blocks and their pairs: ``## Alignment`` headers, then numbered pair lines."""
    head = r"^## Alignment (\d+): score=([\d.]+) e_value=(\S+) N=(\d+) (\S+)&(\S+) (plus|minus)"
    lines = numbered(spark, path).where(F.col("value").startswith("## Alignment") | ~F.col("value").startswith("#"))
    rec = _record(lines, F.col("value").rlike(head)).where("record > 0")
    part = lambda i: F.regexp_extract("value", head, i)
    blocks = rec.where(F.col("value").rlike(head)).select(
        "file", "record", part(1).cast("int").alias("block_id"), part(2).cast("double").alias("score"), part(3).cast("double").alias("e_value"),
        part(4).cast("int").alias("n_pairs"), part(5).alias("chr1"), part(6).alias("chr2"), part(7).alias("orientation"))
    pair = r"^\s*(\d+)-\s*(\d+):\s+(\S+)\s+(\S+)"
    get = lambda i: F.regexp_extract("value", pair, i)
    pairs = rec.where(F.col("value").rlike(pair)).select(
        "file", "record", get(1).cast("int").alias("block_id"), get(2).cast("int").alias("pos"), get(3).alias("elem1"), get(4).alias("elem2"))
    return blocks, pairs


def table(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = "\t", strict: bool = True) -> DataFrame:
    """Flat tables (gff, homology, elements, segments, pair lists); ``strict`` stops at malformed rows, else skips them."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("comment", "#").option("mode", mode).csv(path)


def pairwise_alignments(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """13-column alignment table: malformed rows skipped, NA read as null, swapped coordinates put right."""
    rows = spark.read.schema(schema).option("sep", "\t").option("mode", "DROPMALFORMED").option("nullValue", "NA").csv(path).where("org1 is not null and org2 is not null")
    order = lambda a, b: {a: F.least(a, b), b: F.greatest(a, b)}
    return rows.withColumns(order("start1", "end1")).withColumns(order("start2", "end2"))


def coords(spark: SparkSession, path: str) -> DataFrame:
    """5 or 6 columns: org, seqid, start, end, orientation[, name]; the default name is made of the first four."""
    rows = spark.read.schema("org string, seqid string, start long, end long, orientation string, name string").option("sep", "\t").option("comment", "#").csv(path)
    return rows.withColumns({"start": F.least("start", "end"), "end": F.greatest("start", "end")}).withColumn(
        "name", F.coalesce("name", F.concat_ws("_", "org", "seqid", "start", "end")))


def strand_table(spark: SparkSession, path: str) -> DataFrame:
    """seqid, start, end, plus|minus: validated, swapped coordinates put right, strand as + or -."""
    rows = spark.read.schema("seqid string, start long, end long, strand string").option("sep", "\t").option("mode", "FAILFAST").csv(path)
    sign = F.when(F.col("strand") == "plus", "+").when(F.col("strand") == "minus", "-").otherwise(F.raise_error(F.concat(F.lit("strand "), "strand")))
    return rows.select("seqid", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"), sign.alias("strand"))


def orthogroups(spark: SparkSession, path: str) -> DataFrame:
    """Wide group x species matrix with comma lists -> ``(group, species, gene_id)``."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    first, *species = wide.columns
    return wide.unpivot([first], species, "species", "genes").where("genes is not null").select(
        F.col(first).alias("group"), "species", F.explode(F.split("genes", r",\s*")).alias("gene_id")).where("gene_id <> ''")


def parameters(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Parameter rows of kind kmer, complexity or dups (a missing flag is 0)."""
    ddl = {"kmer": PARAM_KMER, "complexity": PARAM_COMPLEXITY, "dups": PARAM_DUPS}[kind]
    rows = spark.read.schema(ddl).option("sep", "\t").option("comment", "#").csv(path)
    return rows.where("org is not null").withColumn("flag", F.coalesce("flag", F.lit(0)))


def names(spark: SparkSession, path: str) -> DataFrame:
    """One name a line, comments and repeats dropped."""
    return spark.read.text(path).select(F.trim("value").alias("org")).where("org <> '' and not startswith(org, '#')").distinct()


def alias_sections(spark: SparkSession, path: str) -> DataFrame:
    """Alias file: ``#`` lines open an organism's section, the lines in it map ``chrom_id`` to ``seqid``."""
    rec = _record(numbered(spark, path).where("trim(value) <> ''"), F.col("value").startswith("#"), "section")
    head = rec.where(F.col("value").startswith("#")).select("file", "section", F.split(F.regexp_replace("value", r"^#\s*", ""), r"\s+").alias("h"))
    body = rec.where(~F.col("value").startswith("#")).select("file", "section", F.split("value", r"\s+").alias("b"))
    return body.join(head, ["file", "section"]).select(
        F.col("h")[0].alias("org_id"), F.get("h", F.lit(1)).alias("org"), F.col("b")[0].alias("chrom_id"), F.get("b", F.lit(1)).alias("seqid"))


def pickled_matches(spark: SparkSession, path: str, org: str, schema: str, trusted: bool = False) -> DataFrame:
    """One-off import of nested dictionaries ``{id1: {org2: {id2: (score, (start, end), orientation)}}}``.

    Unpickling runs code: only for files of one's own, said by ``trusted=True``.
    """
    if not trusted:
        raise ValueError("unpickling needs trusted=True")
    import pickle

    import pandas as pd

    def load(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = [(org, int(i), o2, int(j), float(v[0]), int(v[1][0]), int(v[1][1]), v[2])
                        for i, per in pickle.loads(content).items() for o2, hits in per.items() for j, v in hits.items()]
                yield pd.DataFrame(rows, columns=["org1", "id1", "org2", "id2", "score", "hit_start", "hit_end", "orientation"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, schema)
