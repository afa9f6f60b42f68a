"""Round trips: the test tables are written in each text format, read back and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PAIRWISE, TABULAR_HIT
from ..sources import readers as rd, writers as wr
from ..storage import shared_dir
from .analogues import SQL_EVENTS, SQL_PAIRS, intervals, pairs, table
from .catalogue import register


def _file(spark: SparkSession, line: Column, rows: DataFrame) -> str:
    """Folder of text files with one ``line`` (it may hold line feeds) a row."""
    path = f"{shared_dir(spark)}/io/{uuid.uuid4().hex}"
    rows.select(line.alias("line")).write.text(path)
    return path


def _tab(*cols) -> Column:
    return F.concat_ws("\t", *[c if isinstance(c, Column) else F.col(c).cast("string") for c in cols])


def _s(x) -> Column:
    return F.lit(str(x))


# -- sequences

_SEQS = "s AS (SELECT 'd' || doc_id AS seqid, regexp_replace(lower(text), '[^acgt]', '', 'g') AS seq FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"


def _fasta(spark, d):
    docs = table(spark, d, "documents").where("doc_id is not null and text is not null")
    seq = F.regexp_replace(F.regexp_replace(F.lower("text"), "[^acgt]", ""), "(.{60})", "$1\n")
    head = F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" a document\n"))
    return rd.fasta(spark, _file(spark, F.concat(head, seq), docs), "o")


@register("R60_fasta_scan", f"WITH {_SEQS} SELECT 'o' AS org, seqid, seq, length(seq) AS length FROM s")
def fasta(spark, d):
    return _fasta(spark, d).select("org", "seqid", "seq", "length")


@register("R60b_fasta_ordinals", f"WITH {_SEQS} SELECT 0 AS least, count(*) - 1 AS most, count(*) AS n FROM s")
def ordinals(spark, d):
    return _fasta(spark, d).agg(F.min("ordinal").alias("least"), F.max("ordinal").alias("most"), F.countDistinct("ordinal").alias("n"))


@register("R60c_chunked_sequences", f"""
WITH {_SEQS}, c AS (SELECT seqid, seq, unnest(range(greatest(ceil((length(seq) - 20) / 180.0), 1)::BIGINT)) AS chunk_no FROM s)
SELECT 'o' AS org, seqid, chunk_no, chunk_no * 180 AS start, substr(seq, chunk_no * 180 + 1, 200) AS seq FROM c""")
def chunked(spark, d):
    return rd.chunks(_fasta(spark, d), 200, 20)


# -- hits and features


@register("R61_complexity_text", f"WITH e AS ({SQL_EVENTS}) SELECT 'o' AS org, 'u' || user_id AS seqid, start AS midpoint, value AS cm FROM e")
def complexity(spark, d):
    e = intervals(spark, d).withColumn("seqid", F.concat(F.lit("u"), "user_id"))
    path = _file(spark, F.concat_ws(" ", "seqid", F.col("start").cast("string"), F.col("value").cast("string")), e)
    return rd.complexity(spark, path, e.select("seqid").distinct(), "o")


_HIT = """h AS (SELECT 'q' || l_partkey AS query, 's' || l_suppkey AS subject, l_linenumber::INT AS q_start, (l_linenumber + l_orderkey % 50)::INT AS q_end,
  (l_partkey % 100)::INT AS a, (l_partkey % 100 + 30)::INT AS z, l_quantity * 2 AS score, l_returnflag = 'R' AS rev, l_orderkey, l_linenumber FROM lineitem)"""


def _hits(spark, d):
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("q"), "l_partkey").alias("query"), F.concat(F.lit("s"), "l_suppkey").alias("subject"), F.col("l_linenumber").alias("q_start"),
        (F.col("l_linenumber") + F.col("l_orderkey") % 50).alias("q_end"), (F.col("l_partkey") % 100).alias("a"), (F.col("l_partkey") % 100 + 30).alias("z"),
        (F.col("l_quantity") * 2).cast("double").alias("score"), (F.col("l_returnflag") == "R").alias("rev"), "l_orderkey")


def _hit_line(letter: str, rev: Column) -> Column:
    return _tab(_s(letter), "query", "subject", "q_start", "q_end", F.when(rev, F.col("z")).otherwise(F.col("a")).cast("string"),
                F.when(rev, F.col("a")).otherwise(F.col("z")).cast("string"), "score")


@register("R62_chained_hits", f"""
WITH {_HIT} SELECT query, subject, q_start, q_end, a AS s_start, z AS s_end, score, CASE WHEN rev THEN 'reverse' ELSE 'forward' END AS orientation FROM h WHERE score > 40""")
def chained(spark, d):
    return rd.chained_hits(spark, _file(spark, _hit_line("C", F.col("rev")), _hits(spark, d)))


@register("R62b_chain_fragments", f"""
WITH {_HIT} SELECT 'o' || l_orderkey AS query, sum(score) AS score, count(*) AS n_fragments, min(q_start) AS first_start, max(score) AS best FROM h GROUP BY l_orderkey""")
def fragments(spark, d):
    h = _hits(spark, d)
    by = h.groupBy("l_orderkey").agg(
        F.array_join(F.collect_list(_hit_line("F", F.lit(False))), "\n").alias("parts"), F.sum("score").alias("score"))
    head = _tab(_s("C"), F.concat(F.lit("o"), "l_orderkey"), _s("all"), _s(1), _s(2), _s(3), _s(4), "score")
    got = rd.chain_fragments(spark, _file(spark, F.concat(head, F.lit("\n"), "parts"), by))
    return got.select("query", "score", F.size("fragments").cast("long").alias("n_fragments"),
                      F.array_min(F.transform("fragments", lambda f: f["q_start"])).alias("first_start"), F.array_max(F.transform("fragments", lambda f: f["score"])).alias("best"))


@register("R63_tabular_hits", """
SELECT 'q' || l_partkey AS qseqid, 's' || l_suppkey AS sseqid, l_discount AS pident, l_linenumber::INT AS length, l_tax AS evalue, l_extendedprice AS bitscore FROM lineitem""")
def tabular(spark, d):
    li = table(spark, d, "lineitem")
    line = _tab(F.concat(F.lit("q"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"), "l_discount", "l_linenumber", _s(0), _s(0), _s(1), _s(9), _s(1), _s(9), "l_tax", "l_extendedprice")
    return rd.tabular_hits(spark, _file(spark, line, li), TABULAR_HIT).select("qseqid", "sseqid", "pident", "length", "evalue", "bitscore")


@register("R64_spliced_gff", """
SELECT 'M' || l_orderkey AS id, 'c' || l_orderkey % 9 AS seqid, 'P' || l_orderkey AS protein, min(l_discount) AS identity, (l_orderkey % 3)::INT AS frameshifts,
       count(*) AS n_cds, min(10 * l_linenumber)::BIGINT AS first_cds, max(10 * l_linenumber + 7)::BIGINT AS last_cds FROM lineitem GROUP BY l_orderkey""")
def spliced(spark, d):
    o = F.col("l_orderkey").cast("string")
    chrom = F.concat(F.lit("c"), (F.col("l_orderkey") % 9).cast("string"))
    cds = _tab(chrom, _s("m"), _s("CDS"), (10 * F.col("l_linenumber")).cast("string"), (10 * F.col("l_linenumber") + 7).cast("string"), _s("."), _s("+"), _s(0), F.concat(F.lit("Parent=M"), o))
    by = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(cds), "\n").alias("parts"), F.min("l_discount").alias("identity"))
    attrs = F.concat(F.lit("ID=M"), o, F.lit(";Identity="), F.col("identity").cast("string"), F.lit(";Rank=1;Frameshift="), (F.col("l_orderkey") % 3).cast("string"), F.lit(";Target=p 1 9;"))
    head = F.concat(F.lit("##STA P"), o, F.lit("\n"), _tab(chrom, _s("m"), _s("mRNA"), _s(1), _s(99), _s(5), _s("+"), _s("."), attrs))
    got = rd.spliced_gff(spark, _file(spark, F.concat(head, F.lit("\n"), "parts"), by))
    return got.select("id", "seqid", "protein", "identity", "frameshifts", F.size("cds").cast("long").alias("n_cds"),
                      F.array_min(F.transform("cds", lambda c: c["start"])).alias("first_cds"), F.array_max(F.transform("cds", lambda c: c["end"])).alias("last_cds"))


def _collinear(spark, d):
    li = table(spark, d, "lineitem")
    pair = F.format_string("%3d-%3d:\tp%d\ts%d\t0", F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long"))
    by = li.groupBy("l_orderkey").agg(F.array_join(F.collect_list(pair), "\n").alias("parts"), F.count("*").alias("n"))
    head = F.format_string("## Alignment %d: score=%d.5 e_value=1e-9 N=%d %dorgchr1&9orgchr2 %s", F.col("l_orderkey").cast("long"), (F.col("l_orderkey") % 1000).cast("long"), "n",
                           (F.col("l_orderkey") % 5).cast("long"), F.when(F.col("l_orderkey") % 2 == 0, "plus").otherwise("minus"))
    return rd.collinearity(spark, _file(spark, F.concat(F.lit("# parameters\n"), head, F.lit("\n"), "parts"), by))


@register("R65_collinear_blocks", """
SELECT l_orderkey::INT AS block_id, (l_orderkey % 1000) + 0.5::DOUBLE AS score, count(*)::INT AS n_pairs, (l_orderkey % 5) || 'orgchr1' AS chr1, CASE WHEN l_orderkey % 2 = 0 THEN 'plus' ELSE 'minus' END AS orientation
FROM lineitem GROUP BY l_orderkey""")
def blocks(spark, d):
    return _collinear(spark, d)[0].select("block_id", "score", "n_pairs", "chr1", "orientation")


@register("R65b_collinear_pairs", "SELECT l_orderkey::INT AS block_id, l_linenumber::INT AS pos, 'p' || l_partkey AS elem1, 's' || l_suppkey AS elem2 FROM lineitem")
def block_pairs(spark, d):
    return _collinear(spark, d)[1].select("block_id", "pos", "elem1", "elem2")


# -- flat tables


@register("R66_flat_table", """
SELECT 'c' || o_custkey AS chrom, 'o' || o_orderkey AS name, o_orderkey AS start, o_orderkey + 10 AS "end" FROM orders""")
def flat(spark, d):
    line = _tab(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey"), "o_orderkey", (F.col("o_orderkey") + 10).cast("string"))
    return rd.table(spark, _file(spark, F.concat(F.lit("# note\n"), line), table(spark, d, "orders")), "chrom string, name string, start long, end long")


@register("R66b_flat_table_with_bad_rows", "SELECT 'c' || o_custkey AS chrom, o_orderkey AS start FROM orders WHERE o_orderkey % 7 <> 0")
def flat_bad(spark, d):
    line = _tab(F.concat(F.lit("c"), "o_custkey"), F.when(F.col("o_orderkey") % 7 == 0, "bad").otherwise(F.col("o_orderkey").cast("string")))
    return rd.table(spark, _file(spark, line, table(spark, d, "orders")), "chrom string, start long", strict=False)


@register("R67_pairwise_alignments", """
SELECT l_orderkey * 10 + l_linenumber AS aln_id, 'o' || l_partkey % 3 AS org1, l_partkey AS start1, l_partkey + l_linenumber AS end1, 'o' || l_suppkey % 4 AS org2, l_suppkey AS start2, l_suppkey + 5 AS end2,
       l_quantity AS score, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS score12 FROM lineitem""")
def alignments(spark, d):
    li = table(spark, d, "lineitem")
    swap = F.col("l_linenumber") % 2 == 0
    a, z = F.col("l_partkey"), F.col("l_partkey") + F.col("l_linenumber")
    line = _tab((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"), F.concat(F.lit("o"), F.col("l_partkey") % 3), _s("c1"), F.when(swap, z).otherwise(a).cast("string"), F.when(swap, a).otherwise(z).cast("string"),
                F.concat(F.lit("o"), F.col("l_suppkey") % 4), _s("c2"), (F.col("l_suppkey") + 5).cast("string"), "l_suppkey", _s("forward"), "l_quantity",
                F.when(F.col("l_returnflag") == "N", "NA").otherwise(F.col("l_returnflag")), _s("NA"))
    got = rd.pairwise_alignments(spark, _file(spark, F.concat(line, F.lit("\nbroken line")), li), PAIRWISE)
    return got.select("aln_id", "org1", "start1", "end1", "org2", "start2", "end2", "score", "score12")


@register("R68_coordinates", """
SELECT 'o' AS org, 'c' || o_custkey AS seqid, o_orderkey AS start, o_orderkey + 3 AS "end", 'forward' AS orientation,
       CASE WHEN o_orderkey % 2 = 0 THEN 'n' || o_orderkey ELSE 'o_c' || o_custkey || '_' || o_orderkey || '_' || (o_orderkey + 3) END AS name FROM orders""")
def coordinates(spark, d):
    o = table(spark, d, "orders")
    line = _tab(_s("o"), F.concat(F.lit("c"), "o_custkey"), (F.col("o_orderkey") + 3).cast("string"), "o_orderkey", _s("forward"))
    named = F.when(F.col("o_orderkey") % 2 == 0, F.concat(line, F.lit("\tn"), "o_orderkey")).otherwise(line)
    return rd.coords(spark, _file(spark, named, o))


@register("R69_strands", """
SELECT 'c' || o_custkey AS seqid, o_orderkey AS start, o_orderkey + 9 AS "end", CASE WHEN o_orderstatus = 'F' THEN '+' ELSE '-' END AS strand FROM orders""")
def strands(spark, d):
    o = table(spark, d, "orders")
    line = _tab(F.concat(F.lit("c"), "o_custkey"), (F.col("o_orderkey") + 9).cast("string"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "plus").otherwise("minus"))
    return rd.strand_table(spark, _file(spark, line, o))


@register("R70_orthogroups", """
SELECT 'S' || l_orderkey AS "group", l_returnflag AS species, 'g' || l_partkey || '_' || l_linenumber AS gene_id FROM lineitem""")
def orthogroups(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_orderkey").alias("id"), "l_returnflag", F.concat(F.lit("g"), "l_partkey", F.lit("_"), "l_linenumber").alias("gene"))
    wide = li.groupBy("id").pivot("l_returnflag", ["A", "N", "R"]).agg(F.array_join(F.collect_list("gene"), ", "))
    path = f"{shared_dir(spark)}/io/{uuid.uuid4().hex}"
    wide.write.option("sep", "\t").option("header", True).csv(path)
    return rd.orthogroups(spark, path).withColumnRenamed("id", "group")


@register("R71_parameters", """
SELECT 'o' || s_suppkey AS org, 13 AS k, (s_suppkey % 3)::INT AS e, 300 AS window, 50 AS pitch, (s_suppkey % 100)::INT AS percentile, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS flag FROM supplier""")
def parameters(spark, d):
    s = F.col("s_suppkey")
    line = _tab(F.concat(F.lit("o"), "s_suppkey"), _s(13), (s % 3).cast("string"), _s(300), _s(50), (s % 100).cast("string"))
    return rd.parameters(spark, _file(spark, F.when(s % 2 == 0, F.concat(line, F.lit("\t1"))).otherwise(line), table(spark, d, "supplier")), "kmer")


@register("R72_name_list", "SELECT DISTINCT 'c' || o_custkey AS org FROM orders")
def name_list(spark, d):
    return rd.names(spark, _file(spark, F.concat(F.lit("# comment\n\n  c"), "o_custkey", F.lit(" ")), table(spark, d, "orders")))


@register("R73_alias_sections", """
SELECT n_nationkey || 'org' AS org_id, n_name AS org, n_nationkey || 'orgchr' || s_suppkey AS chrom_id, s_name AS seqid FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def alias_sections(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    line = F.concat(F.col("s_nationkey").cast("string"), F.lit("orgchr"), "s_suppkey", F.lit(" "), F.regexp_replace("s_name", " ", "~"))
    by = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.collect_list(line), "\n").alias("parts")).join(n, "n_nationkey")
    head = F.concat(F.lit("# "), "n_nationkey", F.lit("org "), F.regexp_replace("n_name", " ", "~"))
    got = rd.alias_sections(spark, _file(spark, F.concat(head, F.lit("\n"), "parts"), by))
    return got.select("org_id", F.regexp_replace("org", "~", " ").alias("org"), "chrom_id", F.regexp_replace("seqid", "~", " ").alias("seqid"))


# -- writers

_CAND = f"""e AS ({SQL_EVENTS}), c AS (SELECT event_type AS org, event_id AS anchor_id, 'u' || user_id AS seqid, start % 1000 AS rel_start, start, "end",
  translate(md5(event_id::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM e)"""


def _candidates(spark, d):
    return intervals(spark, d).select(
        F.col("event_type").alias("org"), F.col("event_id").alias("anchor_id"), F.concat(F.lit("u"), "user_id").alias("seqid"), (F.col("start") % 1000).alias("rel_start"), "start", "end",
        F.translate(F.md5(F.col("event_id").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


@register("R74_query_fasta", f"""
WITH {_CAND} SELECT org, anchor_id AS line_no, '>kmer$' || anchor_id || '$' || seqid || '$' || rel_start || '$' || "end" || chr(10) || seq AS line FROM c
UNION ALL SELECT org, anchor_id, '>kmer$' || anchor_id || '$' || seqid || '$' || rel_start || '$' || "end" || chr(10) || reverse(translate(seq, 'ACGT', 'TGCA')) FROM c""")
def query_fasta(spark, d):
    c = _candidates(spark, d)
    return wr.query_fasta(c).union(wr.query_fasta(c, reverse=True))


@register("R74b_fasta_through_files", f"WITH {_CAND} SELECT org, 'kmer$' || anchor_id || '$' || seqid || '$' || rel_start || '$' || \"end\" AS seqid, seq FROM c")
def fasta_files(spark, d):
    path = f"{shared_dir(spark)}/io/{uuid.uuid4().hex}"
    wr.write_lines(wr.query_fasta(_candidates(spark, d)), path, by=["org"])
    orgs = [r.org for r in table(spark, d, "events").select(F.col("event_type").alias("org")).distinct().collect()]
    out = None
    for org in orgs:
        one = rd.fasta(spark, f"{path}/org={org}", org).select("org", "seqid", "seq")
        out = one if out is None else out.union(one)
    return out


@register("R75_gff3_anchors", f"""
WITH {_CAND}, n AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY anchor_id) AS n FROM c)
SELECT org, n AS line_no, concat_ws(chr(9), seqid, 'anchors', 'anchor', start + 1, "end", '.', '.', '.', 'ID=anchor' || n) AS line FROM n""")
def gff3_anchors(spark, d):
    return wr.gff3_anchors(_candidates(spark, d))


_MT = f"""p AS ({SQL_PAIRS}), mt AS (
  SELECT 'p' AS org1, part AS id1, 's' AS org2, supp AS id2, CASE part % 3 WHEN 0 THEN 'dup' WHEN 1 THEN 'regular' ELSE 'not_considered' END AS kind, supp % 2 = 0 AS syntenic, score, part % 2 = 0 AS inverted FROM p
  UNION ALL SELECT 's', supp, 'p', part, 'regular', false, score, false FROM p),
k AS (SELECT DISTINCT 'p' AS org, part AS id, 'c' || part % 4 AS seqid, part * 10 AS start FROM p UNION ALL SELECT DISTINCT 's', supp, 'd' || supp % 3, supp * 7 FROM p)"""


def _mt(spark, d):
    p = pairs(spark, d)
    kind = F.when(F.col("part") % 3 == 0, "dup").when(F.col("part") % 3 == 1, "regular").otherwise("not_considered")
    one = p.select(F.lit("p").alias("org1"), F.col("part").alias("id1"), F.lit("s").alias("org2"), F.col("supp").alias("id2"), kind.alias("kind"),
                   (F.col("supp") % 2 == 0).alias("syntenic"), "score", (F.col("part") % 2 == 0).alias("inverted"))
    two = p.select(F.lit("s"), "supp", F.lit("p"), "part", F.lit("regular"), F.lit(False), "score", F.lit(False))
    own = {"own_start": F.lit(1), "own_end": F.lit(5), "other_start": F.lit(2), "other_end": F.lit(6)}
    k = p.select(F.lit("p").alias("org"), F.col("part").alias("anchor_id"), F.concat(F.lit("c"), F.col("part") % 4).alias("seqid"), (F.col("part") * 10).alias("start")).distinct().union(
        p.select(F.lit("s"), "supp", F.concat(F.lit("d"), F.col("supp") % 3), F.col("supp") * 7).distinct())
    return one.union(two).withColumns(own), k


@register("R76_pairwise_table", f"""
WITH {_MT}, u AS (SELECT * FROM mt WHERE org1 = 'p' AND (kind = 'regular' OR (kind = 'dup' AND syntenic)))
SELECT row_number() OVER (ORDER BY CASE kind WHEN 'regular' THEN 0 ELSE 1 END, id1, id2) AS aln_id, org1, a.seqid AS chr1, a.start + 1 AS start1, a.start + 5 AS end1,
       org2, b.seqid AS chr2, b.start + 2 AS start2, b.start + 6 AS end2, CASE WHEN inverted THEN 'reverse' ELSE 'forward' END AS orientation, score
FROM u JOIN k a ON a.org = org1 AND a.id = id1 JOIN k b ON b.org = org2 AND b.id = id2""")
def pairwise_table(spark, d):
    m, k = _mt(spark, d)
    order = spark.createDataFrame([("p", 0), ("s", 1)], "org string, rank int")
    return wr.pairwise_table(m, k, order).drop("score12", "score21")


@register("R77_collinearity_inputs", f"""
WITH {_MT}, n AS (SELECT org, id, (CASE org WHEN 'p' THEN '1' ELSE '2' END) || 'orgchr' || right(seqid, 1) AS chrom_id, start, start + 9 AS "end" FROM k),
x AS (SELECT org, id, chrom_id, start, "end", chrom_id || 'ele' || start || 'to' || "end" AS name FROM n)
SELECT 'homology' AS what, a.name AS a, b.name AS b, CAST(score AS BIGINT) AS n FROM p JOIN x a ON a.org = 'p' AND a.id = part JOIN x b ON b.org = 's' AND b.id = supp
UNION ALL SELECT 'gff', chrom_id, name, start FROM x UNION ALL SELECT 'bed', chrom_id, name, "end" FROM x""")
def collinearity_inputs(spark, d):
    _, k = _mt(spark, d)
    anchors = k.withColumn("end", F.col("start") + 9)
    names = k.select("org", "seqid").distinct().withColumn(
        "chrom_id", F.concat(F.when(F.col("org") == "p", "1").otherwise("2"), F.lit("orgchr"), F.substring("seqid", -1, 1)))
    mutual = pairs(spark, d).select(F.lit("p").alias("org1"), F.col("part").alias("id1"), F.lit("s").alias("org2"), F.col("supp").alias("id2"), "score")
    out = wr.collinearity_inputs(mutual, anchors, names)
    return (
        out["homology"].select(F.lit("homology").alias("what"), F.col("name1").alias("a"), F.col("name2").alias("b"), F.col("score").cast("long").alias("n"))
        .union(out["gff"].select(F.lit("gff"), "chrom_id", "name", "start")).union(out["bed"].select(F.lit("bed"), "chrom_id", "name", "end"))
    )


@register("R78_marker_lines", """
WITH m AS (SELECT 's' || l_suppkey % 5 AS species, 'c' || l_partkey % 7 AS chrom, l_orderkey AS start, l_orderkey + l_linenumber AS "end", 'm' || l_orderkey || '_' || l_linenumber AS cluster FROM lineitem)
SELECT species, row_number() OVER (PARTITION BY species ORDER BY chrom, start, cluster) AS line_no, concat_ws(chr(9), cluster, chrom, start, "end") AS line FROM m""")
def marker_lines(spark, d):
    li = table(spark, d, "lineitem")
    return wr.marker_lines(li.select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("species"), F.concat(F.lit("c"), F.col("l_partkey") % 7).alias("chrom"), F.col("l_orderkey").alias("start"),
        (F.col("l_orderkey") + F.col("l_linenumber")).alias("end"), F.concat(F.lit("m"), "l_orderkey", F.lit("_"), "l_linenumber").alias("cluster")))


@register("R78b_verbose_regions", """
SELECT 'o' AS org, 'c' || o_custkey AS seqid, o_orderkey AS start, 'o c' || o_custkey || ':' || o_orderkey || '-' || (o_orderkey + 5) || ' (' || (o_orderkey % 9) || ' anchors)' AS line FROM orders""")
def verbose(spark, d):
    o = table(spark, d, "orders")
    return wr.verbose_regions(o.select(F.lit("o").alias("org"), F.concat(F.lit("c"), "o_custkey").alias("seqid"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 5).alias("end"), (F.col("o_orderkey") % 9).alias("n")))


_CONTIG = "k AS (SELECT 'k' || s_suppkey AS contig, translate(md5(s_suppkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, s_suppkey, s_nationkey FROM supplier)"


def _contigs(spark, d):
    return table(spark, d, "supplier").select(
        F.concat(F.lit("k"), "s_suppkey").alias("contig"), F.translate(F.md5(F.col("s_suppkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"), "s_suppkey", "s_nationkey")


@register("R79_scaffold_sequences", f"""
WITH {_CONTIG} SELECT 'n' || s_nationkey AS scaffold, string_agg(CASE WHEN s_suppkey % 3 = 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, repeat('N', 100) ORDER BY s_suppkey) AS seq
FROM k WHERE s_suppkey % 4 <> 0 GROUP BY s_nationkey UNION ALL SELECT contig, seq FROM k WHERE s_suppkey % 4 = 0""")
def scaffolds(spark, d):
    k = _contigs(spark, d)
    placed = k.where("s_suppkey % 4 <> 0").select(
        F.concat(F.lit("n"), "s_nationkey").alias("scaffold"), F.col("s_suppkey").alias("pos"), "contig", F.when(F.col("s_suppkey") % 3 == 0, "reverse").otherwise("forward").alias("orientation"))
    return wr.scaffold_fasta(placed, k.select("contig", "seq"))


@register("R79b_region_sequences", f"""
WITH {_CONTIG}, r AS (SELECT 'o' AS org, contig AS seqid, s_suppkey % 7 AS start, s_suppkey % 7 + 12 AS "end", seq FROM k)
SELECT org, row_number() OVER (ORDER BY seqid, start) AS line_no, '>o_' || seqid || '_' || start || '_' || "end" || '_forward' || chr(10) || substr(seq, start + 1, 12) AS line FROM r""")
def region_sequences(spark, d):
    k = _contigs(spark, d)
    chunks = rd.chunks(k.select(F.lit("o").alias("org"), F.col("contig").alias("seqid"), "seq", F.length("seq").cast("long").alias("length")), 20, 12)
    regions = k.select(F.lit("o").alias("org"), F.col("contig").alias("seqid"), (F.col("s_suppkey") % 7).alias("start"), (F.col("s_suppkey") % 7 + 12).alias("end"))
    return wr.region_fasta(regions, chunks)
