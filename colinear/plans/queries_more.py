"""Small operators over the test tables: coordinates, sequences, parameters, matches and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, params, sequences as sq
from ..operators import coords, delta, graph, joins as jn, matching as mt, validate as va
from .analogues import SQL_EVENTS, SQL_PAIRS, intervals, pairs, table
from .catalogue import register

# -- coordinates and sequences


@register("R80_strand_flip", """
SELECT o_orderkey, 90000 - (o_orderkey % 900 + 50) AS start, 90000 - o_orderkey % 900 AS "end", 90000 - (o_orderkey % 900 + 50) + 1 AS self_start, 90000 - o_orderkey % 900 + 1 AS self_end FROM orders""")
def flip(spark, d):
    s = F.col("o_orderkey") % 900
    two, one = coords.flip(s, s + 50, F.lit(90000)), coords.flip(s, s + 50, F.lit(90000), pairwise=False)
    return table(spark, d, "orders").select("o_orderkey", two[0].alias("start"), two[1].alias("end"), one[0].alias("self_start"), one[1].alias("self_end"))


@register("R80b_region_to_genome", """
WITH o AS (SELECT o_orderkey, o_orderkey % 50 AS s, o_orderkey % 50 + 7 AS e, o_custkey * 100 AS r0, o_custkey * 100 + 80 AS r1, o_orderstatus = 'F' AS rev, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS st FROM orders)
SELECT o_orderkey, CASE WHEN rev THEN r1 - e + 1 ELSE r0 + s END AS start, CASE WHEN rev THEN r1 - s + 1 ELSE r0 + e END AS "end", CASE WHEN rev = (st = '+') THEN '-' ELSE '+' END AS strand FROM o""")
def region(spark, d):
    s, r = F.col("o_orderkey") % 50, F.col("o_custkey") * 100
    lo, hi, strand = coords.region_to_genome(s, s + 7, r, r + 80, F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-"))
    return table(spark, d, "orders").select("o_orderkey", lo.alias("start"), hi.alias("end"), strand.alias("strand"))


@register("R80c_mirrored_positions", "SELECT o_orderkey, 5000000 - o_orderkey AS mirrored, true AS inverse FROM orders")
def mirrored(spark, d):
    m = coords.mirror(F.col("o_orderkey"), F.lit(5_000_000))
    return table(spark, d, "orders").select("o_orderkey", m.alias("mirrored"), (coords.mirror(m, F.lit(5_000_000)) == F.col("o_orderkey")).alias("inverse"))


@register("R81_spliced_coding_sequences", """
WITH e AS (SELECT l_orderkey, string_agg(translate(left(md5((l_orderkey * 10 + l_linenumber)::VARCHAR), 10), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY l_linenumber) AS seq FROM lineitem GROUP BY l_orderkey),
o AS (SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq FROM e),
f AS (SELECT l_orderkey, substr(seq, (l_orderkey % 3)::BIGINT + 1) AS seq FROM o)
SELECT l_orderkey, left(seq, length(seq) - length(seq) % 3) AS cds FROM f""")
def spliced(spark, d):
    dna = F.translate(F.left(F.md5((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").cast("binary")), F.lit(10)), "0123456789abcdef", "ACGTACGTACGTACGT")
    e = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("start"), dna.alias("seq"))).alias("exons"))
    return e.select("l_orderkey", sq.splice(F.col("exons"), F.when(F.col("l_orderkey") % 2 == 0, "-").otherwise("+"), (F.col("l_orderkey") % 3).cast("int")).alias("cds"))


@register("R81b_k_by_genome_size", "SELECT c_custkey, ceil(log2((c_custkey * 7919)::DOUBLE) / 2)::INT AS k FROM customer WHERE c_custkey > 0")
def auto_k(spark, d):
    return table(spark, d, "customer").where("c_custkey > 0").select("c_custkey", sq.auto_k(F.col("c_custkey") * 7919).alias("k"))


@register("R81c_accessions", r"""
WITH n AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'GCF_' || lpad(c_custkey::VARCHAR, 9, '0') || '.1' WHEN 1 THEN 'GCA_' || lpad(c_custkey::VARCHAR, 9, '0') || '.2' WHEN 2 THEN 'GCF_' || c_custkey ELSE 'species' || c_custkey END AS name FROM customer)
SELECT name, regexp_full_match(name, 'GC[AF]_[0-9]{9}[.][0-9]+') AS accession FROM n""")
def accessions(spark, d):
    nine = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    k = F.col("c_custkey") % 4
    name = (F.when(k == 0, F.concat(F.lit("GCF_"), nine, F.lit(".1"))).when(k == 1, F.concat(F.lit("GCA_"), nine, F.lit(".2")))
            .when(k == 2, F.concat(F.lit("GCF_"), "c_custkey")).otherwise(F.concat(F.lit("species"), "c_custkey")))
    return table(spark, d, "customer").select(name.alias("name")).withColumn("accession", names.is_accession(F.col("name")))


@register("R82_default_parameters", """
SELECT 'o' || s_suppkey AS org, ceil(log2((s_suppkey * 1000 + 4)::DOUBLE) / 2)::INT AS k, 0 AS e, 300 AS window, 50 AS pitch, 42 AS percentile, 0 AS flag FROM supplier""")
def defaults(spark, d):
    g = table(spark, d, "supplier").select(F.concat(F.lit("o"), "s_suppkey").alias("org"), (F.col("s_suppkey") * 1000 + 4).alias("size"))
    return params.default_parameters(g, "kmer")


@register("R82b_parameter_problems", """
WITH p AS (SELECT 'o' || s_suppkey AS org, 13 + s_suppkey % 30 AS k, s_suppkey % 4 - 1 AS e, 300 - s_suppkey % 5 * 100 AS w, 50 + s_suppkey % 3 * 150 AS pitch, s_suppkey % 130 - 10 AS pc, s_suppkey % 3 AS flag FROM supplier)
SELECT org, 'error' AS severity, 'pitch not below window' AS problem FROM p WHERE pitch >= w
UNION ALL SELECT org, 'error', 'window not positive' FROM p WHERE w <= 0
UNION ALL SELECT org, 'error', 'pitch not positive' FROM p WHERE pitch <= 0
UNION ALL SELECT org, 'error', 'percentile not within 0..100' FROM p WHERE pc NOT BETWEEN 0 AND 100
UNION ALL SELECT org, 'error', 'k not positive' FROM p WHERE k <= 0
UNION ALL SELECT org, 'error', 'window shorter than k' FROM p WHERE w < k
UNION ALL SELECT org, 'error', 'e not within 0..4' FROM p WHERE e NOT BETWEEN 0 AND 4
UNION ALL SELECT org, 'error', 'flag not 0 or 1' FROM p WHERE flag NOT IN (0, 1)
UNION ALL SELECT org, 'error', 'repeated organism' FROM (SELECT org FROM p GROUP BY org HAVING count(*) > 1)
UNION ALL SELECT org, 'warning', 'unknown organism' FROM p WHERE org NOT IN (SELECT 'o' || c_custkey FROM customer WHERE c_custkey % 3 <> 0)
UNION ALL SELECT DISTINCT 'o' || c_custkey, 'warning', 'no parameters' FROM customer WHERE c_custkey % 3 <> 0 AND 'o' || c_custkey NOT IN (SELECT org FROM p)""")
def problems(spark, d):
    s = F.col("s_suppkey")
    p = table(spark, d, "supplier").select(
        F.concat(F.lit("o"), "s_suppkey").alias("org"), (13 + s % 30).cast("int").alias("k"), (s % 4 - 1).cast("int").alias("e"), (300 - s % 5 * 100).cast("int").alias("window"),
        (50 + s % 3 * 150).cast("int").alias("pitch"), (s % 130 - 10).cast("int").alias("percentile"), (s % 3).cast("int").alias("flag"))
    known = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("o"), "c_custkey").alias("org"))
    return params.parameter_problems(p, known)


# -- matches

def _m(spark, d):
    return pairs(spark, d).select(F.lit("p").alias("org1"), F.col("part").alias("id1"), F.concat(F.lit("s"), F.col("supp") % 3).alias("org2"), F.col("supp").alias("id2"), "score")


@register("R83_clean_pairs", f"""
WITH p AS ({SQL_PAIRS}) SELECT part AS id1, 's' || supp % 3 AS org2, supp AS id2 FROM p WHERE NOT (part % 3 = 0 OR (part + supp % 3) % 4 = 0)""")
def clean(spark, d):
    m = _m(spark, d)
    flags = m.select("org1", "id1", "org2").distinct().withColumns({
        "out_of_tolerance": F.col("id1") % 3 == 0, "ambiguous": (F.col("id1") + F.substring("org2", 2, 9).cast("int")) % 4 == 0})
    return mt.clean_pairs(m, flags).select("id1", "org2", "id2")


@register("R83b_repeated_rows_dropped", f"""
WITH p AS ({SQL_PAIRS}), m AS (SELECT part, supp, score, 'regular' AS kind FROM p WHERE part % 2 = 0 UNION ALL SELECT part, supp, score + CASE WHEN supp % 3 = 0 THEN 1 ELSE 0 END, 'not_considered' FROM p WHERE supp % 2 = 0)
SELECT part AS id1, supp AS id2, score, kind FROM m WHERE kind = 'regular' OR part % 2 <> 0 OR supp % 3 = 0""")
def repeated(spark, d):
    p = pairs(spark, d).select(F.lit("p").alias("org1"), F.col("part").alias("id1"), F.lit("s").alias("org2"), F.col("supp").alias("id2"), "score")
    idle = p.where("id2 % 2 = 0").withColumn("score", F.col("score") + F.when(F.col("id2") % 3 == 0, 1).otherwise(0)).withColumn("kind", F.lit("not_considered"))
    return mt.drop_repeated(p.where("id1 % 2 = 0").withColumn("kind", F.lit("regular")).unionByName(idle)).select("id1", "id2", "score", "kind")


@register("R83c_without_dups", f"""
WITH p AS ({SQL_PAIRS}) SELECT part AS id1, supp AS id2 FROM p WHERE part % 5 <> 0 AND part % 7 <> 1 AND supp % 6 <> 2""")
def no_dups(spark, d):
    m = pairs(spark, d).select(F.lit("p").alias("org1"), F.col("part").alias("id1"), F.lit("s").alias("org2"), F.col("supp").alias("id2"), F.when(F.col("part") % 5 == 0, "dup").otherwise("regular").alias("kind"))
    ids = m.where("id1 % 7 = 1").select(F.col("org1").alias("org"), F.col("id1").alias("id")).union(m.where("id2 % 6 = 2").select("org2", "id2")).distinct()
    return mt.without_dups(m, ids).select("id1", "id2")


@register("R83d_opposite_sides", f"""
WITH p AS ({SQL_PAIRS}) SELECT 'p' || part AS gene1, 's' || supp AS gene2 FROM p WHERE part % 20 = supp % 20 AND part % 2 <> (supp // 20) % 2""")
def opposite(spark, d):
    p = pairs(spark, d)
    edges = p.select(F.concat(F.lit("p"), "part").alias("gene1"), F.concat(F.lit("s"), "supp").alias("gene2"))
    members = p.select(F.concat(F.lit("p"), "part").alias("gene"), (F.col("part") % 20).alias("chain"), (F.col("part") % 2).alias("side")).union(
        p.select(F.concat(F.lit("s"), "supp"), F.col("supp") % 20, F.floor(F.col("supp") / 20) % 2)).distinct()
    return mt.opposite_sides(edges, members)


@register("R83e_own_hit_missing", f"""
WITH e AS ({SQL_EVENTS}) SELECT event_id AS anchor_id, 2.0 * ("end" - start) AS score FROM e WHERE event_id % 4 <> 0""")
def own_missing(spark, d):
    c = intervals(spark, d).select(F.col("event_type").alias("org"), F.col("event_id").alias("anchor_id"), "start", "end")
    return delta.self_score_missing(c, c.where("anchor_id % 4 = 0")).select("anchor_id", "score")


# -- clusters


@register("R84_clusters_by_shared_elements", """
WITH RECURSIVE m AS (SELECT DISTINCT o_custkey AS g, o_orderkey % 400 AS e FROM orders WHERE o_orderstatus = 'P'),
l AS (SELECT DISTINCT a.g AS x, b.g AS y FROM m a JOIN m b ON a.e = b.e),
r AS (SELECT DISTINCT g AS x, g AS y FROM m UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT x AS "group", min(y) AS cluster FROM r GROUP BY x""")
def by_shared(spark, d):
    m = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("group"), (F.col("o_orderkey") % 400).alias("element"))
    return graph.clusters_by_shared(m)


@register("R84b_chain_labels", """
WITH g AS (SELECT l_orderkey * 10 + l_linenumber AS gene, l_orderkey AS chain, min(l_partkey % 50) FILTER (l_partkey % 3 = 0) OVER (PARTITION BY l_orderkey * 10 + l_linenumber) AS c FROM lineitem)
SELECT gene, chain, coalesce(c::VARCHAR, 'own:' || gene) AS label FROM g""")
def labels(spark, d):
    li = table(spark, d, "lineitem").withColumn("gene", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    comps = li.where("l_partkey % 3 = 0").groupBy(F.col("gene").alias("node")).agg(F.min(F.col("l_partkey") % 50).alias("component"))
    return jn.chain_labels(li.select("gene", F.col("l_orderkey").alias("chain")), comps)


@register("R84c_contigs_along_a_reference", """
WITH h AS (SELECT 'k' || l_suppkey AS contig, 'c' || l_partkey % 4 AS chrom, l_orderkey AS pos FROM lineitem),
n AS (SELECT contig, chrom, count(*) AS n FROM h GROUP BY ALL),
a AS (SELECT contig, chrom, n FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY n DESC, chrom) AS r FROM n) WHERE r = 1),
m AS (SELECT contig, chrom, n, quantile_disc(pos, 0.5) AS mid FROM a JOIN h USING (contig, chrom) GROUP BY ALL)
SELECT chrom, contig, n::DOUBLE AS mass, mid, row_number() OVER (PARTITION BY chrom ORDER BY mid, contig) AS position FROM m""")
def along(spark, d):
    h = table(spark, d, "lineitem").select(F.concat(F.lit("k"), "l_suppkey").alias("contig"), F.concat(F.lit("c"), F.col("l_partkey") % 4).alias("chrom"), F.col("l_orderkey").alias("pos"))
    return graph.order_along_reference(h).withColumnRenamed("at", "mid")


# -- checks


@register("R85_confirmation_counts", """
WITH h AS (SELECT l_linenumber % 2 = 0 AS f, l_partkey % 3 = 0 AS b, l_quantity AS o FROM lineitem)
SELECT CASE WHEN f AND b THEN 'both' WHEN f OR b THEN 'one' ELSE 'neither' END AS confirmed, count(*) AS n, min(o) AS least, median(o) AS median, max(o) AS most FROM h GROUP BY 1""")
def confirmed(spark, d):
    return va.confirmation_counts(table(spark, d, "lineitem").select(
        (F.col("l_linenumber") % 2 == 0).alias("forward"), (F.col("l_partkey") % 3 == 0).alias("backward"), F.col("l_quantity").alias("overlap")))


@register("R85b_considered_twice", f"""
WITH p AS ({SQL_PAIRS}) SELECT 'considered_twice' AS "check", 'error' AS severity, 'p:' || part || ':s:' || supp AS detail FROM p WHERE part % 6 = 0 AND supp % 2 = 0""")
def twice(spark, d):
    p = pairs(spark, d).select(F.lit("p").alias("org1"), F.col("part").alias("id1"), F.lit("s").alias("org2"), F.col("supp").alias("id2"))
    m = p.where("id1 % 2 = 0 and id2 % 2 = 0").withColumn("kind", F.lit("regular")).union(p.where("id1 % 3 = 0").withColumn("kind", F.lit("not_considered")))
    return va.considered_twice(m)


@register("R85c_asymmetric_flags", f"""
WITH p AS ({SQL_PAIRS}) SELECT 'asymmetric_bad' AS "check", 'warning' AS severity, 'p:' || part || ':s:' || supp AS detail FROM p WHERE (part % 3 = 0) <> (supp % 4 = 0)
UNION ALL SELECT 'asymmetric_bad', 'warning', 's:' || supp || ':p:' || part FROM p WHERE (part % 3 = 0) <> (supp % 4 = 0)""")
def asymmetric(spark, d):
    p = pairs(spark, d)
    m = p.select(F.lit("p").alias("org1"), F.col("part").alias("id1"), F.lit("s").alias("org2"), F.col("supp").alias("id2"))
    m = m.union(m.select("org2", "id2", "org1", "id1"))
    bad = F.when(F.col("org1") == "p", F.col("id1") % 3 == 0).otherwise(F.col("id1") % 4 == 0)
    return va.asymmetric_flags(m.select("org1", "id1", "org2").distinct().withColumn("bad", bad), m, ["bad"])


@register("R85d_not_a_candidate", """
SELECT DISTINCT 'not_a_candidate' AS "check", 'error' AS severity, l_partkey::VARCHAR AS detail FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def outside(spark, d):
    return va.subset(table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")), table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("id")), ["id"])


@register("R85e_format_problems", """
SELECT 'schema' AS "check", 'error' AS severity, 'missing orientation' AS detail UNION ALL SELECT 'schema', 'error', 'unexpected extra' UNION ALL SELECT 'schema', 'error', 'score is double, not bigint'
UNION ALL SELECT 'start after end', 'error', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 10 > o_custkey % 10
UNION ALL SELECT 'score not positive', 'error', o_orderkey::VARCHAR FROM orders WHERE o_totalprice <= 50000""")
def formats(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 10).alias("start"), (F.col("o_custkey") % 10).alias("end"), F.col("o_totalprice").alias("score"), F.lit(1).alias("extra"))
    expected = {"id": dict(o.dtypes)["id"], "start": dict(o.dtypes)["start"], "end": dict(o.dtypes)["end"], "score": "bigint", "orientation": "string"}
    return va.format_problems(o, expected, [("start after end", F.col("start") <= F.col("end")), ("score not positive", F.col("score") > 50000)], ["id"])


@register("R85f_repeated_ids", """
SELECT 'repeated_id' AS "check", 'error' AS severity, (l_suppkey % 3) || ':' || l_partkey || ':' || count(*) AS detail FROM lineitem GROUP BY l_suppkey % 3, l_partkey HAVING count(*) > 1""")
def ids(spark, d):
    return va.repeated_ids(table(spark, d, "lineitem").select((F.col("l_suppkey") % 3).alias("species"), F.col("l_partkey").alias("gene_id")), ["species", "gene_id"])


@register("R85g_in_several_chains", """
SELECT 'in_several_groups' AS "check", 'info' AS severity, l_partkey || ':' || count(DISTINCT l_orderkey) AS detail FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) > 1""")
def several(spark, d):
    return va.in_several(table(spark, d, "lineitem").select(F.col("l_partkey").alias("element"), F.col("l_orderkey").alias("chain")), ["element"], "chain")


_SUCC = f"""p AS ({SQL_PAIRS}), m AS (SELECT part AS id1, supp AS id2, CASE WHEN supp % 4 = 0 THEN 'dup' WHEN supp % 4 = 1 THEN 'not_considered' ELSE 'regular' END AS kind, part % 2 = 0 AS syntenic, score FROM p),
w AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY CASE WHEN kind = 'regular' THEN 0 WHEN kind = 'dup' AND syntenic THEN 1 ELSE 2 END, id2) AS r, kind = 'regular' OR (kind = 'dup' AND syntenic) AS ok FROM m)"""


@register("R86_succinct_drop_reasons", f"""
WITH {_SUCC} SELECT CASE WHEN kind = 'not_considered' THEN 'not considered' WHEN kind = 'dup' AND NOT syntenic THEN 'duplication without synteny' WHEN r = 1 THEN 'kept' ELSE 'another match of the pair was chosen' END AS reason, count(*) AS n FROM w GROUP BY 1""")
def reasons(spark, d):
    p = pairs(spark, d)
    kind = F.when(F.col("supp") % 4 == 0, "dup").when(F.col("supp") % 4 == 1, "not_considered").otherwise("regular")
    m = p.select(F.lit("p").alias("org1"), F.col("part").alias("id1"), F.lit("s").alias("org2"), F.col("supp").alias("id2"), kind.alias("kind"), (F.col("part") % 2 == 0).alias("syntenic"), "score")
    return va.drop_reasons(m, mt.succinct(m))


@register("R86b_two_derivations", f"""
WITH p AS ({SQL_PAIRS}) SELECT part, supp, 'expected' AS side FROM p WHERE part % 3 = 0 AND supp % 2 = 0 UNION ALL SELECT part, supp, 'actual' FROM p WHERE part % 3 <> 0 AND supp % 2 <> 0""")
def derivations(spark, d):
    p = pairs(spark, d).select("part", "supp")
    return va.differences(p.where("part % 3 = 0 or supp % 2 = 0").where("not (part % 3 <> 0 and supp % 2 <> 0)"), p.where("part % 3 <> 0 or supp % 2 <> 0"))


@register("R86c_file_states", """
SELECT 'f' || o_orderkey AS path, CASE o_orderkey % 4 WHEN 0 THEN 'fasta' WHEN 1 THEN 'uint16' WHEN 2 THEN 'text' ELSE 'pickle' END AS kind,
  CASE WHEN o_custkey % 5 = 0 THEN 'MISSING' WHEN o_orderkey % 4 = 3 THEN 'UNKNOWN'
       WHEN (o_orderkey % 4 = 0 AND o_custkey % 3 = 0) OR (o_orderkey % 4 = 1 AND o_custkey % 6 % 2 = 0 AND o_custkey % 6 > 0) OR (o_orderkey % 4 = 2 AND o_custkey % 6 > 0) THEN 'PASS' ELSE 'FAIL' END AS state FROM orders""")
def states(spark, d):
    o = table(spark, d, "orders").withColumn("path", F.concat(F.lit("f"), "o_orderkey"))
    kind = F.element_at(F.array(*map(F.lit, ("fasta", "uint16", "text", "pickle"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    files = o.where("o_custkey % 5 <> 0").select("path", (F.col("o_custkey") % 6).alias("length"), F.when(F.col("o_custkey") % 3 == 0, ">x").otherwise("x").cast("binary").alias("head"))
    return va.file_states(files, o.select("path", kind.alias("kind")))


@register("R86d_oriented_hits", """
SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS start, greatest(l_partkey, l_suppkey) AS "end", CASE WHEN l_partkey > l_suppkey THEN '-' ELSE '+' END AS strand FROM lineitem""")
def oriented(spark, d):
    s, e, strand = jn.oriented(F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("start"), e.alias("end"), strand.alias("strand"))


# -- failed tasks

_CODE = "CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN -99 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 255 WHEN 5 THEN -9 ELSE 1 END"


def _tasks(spark, d):
    k = F.col("o_orderkey") % 7
    code = F.when(k == 0, 0).when(k == 1, -99).when(k == 2, 3).when(k == 3, 4).when(k == 4, 255).when(k == 5, -9).otherwise(1)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 230).alias("n"), (F.col("o_orderstatus") == "F").alias("self_alignment"),
        F.when(F.col("o_orderkey") % 2 == 0, "alignment").otherwise("chaining").alias("tool"), code.alias("code"))


@register("R87_task_outcomes", f"""
WITH t AS (SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'alignment' ELSE 'chaining' END AS tool, {_CODE} AS code FROM orders)
SELECT task_id, CASE WHEN code = 0 THEN 'ok' WHEN code = -99 THEN 'timeout' WHEN (tool = 'alignment' AND code IN (3, 4)) OR (tool = 'chaining' AND code = 255) THEN 'memory' WHEN code < 0 THEN 'killed' ELSE 'fatal' END AS outcome FROM t""")
def outcomes(spark, d):
    return _tasks(spark, d).select("task_id", delta.outcome(F.col("tool"), F.col("code")).alias("outcome"))


@register("R87b_retry_chunks", f"""
WITH t AS (SELECT o_orderkey AS task_id, o_custkey % 230 AS n, o_orderstatus = 'F' AS own, o_orderkey % 2 = 0 AS alignment, {_CODE} AS code FROM orders),
r AS (SELECT task_id, n, CASE WHEN own THEN greatest(n // 100, 1) ELSE 1 END AS size FROM t WHERE n > 0 AND code <> 0 AND (code < 0 OR (alignment AND code IN (3, 4)) OR (NOT alignment AND code = 255))),
c AS (SELECT *, unnest(range((n - 1) // size + 1)) AS chunk FROM r)
SELECT task_id, chunk, chunk * size AS first, least(chunk * size + size, n) - 1 AS last FROM c""")
def chunks(spark, d):
    return delta.retry_chunks(_tasks(spark, d))


@register("R87c_parents_replaced_by_windows", """
WITH w AS (SELECT l_orderkey AS k, l_orderkey * 1000 + l_linenumber * 100 AS s, l_returnflag = 'A' AS ok FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)),
p AS (SELECT o_orderkey AS k, o_orderkey * 1000 AS s, o_orderstatus = 'F' AS ok FROM orders),
g AS (SELECT DISTINCT k, s FROM w WHERE ok)
SELECT 'o' AS org, s AS start, s + 999 AS "end", 'kept' AS status FROM p WHERE ok
UNION ALL SELECT 'o', g.s, g.s + 99, 'window' FROM p JOIN g USING (k) WHERE NOT p.ok
UNION ALL SELECT 'o', s, s + 999, 'failed' FROM p WHERE NOT ok AND k NOT IN (SELECT k FROM g)""")
def replaced(spark, d):
    o = table(spark, d, "orders")
    parents = o.select(F.lit("o").alias("org"), (F.col("o_orderkey") * 1000).alias("start"), (F.col("o_orderkey") * 1000 + 999).alias("end"), (F.col("o_orderstatus") == "F").alias("ok"))
    at = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100
    windows = table(spark, d, "lineitem").select(
        F.lit("o").alias("org"), (F.col("l_orderkey") * 1000).alias("parent_start"), at.alias("start"), (at + 99).alias("end"), (F.col("l_returnflag") == "A").alias("ok")).distinct()
    return delta.replace_by_windows(parents, windows)
