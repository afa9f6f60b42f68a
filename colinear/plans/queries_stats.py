"""Statistics, validation, delta and naming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as nm, sequences as sq
from ..operators import delta as dl, stats as st, validate as va
from ..storage import stored
from .analogues import SQL_PAIRS, pairs, table
from .catalogue import register


@register("R27_pair_statistics_with_total", """
SELECT CASE WHEN grouping(l_suppkey) = 0 THEN l_suppkey END AS l_suppkey, grouping(l_suppkey) = 1 AS is_total, count(*) AS n, round(avg(l_quantity), 6) AS mean,
       round(median(l_quantity), 6) AS median, round(stddev_samp(l_quantity), 6) AS stdev, count(*) FILTER (l_linestatus = 'F') AS forward
FROM lineitem GROUP BY ROLLUP (l_suppkey)""")
def pair_stats(spark, d):
    out = st.stats_with_total(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", [F.count_if(F.col("l_linestatus") == "F").alias("forward")])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "stdev")})


@register("R27b_coverage_percent", """
SELECT s_nationkey AS org, sum(l_quantity) AS aligned, n * 1000 AS size, round(100.0 * sum(l_quantity) / (n * 1000), 6) AS percent
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) ON k = s_nationkey GROUP BY s_nationkey, n""")
def coverage(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("org"))
    sizes = s.groupBy("org").agg((F.count("*") * 1000).alias("size"))
    hits = table(spark, d, "lineitem").join(s, "l_suppkey").select("org", F.col("l_quantity").alias("length"))
    return st.coverage_percent(hits, sizes, ["org"], "org").withColumn("percent", F.round("percent", 6))


@register("R30_count_matrix", """
SELECT c_nationkey, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")
def matrix(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return st.count_matrix(table(spark, d, "orders").join(c, "o_custkey"), "c_nationkey", "o_orderstatus", ["F", "O", "P"])


@register("R31_single_copy_ranked_groups", """
WITH g AS (SELECT l_orderkey AS grp, count(*) AS size, min(l_partkey) AS first, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY 1),
s AS (SELECT grp, max(n) = 1 AS single_copy FROM (SELECT l_orderkey AS grp, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY grp)
SELECT grp, size, single_copy, upper_median, 'SOG' || lpad((row_number() OVER (ORDER BY size DESC, first, grp) - 1)::VARCHAR, 7, '0') AS group_id FROM g JOIN s USING (grp)""")
def groups(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), "l_partkey", "l_returnflag", "l_quantity")
    med = m.groupBy("grp").agg(st.upper_median(F.collect_list("l_quantity")).alias("upper_median"))
    return st.size_ranked_ids(m, "grp", "l_partkey").join(
        st.single_copy(m, "grp", "l_returnflag").select("grp", "single_copy"), "grp").join(med, "grp")


@register("R32_stage_waterfall", """
WITH e AS (SELECT l_quantity > 10 AS a, l_discount > 0.02 AS b, l_returnflag <> 'R' AS c, l_linestatus = 'F' AS best FROM lineitem),
n AS (SELECT count(*) AS a0, count(*) FILTER (best) AS c0, count(*) FILTER (a) AS a1, count(*) FILTER (a AND best) AS c1, count(*) FILTER (a AND b) AS a2,
  count(*) FILTER (a AND b AND best) AS c2, count(*) FILTER (a AND b AND c) AS a3, count(*) FILTER (a AND b AND c AND best) AS c3 FROM e)
SELECT 0 AS stage_no, 'input' AS stage, a0 AS n_all, c0 AS n_chosen, 0 AS removed_all, 0 AS removed_chosen FROM n UNION ALL SELECT 1, 'a', a1, c1, a0 - a1, c0 - c1 FROM n
UNION ALL SELECT 2, 'b', a2, c2, a1 - a2, c1 - c2 FROM n UNION ALL SELECT 3, 'c', a3, c3, a2 - a3, c2 - c3 FROM n""")
def waterfall(spark, d):
    e = table(spark, d, "lineitem").select(
        (F.col("l_quantity") > 10).alias("a"), (F.col("l_discount") > 0.02).alias("b"), (F.col("l_returnflag") != "R").alias("c"), (F.col("l_linestatus") == "F").alias("best"))
    return st.waterfall(e, ["a", "b", "c"], "best")


@register("R32b_endpoint_counts", """
SELECT species, count(*) AS n FROM (SELECT 'p' || l_partkey % 5 AS species FROM lineitem UNION ALL SELECT 's' || l_suppkey % 5 FROM lineitem) GROUP BY species""")
def endpoints(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey") % 5).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("b"))
    return st.endpoint_counts(e, "a", "b")


@register("R33_connectivity_histogram", """
SELECT partners, count(*) AS nodes FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS partners FROM lineitem GROUP BY 1) GROUP BY 1""")
def connectivity(spark, d):
    return st.connectivity(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@register("R33b_top_partners", """
SELECT l_suppkey, part, n, rank::INT AS rank FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY n DESC) AS rank FROM
  (SELECT l_suppkey, l_partkey AS part, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE rank <= 3""")
def top(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("part"))
    return st.top_partners(li, "l_suppkey", "part")


@register("R33c_best_item_by_total", """
SELECT l_orderkey, l_returnflag, total FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY total DESC, l_returnflag) AS r FROM
  (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS total FROM lineitem GROUP BY ALL)) WHERE r = 1""")
def best_item(spark, d):
    return st.best_by_total(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity")


@register("R33d_mostly_custom", """
SELECT l_orderkey, count(*) FILTER (l_discount > 0.05) / count(*) AS share FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_discount > 0.05) / count(*) >= 0.5""")
def mostly(spark, d):
    return st.mostly(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_discount") > 0.05)


@register("R31b_orthogroup_report", f"""
WITH p AS (SELECT part AS grp, supp AS gene_id, supp % 4 AS species FROM ({SQL_PAIRS}) WHERE score > 40 AND supp % 9 <> 0),
g AS (SELECT grp, string_agg(gene_id::VARCHAR, ',' ORDER BY gene_id) AS genes, count(*) AS size, min(gene_id) AS first FROM p GROUP BY grp),
q AS (SELECT grp, string_agg(species::VARCHAR, ',' ORDER BY species) AS species, count(*) AS ns FROM (SELECT DISTINCT grp, species FROM p) GROUP BY grp),
s AS (SELECT grp, max(n) = 1 AS single_copy FROM (SELECT grp, species, count(*) AS n FROM p GROUP BY ALL) GROUP BY grp),
r AS (SELECT *, row_number() OVER (ORDER BY size DESC, first, grp) - 1 AS k FROM g)
SELECT 'SOG' || lpad(k::VARCHAR, 7, '0') AS group_id, genes, species, size, single_copy FROM r JOIN q USING (grp) JOIN s USING (grp) WHERE ns >= 2
UNION ALL SELECT 'unassigned', s_suppkey::VARCHAR, (s_suppkey % 4)::VARCHAR, 1, false FROM supplier
WHERE s_suppkey NOT IN (SELECT gene_id FROM p JOIN q USING (grp) WHERE ns >= 2)""")
def report(spark, d):
    m = pairs(spark, d).where("score > 40 and supp % 9 <> 0").select(F.col("part").alias("group"), F.col("supp").alias("gene_id"), (F.col("supp") % 4).alias("species"))
    every = table(spark, d, "supplier").select(F.col("s_suppkey").alias("gene_id"), (F.col("s_suppkey") % 4).alias("species"))
    return st.orthogroup_report(m, every)


@register("R50_not_selected_report", """
WITH s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45),
r AS (SELECT CASE WHEN o_orderkey IN (SELECT l_orderkey FROM s) THEN 'selected' WHEN o_totalprice < 100000 THEN 'cheap' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'other' END AS reason FROM orders)
SELECT coalesce(reason, 'total') AS reason, count(*) AS n FROM r GROUP BY ROLLUP (reason)""")
def not_selected(spark, d):
    chosen = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return st.not_selected(table(spark, d, "orders"), chosen, [("cheap", F.col("o_totalprice") < 100000), ("pending", F.col("o_orderstatus") == "P")], "o_orderkey")


@register("R50b_accounting", """
SELECT count(*) FILTER (o_orderstatus = 'F') AS grouped, count(*) FILTER (o_orderstatus <> 'F') AS single, count(*) AS total, count(*) AS accounted, true AS ok FROM orders""")
def account(spark, d):
    o = table(spark, d, "orders")
    return va.accounting(grouped=o.where("o_orderstatus = 'F'"), single=o.where("o_orderstatus <> 'F'"), total=o)


_CAND = """c AS (SELECT o_custkey % 40 AS org, o_orderkey AS anchor_id, o_custkey % 3 AS seqid, o_orderkey * 31 % 90000 AS s, o_orderkey * 31 % 90000 + o_orderkey % 301 - 3 AS z FROM orders),
ch AS (SELECT c_custkey AS org, 0 AS seqid, 80000 AS length FROM customer WHERE c_custkey < 41 UNION ALL SELECT c_custkey, 1, 88000 FROM customer WHERE c_custkey < 41)"""


@register("R25c_candidate_checks", f"""
WITH {_CAND}
SELECT 'end_before_start' AS "check", 'error' AS severity, org || ':' || anchor_id AS detail FROM c WHERE z < s
UNION ALL SELECT 'unknown_sequence', 'error', c.org || ':' || anchor_id FROM c LEFT JOIN ch ON c.org = ch.org AND c.seqid = ch.seqid WHERE length IS NULL
UNION ALL SELECT 'outside_genome', 'error', c.org || ':' || anchor_id FROM c JOIN ch ON c.org = ch.org AND c.seqid = ch.seqid WHERE s < 0 OR z > length
UNION ALL SELECT 'overlap', 'error', org || ':' || anchor_id FROM (SELECT *, lead(s) OVER (PARTITION BY org, seqid ORDER BY s, z) AS nxt FROM c) WHERE nxt <= z
UNION ALL SELECT DISTINCT 'no_candidates', 'warning', org::VARCHAR FROM ch WHERE org NOT IN (SELECT org FROM c)""")
def candidates(spark, d):
    o = table(spark, d, "orders")
    s = F.col("o_orderkey") * 31 % 90000
    c = o.select((F.col("o_custkey") % 40).alias("org"), F.col("o_orderkey").alias("anchor_id"), (F.col("o_custkey") % 3).alias("seqid"), s.alias("start"), (s + F.col("o_orderkey") % 301 - 3).alias("end"))
    few = table(spark, d, "customer").where("c_custkey < 41").select(F.col("c_custkey").alias("org"))
    chrom = few.select("org", F.lit(0).cast("long").alias("seqid"), F.lit(80000).alias("length")).union(few.select("org", F.lit(1).cast("long"), F.lit(88000)))
    return va.candidate_checks(c, chrom)


_M = f"""p AS ({SQL_PAIRS}),
m AS (SELECT 'p' AS org1, part AS id1, 's' AS org2, supp AS id2, CASE WHEN part % 5 = 0 THEN 'dup' ELSE 'regular' END AS kind, part % 10 = 0 AS syntenic, score, 1 AS own_start, 2 AS other_start FROM p WHERE (part + supp) % 7 <> 0
  UNION ALL SELECT 's', supp, 'p', part, CASE WHEN part % 5 = 0 THEN 'dup' ELSE 'regular' END, part % 10 = 0, score + CASE WHEN supp % 11 = 0 THEN 3 ELSE 0 END, 2, 1 FROM p WHERE (part + supp) % 13 <> 0)"""


def _m(spark, d):
    p = pairs(spark, d).withColumns({"kind": F.when(F.col("part") % 5 == 0, "dup").otherwise("regular"), "syntenic": F.col("part") % 10 == 0})
    a = p.where("(part + supp) % 7 <> 0").select(
        F.lit("p").alias("org1"), F.col("part").alias("id1"), F.lit("s").alias("org2"), F.col("supp").alias("id2"), "kind", "syntenic", "score", F.lit(1).alias("own_start"), F.lit(2).alias("other_start"))
    b = p.where("(part + supp) % 13 <> 0").select(
        F.lit("s"), "supp", F.lit("p"), "part", "kind", "syntenic", F.col("score") + F.when(F.col("supp") % 11 == 0, 3).otherwise(0), F.lit(2), F.lit(1))
    return a.union(b)


@register("R26c_unreciprocated_matches", f"""
WITH p AS (SELECT part, supp, (part + supp) % 7 <> 0 AS there, (part + supp) % 13 <> 0 AS back, CASE WHEN part % 5 = 0 AND part % 10 <> 0 THEN 'warning' ELSE 'error' END AS severity FROM ({SQL_PAIRS}))
SELECT 'unreciprocated' AS "check", severity, 'p:' || part || ':s:' || supp AS detail FROM p WHERE there AND NOT back
UNION ALL SELECT 'unreciprocated', severity, 's:' || supp || ':p:' || part FROM p WHERE back AND NOT there""")
def unreciprocated(spark, d):
    return va.unreciprocated(_m(spark, d))


@register("R26d_unequal_directions", f"""
WITH p AS (SELECT part, supp, score, score + CASE WHEN supp % 11 = 0 THEN 3 ELSE 0 END AS back FROM ({SQL_PAIRS}) WHERE (part + supp) % 7 <> 0 AND (part + supp) % 13 <> 0)
SELECT 'unequal_directions' AS "check", 'error' AS severity, 'p:' || part || ':s:' || supp AS detail FROM p WHERE round_even(score, 0) <> round_even(back, 0)""")
def unequal(spark, d):
    return va.unequal_scores(_m(spark, d))


@register("R24_tombstones", """
WITH m AS (SELECT DISTINCT 'o' AS org1, l_orderkey AS id1, 'p' AS org2, l_partkey AS id2 FROM lineitem UNION SELECT DISTINCT 'p', l_partkey, 'o', l_orderkey FROM lineitem),
d AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P')
SELECT org1, id1, org2, id2 FROM m WHERE NOT (org1 = 'o' AND id1 IN (SELECT id FROM d)) AND NOT (org2 = 'o' AND id2 IN (SELECT id FROM d))""")
def tombstones(spark, d):
    li = table(spark, d, "lineitem").select(F.lit("o").alias("org1"), F.col("l_orderkey").alias("id1"), F.lit("p").alias("org2"), F.col("l_partkey").alias("id2")).distinct()
    m = stored(li.union(li.select("org2", "id2", "org1", "id1")), "matches")
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.lit("o").alias("org"), F.col("o_orderkey").alias("id"))
    return dl.apply_tombstones(m, dl.tombstones(gone, m), gone)


@register("R24b_to_reevaluate", """
WITH d AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'),
t AS (SELECT DISTINCT 'p' AS org1, l_partkey AS id1, 'o' AS org2 FROM lineitem WHERE l_orderkey IN (SELECT id FROM d))
SELECT org1, id1, org2 FROM t WHERE id1 NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)""")
def reevaluate(spark, d):
    li = table(spark, d, "lineitem")
    m = li.select(F.lit("o").alias("org1"), F.col("l_orderkey").alias("id1"), F.lit("p").alias("org2"), F.col("l_partkey").alias("id2")).distinct()
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.lit("o").alias("org"), F.col("o_orderkey").alias("id"))
    fresh = li.where("l_quantity > 40").select(F.lit("p").alias("org1"), F.col("l_partkey").alias("id1"), F.lit("o").alias("org2"))
    return dl.to_reevaluate(dl.tombstones(gone, m), fresh)


@register("R24c_snapshot_diff", """
WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 5 <> 0),
n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 3 <> 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'delete' ELSE 'update' END AS change, n.v
FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.v <> n.v""")
def diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.where("k % 3 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return dl.snapshot_diff(o.where("k % 5 <> 0"), new, ["k"])


@register("R42_names_round_trip", r"""
WITH u AS (SELECT page_id, '1org' || 'chr' || page_id % 7 || 'ele' || page_id * 10 || 'to' || (page_id * 10 + 300) AS name, url FROM pages)
SELECT page_id, name, regexp_extract(name, '^(\d+org)(chr\d+)ele(\d+)to(\d+)$', 2) AS chrom_id, regexp_extract(name, '^(\d+org)(chr\d+)ele(\d+)to(\d+)$', 4)::BIGINT AS "end",
       regexp_extract(url, '^(https?)://([^/]+)', 2) AS host, 'hit-' || row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) || '_' || page_id % 5 || '_q' AS hit_id FROM u""")
def naming(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", (F.col("page_id") % 5).cast("string").alias("org"), F.lit("q").alias("query"))
    p = p.withColumn("name", nm.format_element(F.concat(F.lit("1orgchr"), F.col("page_id") % 7), F.col("page_id") * 10, F.col("page_id") * 10 + 300))
    e = nm.parse_element(F.col("name"))
    return nm.mint_hit_ids(p, "org", "query", "page_id").select(
        "page_id", "name", e["chrom_id"].alias("chrom_id"), e["end"].alias("end"), F.regexp_extract("url", "^(https?)://([^/]+)", 2).alias("host"), "hit_id")


@register("R42b_attribute_parsing", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def attributes(spark, d):
    a = F.str_to_map(F.regexp_replace("props", r'[{}" ]', ""), F.lit(","), F.lit(":"))
    return table(spark, d, "events").select("event_id", a["k"].cast("long").alias("k"))


_DNA = "translate(upper(left(regexp_replace(text, '[^A-Za-z .,]', '', 'g'), 300)), 'BDEFHIJKLMNOPQRSUVWXYZ .,', 'ACGTACGTACGTACGTACGTACGTA')"


_SPARK_DNA = _DNA.replace(", '', 'g')", ", '')")


@register("R43_reverse_complement", f"SELECT item_id, reverse(translate({_DNA}, 'ACGT', 'TGCA')) AS rc FROM benchmark")
def rc(spark, d):
    return table(spark, d, "benchmark").select("item_id", sq.reverse_complement(F.expr(_SPARK_DNA)).alias("rc"))


@register("R43b_translate", f"""
WITH s AS (SELECT item_id, {_DNA} AS s FROM benchmark),
c AS (SELECT item_id, i, substr(s, i * 3 + 1, 3) AS codon FROM s, unnest(range(0, len(s) // 3)) AS u(i)),
t AS (SELECT item_id, i, CASE WHEN regexp_full_match(codon, '[TCAG]{{3}}') THEN
  substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG',
    ((instr('TCAG', substr(codon, 1, 1)) - 1) * 16 + (instr('TCAG', substr(codon, 2, 1)) - 1) * 4 + instr('TCAG', substr(codon, 3, 1)))::INT, 1) ELSE 'X' END AS aa FROM c)
SELECT item_id, string_agg(aa, '' ORDER BY i) AS protein FROM t GROUP BY item_id""")
def protein(spark, d):
    dna = F.expr(_SPARK_DNA)
    return table(spark, d, "benchmark").select("item_id", sq.translate(dna).alias("protein"))
