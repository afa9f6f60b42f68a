"""Match lifecycle queries: parts and suppliers as two organisms' anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as mt
from .analogues import SQL_EVENTS, SQL_PAIRS, intervals, pairs, table
from .catalogue import register

_TOP = f"""p AS ({SQL_PAIRS}),
bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, supp) AS r FROM p) WHERE r = 1),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY supp ORDER BY score DESC, part) AS r FROM p) WHERE r = 1)"""


@register("R01_mutual_best_by_nation", f"""
WITH {_TOP}, m AS (SELECT bp.part, bp.supp, bp.score FROM bp JOIN bs ON bp.part = bs.part AND bp.supp = bs.supp)
SELECT n_name AS nation, count(*) AS n_pairs, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score, max(score) AS best_score
FROM m JOIN supplier ON supp = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def mutual_best(spark, d):
    p = pairs(spark, d)
    bp = mt.best_first(p, ["part"], F.desc("score"), F.col("supp"))
    bs = mt.best_first(p, ["supp"], F.desc("score"), F.col("part")).select("part", "supp")
    return (
        bp.join(bs, ["part", "supp"], "left_semi")
        .join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("supp"), "s_nationkey"), "supp")
        .join(table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
        .groupBy(F.col("n_name").alias("nation")).agg(
            F.count("*").alias("n_pairs"), F.round(F.avg("score"), 6).alias("mean_score"),
            F.round(F.median("score"), 6).alias("median_score"), F.max("score").alias("best_score"))
    )


@register("R01b_reciprocal_best_hits", f"""
WITH {_TOP}
SELECT 'p' || bp.part AS gene1, 's' || bp.supp AS gene2, bp.score FROM bp JOIN bs ON bp.part = bs.part AND bp.supp = bs.supp""")
def rbh(spark, d):
    p = pairs(spark, d)
    edge = lambda a, x, b, y: p.select(
        F.concat(F.lit(x), a).alias("gene1"), F.lit(x).alias("sp1"), F.concat(F.lit(y), b).alias("gene2"), F.lit(y).alias("sp2"),
        "score", F.col(b).alias("tie"))
    edges = edge("part", "p", "supp", "s").union(edge("supp", "s", "part", "p"))
    top = mt.best_first(edges, ["gene1", "sp2"], F.desc("score"), F.col("tie"))
    return mt.reciprocal_best(top.drop("tie")).select("gene1", "gene2", "score")


@register("R16_accept_above_threshold", """
SELECT l_orderkey, l_linenumber, l_extendedprice AS score FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_size = 1 OR l_extendedprice > p_retailprice * 20 + sqrt(p_retailprice * 20)""")
def accept(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    j = li.join(p, "l_partkey")
    return j.where(mt.accepted(F.col("l_extendedprice"), F.col("p_retailprice") * 20, F.col("p_size") == 1)).select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"))


@register("R17_strict_refilter", """
WITH j AS (SELECT l_orderkey, l_linenumber, l_quantity * 4 AS score, CASE WHEN p_size < 25 THEN 40.0 ELSE p_size END AS t1,
  CASE WHEN s_suppkey % 2 = 0 THEN 40.0 ELSE s_suppkey % 60 END AS t2, max(l_quantity * 4) OVER (PARTITION BY l_orderkey) AS best
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT l_orderkey, l_linenumber, CASE WHEN score > 2 * greatest(t1, t2) AND (NOT (t1 = 40 AND t2 = 40) OR score >= best / 10) THEN 'regular' ELSE 'not_considered' END AS kind FROM j""")
def strict(spark, d):
    li = table(spark, d, "lineitem")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    best = li.groupBy("l_orderkey").agg((F.max("l_quantity") * 4).alias("best"))
    j = li.join(p, "l_partkey").join(s, "l_suppkey").join(best, "l_orderkey")
    t1 = F.when(F.col("p_size") < 25, 40.0).otherwise(F.col("p_size").cast("double"))
    t2 = F.when(F.col("l_suppkey") % 2 == 0, 40.0).otherwise((F.col("l_suppkey") % 60).cast("double"))
    ok = mt.strictly_accepted(F.col("l_quantity") * 4, t1, t2, F.col("best"))
    return j.select("l_orderkey", "l_linenumber", F.when(ok, "regular").otherwise("not_considered").alias("kind"))


_MATCH = """m AS (
  SELECT 'p' AS org1, l_partkey AS id1, 's' || (l_suppkey % 5) AS org2, l_suppkey AS id2, max(l_quantity) AS score,
         min(l_linenumber) AS own_start, min(l_linenumber) + 10 AS own_end, min(l_orderkey) % 100000 * 37 AS start,
         min(l_orderkey) % 100000 * 37 + 300 AS "end", min(l_orderkey) % 2 AS seqid, min(l_linestatus) = 'F' AS inverted
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def _matches(spark, d):
    at = F.min("l_orderkey") % 100000 * 37
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2")).agg(
        F.max("l_quantity").alias("score"), F.min("l_linenumber").alias("own_start"), (F.min("l_linenumber") + 10).alias("own_end"),
        at.alias("start"), (at + 300).alias("end"), (F.min("l_orderkey") % 2).alias("seqid"),
        (F.min("l_linestatus") == "F").alias("inverted")
    ).withColumn("org1", F.lit("p")).withColumn("org2", F.concat(F.lit("s"), F.col("id2") % 5))


@register("R18_spread_flags", f"""
WITH {_MATCH}, g AS (SELECT *, start - lag("end") OVER (PARTITION BY id1, org2, seqid ORDER BY start, "end") AS gap FROM m)
SELECT org1, id1, org2, count(DISTINCT seqid) > 1 OR coalesce(max(gap), 0) > 100000 AS out_of_tolerance, count(DISTINCT seqid) > 1 AS different_chromosomes
FROM g GROUP BY org1, id1, org2""")
def spread(spark, d):
    return mt.spread_flags(_matches(spark, d), tolerance=100_000)


@register("R19_order_and_strand_flags", f"""
WITH {_MATCH}, l AS (
  SELECT org1, id1, org2, list(id2 ORDER BY own_start, own_end, id2) AS got, min(inverted) <> max(inverted) AS different_strands, max(inverted) AS inv FROM m GROUP BY ALL)
SELECT org1, id1, org2, different_strands,
       different_strands OR got <> CASE WHEN inv THEN list_reverse_sort(got) ELSE list_sort(got) END AS not_in_order FROM l""")
def order(spark, d):
    return mt.order_flags(_matches(spark, d))


@register("R19b_both_directions", """
WITH m AS (SELECT DISTINCT 'p' AS org1, l_partkey AS id1, 's' AS org2, l_suppkey AS id2 FROM lineitem)
SELECT org1, id1, org2, id2 FROM m UNION ALL SELECT org2, id2, org1, id1 FROM m""")
def directions(spark, d):
    m = table(spark, d, "lineitem").select(
        F.lit("p").alias("org1"), F.col("l_partkey").alias("id1"), F.lit("s").alias("org2"), F.col("l_suppkey").alias("id2")).distinct()
    return mt.both_directions(m)


@register("R20_two_sided_support", """
WITH o AS (SELECT o_custkey % 20 AS k, o_orderkey AS id1, o_orderkey * 13 % 500000 AS pos1, o_orderkey % 997 AS id2,
             CAST(floor(o_totalprice) AS BIGINT) AS pos2, o_totalprice / 1000 AS score, o_orderpriority = '1-URGENT' AS dup FROM orders),
a AS (SELECT * FROM o WHERE dup AND id1 % 3 = 0), b AS (SELECT * FROM o WHERE NOT dup),
s AS (SELECT a.id1,
  sum(CASE WHEN b.pos1 < a.pos1 THEN b.score ELSE 0 END) AS sl, sum(CASE WHEN b.pos1 > a.pos1 THEN b.score ELSE 0 END) AS sr,
  sum(CASE WHEN b.pos2 < a.pos2 THEN b.score ELSE 0 END) AS tl, sum(CASE WHEN b.pos2 > a.pos2 THEN b.score ELSE 0 END) AS tr
  FROM a JOIN b ON a.k = b.k AND abs(b.pos1 - a.pos1) < 20000 AND abs(b.pos2 - a.pos2) < 20000 AND a.id1 <> b.id1 AND a.id2 <> b.id2 GROUP BY a.id1)
SELECT a.id1, round(coalesce(sl, 0), 5) AS source_left, round(coalesce(sr, 0), 5) AS source_right, round(coalesce(tl, 0), 5) AS target_left,
       round(coalesce(tr, 0), 5) AS target_right, least(coalesce(sl, 0), coalesce(sr, 0), coalesce(tl, 0), coalesce(tr, 0)) >= 200 AS syntenic
FROM a LEFT JOIN s ON a.id1 = s.id1""")
def support(spark, d):
    o = table(spark, d, "orders").select(
        (F.col("o_custkey") % 20).alias("k"), F.col("o_orderkey").alias("id1"), (F.col("o_orderkey") * 13 % 500000).alias("pos1"),
        (F.col("o_orderkey") % 997).alias("id2"), F.floor("o_totalprice").alias("pos2"), (F.col("o_totalprice") / 1000).alias("score"),
        (F.col("o_orderpriority") == "1-URGENT").alias("dup"))
    out = mt.synteny_support(
        o.where("dup and id1 % 3 = 0").drop("score", "dup"), o.where("not dup").drop("dup"), ["k"], 20000, 200.0)
    names = ["source_left", "source_right", "target_left", "target_right"]
    return out.select("id1", *[F.round(c, 5).alias(c) for c in names], "syntenic")


_TWO = f"""p AS ({SQL_PAIRS}),
a AS (SELECT 'p' AS org1, part AS id1, 's' AS org2, supp AS id2, score FROM p WHERE part % 5 <> 1
  UNION ALL SELECT 's', supp, 'p', part, score FROM p WHERE supp % 5 <> 2)"""


def _two_sided(spark, d):
    p = pairs(spark, d)
    a = p.where("part % 5 <> 1").select(
        F.lit("p").alias("org1"), F.col("part").alias("id1"), F.lit("s").alias("org2"), F.col("supp").alias("id2"), "score")
    b = p.where("supp % 5 <> 2").select(
        F.lit("s").alias("org1"), F.col("supp").alias("id1"), F.lit("p").alias("org2"), F.col("part").alias("id2"), "score")
    return a.union(b)


@register("R21_reciprocity_flags", f"""
WITH {_TWO}
SELECT org1, id1, org2, bool_or(NOT EXISTS (SELECT 1 FROM a b WHERE b.org1 = a.org2 AND b.id1 = a.id2 AND b.org2 = a.org1 AND b.id2 = a.id1)) AS ambiguous
FROM a GROUP BY org1, id1, org2""")
def reciprocity(spark, d):
    return mt.flag_pairs(_two_sided(spark, d))


@register("R22_succinct_projection", f"""
WITH {_TWO}, k AS (SELECT *, CASE id2 % 4 WHEN 0 THEN 'dup' WHEN 1 THEN 'not_considered' ELSE 'regular' END AS kind, id1 % 2 = 0 AS syntenic FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY org1, id1, org2 ORDER BY CASE kind WHEN 'regular' THEN 0 ELSE 1 END, id2) AS r FROM k
      WHERE kind = 'regular' OR (kind = 'dup' AND syntenic))
SELECT org1, id1, org2, id2, kind, trunc(score)::INT AS score FROM r WHERE r = 1""")
def succinct(spark, d):
    kind = F.when(F.col("id2") % 4 == 0, "dup").when(F.col("id2") % 4 == 1, "not_considered").otherwise("regular")
    m = _two_sided(spark, d).withColumn("kind", kind).withColumn("syntenic", F.col("id1") % 2 == 0)
    return mt.succinct(m).select("org1", "id1", "org2", "id2", "kind", "score")


@register("R23_mutual_canonical", f"""
WITH p AS ({SQL_PAIRS}) SELECT 'p' AS org1, part AS id1, 's' AS org2, supp AS id2, score, score AS score_back FROM p WHERE part % 5 <> 1 AND supp % 5 <> 2""")
def mutual(spark, d):
    return mt.mutual(_two_sided(spark, d))


@register("R23b_merge_keep_best", """
SELECT l_partkey AS id1, l_suppkey AS id2, max(l_quantity) AS score,
       min(l_linenumber) FILTER (l_quantity = mx) AS line FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_partkey, l_suppkey) AS mx FROM lineitem) GROUP BY ALL""")
def keep_best(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2"), F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("line"))
    return mt.merge_keep_best([li.where("line <= 3"), li.where("line > 3")], ["id1", "id2"])


@register("R26_raised_flags", f"""
WITH {_TWO}, f AS (SELECT org1, id1, org2, id1 % 7 = 0 AS bad FROM a GROUP BY ALL),
t AS (SELECT a.org2 AS org1, a.id2 AS id1, a.org1 AS org2, bool_or(bad) AS told FROM a JOIN f USING (org1, id1, org2) GROUP BY ALL)
SELECT f.org1, f.id1, f.org2, bad OR coalesce(told, false) AS bad FROM f LEFT JOIN t USING (org1, id1, org2)""")
def raised(spark, d):
    m = _two_sided(spark, d)
    flags = m.select("org1", "id1", "org2").distinct().withColumn("bad", F.col("id1") % 7 == 0)
    return mt.raise_in_others(flags, m)


@register("R26b_propagated_removal", f"""
WITH p AS (SELECT part, supp, (part + 3 * supp) % 11 = 0 AND part % 5 <> 1 AS told FROM ({SQL_PAIRS}))
SELECT 'p' AS org1, part AS id1, 's' AS org2, supp AS id2, CASE WHEN told THEN 'not_considered' ELSE 'regular' END AS kind FROM p WHERE part % 5 <> 1
UNION ALL SELECT 's', supp, 'p', part, CASE WHEN told THEN 'not_considered' ELSE 'regular' END FROM p WHERE supp % 5 <> 2""")
def propagated(spark, d):
    m = _two_sided(spark, d).withColumn(
        "kind", F.when(((F.col("id1") + 3 * F.col("id2")) % 11 == 0) & (F.col("org1") == "p"), "not_considered").otherwise("regular"))
    return mt.propagate(m).select("org1", "id1", "org2", "id2", "kind")


@register("R44_pair_enumeration", """
SELECT DISTINCT least(a.n_name, b.n_name) AS org1, greatest(a.n_name, b.n_name) AS org2 FROM nation a, nation b WHERE a.n_nationkey < 6 AND a.n_name <> b.n_name""")
def pair_list(spark, d):
    n = table(spark, d, "nation")
    return mt.pairs_to_compute(n.where("n_nationkey < 6"), n, "n_name")


@register("R44b_checked_pair_list", """
WITH p AS (SELECT DISTINCT 'NATION_' || (o_custkey % 30) AS a, 'NATION_' || (o_orderkey % 27) AS b FROM orders)
SELECT DISTINCT 'pair' AS what, least(a, b) AS x, greatest(a, b) AS y FROM p WHERE a <> b AND a IN (SELECT n_name FROM nation) AND b IN (SELECT n_name FROM nation)
UNION ALL (SELECT 'problem', 'pair with itself: ' || a, '' FROM p WHERE a = b
UNION SELECT 'problem', 'unknown: ' || a, '' FROM p WHERE a NOT IN (SELECT n_name FROM nation)
UNION SELECT 'problem', 'unknown: ' || b, '' FROM p WHERE b NOT IN (SELECT n_name FROM nation))""")
def checked(spark, d):
    p = table(spark, d, "orders").select(
        F.concat(F.lit("NATION_"), F.col("o_custkey") % 30).alias("org1"), F.concat(F.lit("NATION_"), F.col("o_orderkey") % 27).alias("org2")).distinct()
    good, bad = mt.checked_pairs(p, table(spark, d, "nation").withColumnRenamed("n_name", "org"))
    return good.select(F.lit("pair").alias("what"), F.col("org1").alias("x"), F.col("org2").alias("y")).union(
        bad.select(F.lit("problem"), "problem", F.lit("")))


@register("R49_nearest_neighbours", f"""
WITH e AS ({SQL_EVENTS}), q AS (SELECT * FROM e WHERE event_type = 'view'), a AS (SELECT * FROM e WHERE event_type = 'error')
SELECT q.user_id, q.event_id AS id,
  (SELECT arg_min(a.event_id, (-a."end", a.event_id)) FROM a WHERE a.user_id = q.user_id AND a."end" < q.start) AS upstream,
  (SELECT arg_min(a.event_id, (a.start, a.event_id)) FROM a WHERE a.user_id = q.user_id AND a.start > q."end") AS downstream FROM q""")
def nearest(spark, d):
    e = intervals(spark, d).select("user_id", F.col("event_id").alias("id"), "start", "end", "event_type")
    out = mt.nearest_neighbours(e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'error'"), ["user_id"])
    return out.select("user_id", "id", "upstream", "downstream")


@register("R37b_pairs_sharing_groups", """
WITH m AS (SELECT DISTINCT l_suppkey AS a, l_orderkey AS g FROM lineitem WHERE l_suppkey < 200)
SELECT x.a, y.a AS b, count(*) AS n FROM m x JOIN m y ON x.g = y.g AND x.a < y.a GROUP BY ALL HAVING count(*) >= 4""")
def sharing(spark, d):
    return mt.pairs_sharing(table(spark, d, "lineitem").where("l_suppkey < 200"), "l_suppkey", "l_orderkey", 4)


@register("R25_correspondence", """
SELECT coalesce(c_custkey, o_custkey) AS k, CASE WHEN o_custkey IS NULL THEN 'left' ELSE 'right' END AS side
FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey % 10 <> 3) FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey
WHERE c_custkey IS NULL OR o_custkey IS NULL""")
def corresponding(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("k"))
    return mt.correspondence(c, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])
