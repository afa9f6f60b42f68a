"""Element, alignment and membership join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jn
from .analogues import SQL_EVENTS, SQL_PAIRS, intervals, pairs, table
from .catalogue import register

_AL = f"""ev AS ({SQL_EVENTS}),
al AS (SELECT a.event_id AS aln_id, a.user_id % 20 AS seqid1, a.start AS start1, a."end" AS end1, b.user_id % 20 AS seqid2, b.start AS start2, b."end" AS end2, a.value * 4 AS score
       FROM ev a JOIN ev b ON b.event_id = a.event_id + 1),
el AS (SELECT event_id AS element, user_id % 20 AS seqid, start, "end" FROM ev WHERE event_type = 'purchase')"""


def _al(spark, d):
    ev = intervals(spark, d)
    b = ev.select((F.col("event_id") - 1).alias("event_id"), (F.col("user_id") % 20).alias("seqid2"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    al = ev.join(b, "event_id").select(
        F.col("event_id").alias("aln_id"), (F.col("user_id") % 20).alias("seqid1"), F.col("start").alias("start1"), F.col("end").alias("end1"), "seqid2", "start2", "end2",
        (F.col("value") * 4).alias("score"))
    el = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("element"), (F.col("user_id") % 20).alias("seqid"), "start", "end")
    return al, el


@register("R51_alignments_near_elements", f"""
WITH {_AL} SELECT aln_id, x.element AS element1, y.element AS element2 FROM al JOIN el x ON seqid1 = x.seqid AND start1 > x.start - 9000 AND end1 < x."end" + 9000
JOIN el y ON seqid2 = y.seqid AND start2 > y.start - 9000 AND end2 < y."end" + 9000""")
def near(spark, d):
    al, el = _al(spark, d)
    return jn.near_elements(al, el, 9000, 32768)


@register("R51b_anchors_around_elements", f"""
WITH {_AL} SELECT element, event_id AS anchor_id FROM el JOIN ev ON user_id % 20 = el.seqid AND ev.start >= el.start - 9000 AND ev."end" <= el."end" + 9000""")
def around(spark, d):
    _, el = _al(spark, d)
    anchors = intervals(spark, d).select(F.col("event_id").alias("anchor_id"), (F.col("user_id") % 20).alias("seqid"), "start", "end")
    return jn.around_elements(anchors, el, 9000, 32768).select("element", "anchor_id")


@register("R51c_alignments_inside_genes", f"""
WITH {_AL} SELECT aln_id FROM al WHERE EXISTS (SELECT 1 FROM el WHERE seqid = seqid1 AND start1 >= el.start - 2000 AND end1 <= el."end" + 2000)""")
def inside(spark, d):
    al, el = _al(spark, d)
    a = al.select("aln_id", F.col("seqid1").alias("seqid"), F.col("start1").alias("start"), F.col("end1").alias("end"))
    return jn.inside_genes(a, el, 2000, 32768).select("aln_id")


@register("R51d_anchors_without_inserted", f"""
WITH {_AL} SELECT event_id AS anchor_id FROM ev WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM el WHERE el.seqid = user_id % 20 AND ev.start <= el."end" AND el.start <= ev."end")""")
def without(spark, d):
    _, el = _al(spark, d)
    anchors = intervals(spark, d).where("event_type = 'view'").select(F.col("event_id").alias("anchor_id"), (F.col("user_id") % 20).alias("seqid"), "start", "end")
    return jn.without_inserted(anchors, el, 32768).select("anchor_id")


@register("R51e_hits_in_two_windows", f"""
WITH {_AL}, w AS (SELECT event_id AS marker, user_id % 20 AS chr1, start - 40000 AS a1, start + 40000 AS z1, (user_id + 1) % 20 AS chr2, start - 90000 AS a2, start + 90000 AS z2 FROM ev WHERE event_type = 'signup')
SELECT marker, aln_id FROM al JOIN w ON seqid1 = chr1 AND seqid2 = chr2 AND start1 > a1 AND end1 < z1 AND start2 > a2 AND end2 < z2""")
def windows(spark, d):
    al, _ = _al(spark, d)
    s = F.col("start")
    w = intervals(spark, d).where("event_type = 'signup'").select(
        F.col("event_id").alias("marker"), (F.col("user_id") % 20).alias("chr1"), (s - 40000).alias("w1_start"), (s + 40000).alias("w1_end"),
        ((F.col("user_id") + 1) % 20).alias("chr2"), (s - 90000).alias("w2_start"), (s + 90000).alias("w2_end"))
    hits = al.withColumnsRenamed({"seqid1": "chr1", "seqid2": "chr2"})
    return jn.inside_both_windows(hits, w, 65536).select("marker", "aln_id")


@register("R51f_links_within_tracks", f"""
WITH {_AL}, t AS (SELECT element AS track, seqid, start - 5000 AS s, "end" + 5000 AS z FROM el),
m AS (SELECT seqid1, start1 AS pos1, seqid2, start2 AS pos2, x.track AS track1, y.track AS track2 FROM al JOIN t x ON x.seqid = seqid1 AND start1 BETWEEN x.s AND x.z JOIN t y ON y.seqid = seqid2 AND start2 BETWEEN y.s AND y.z),
c AS (SELECT *, (seqid1, pos1) <= (seqid2, pos2) AS fwd FROM m),
k AS (SELECT CASE WHEN fwd THEN seqid1 ELSE seqid2 END AS seqid1, CASE WHEN fwd THEN pos1 ELSE pos2 END AS pos1, CASE WHEN fwd THEN seqid2 ELSE seqid1 END AS seqid2, CASE WHEN fwd THEN pos2 ELSE pos1 END AS pos2, track1, track2 FROM c)
SELECT seqid1, pos1, seqid2, pos2, track1, track2 FROM (SELECT *, row_number() OVER (PARTITION BY seqid1, pos1, seqid2, pos2 ORDER BY track1, track2) AS r FROM k) WHERE r = 1""")
def tracks(spark, d):
    al, el = _al(spark, d)
    links = al.select(F.col("aln_id").alias("link_id"), "seqid1", F.col("start1").alias("pos1"), "seqid2", F.col("start2").alias("pos2"))
    t = el.select(F.col("element").alias("track"), "seqid", (F.col("start") - 5000).alias("start"), (F.col("end") + 5000).alias("end"))
    return jn.links_within_tracks(links, t, 32768)


@register("R51g_augmented_edges", f"""
WITH {_AL}, g AS (SELECT element AS gene_id, seqid, start - 1000 AS lo, "end" + 1000 AS hi FROM el)
SELECT gene_id, aln_id, round(max(score - 0.02 * ((greatest(start1, lo) - start1) + (end1 - least(end1, hi)))), 6) AS score FROM al JOIN g ON seqid = seqid1 AND start1 <= hi AND lo <= end1
WHERE score - 0.02 * ((greatest(start1, lo) - start1) + (end1 - least(end1, hi))) >= 50 GROUP BY ALL""")
def augmented(spark, d):
    al, el = _al(spark, d)
    a = al.select("aln_id", F.col("seqid1").alias("seqid"), F.col("start1").alias("start"), F.col("end1").alias("end"), "score")
    return jn.augmented_edges(a, el.withColumnRenamed("element", "gene_id"), 1000, 32768, 50.0, 0.02).withColumn("score", F.round("score", 6))


@register("R52_sharing_position", """
WITH e AS MATERIALIZED (
  SELECT l_orderkey * 100 + l_linenumber AS k, l_partkey AS element, l_suppkey % 4 AS species FROM lineitem
  UNION ALL SELECT l_orderkey * 100 + l_linenumber, l_partkey + 100000, l_partkey % 4 FROM lineitem)
SELECT k // 100 AS m, k % 100 AS pos, a.element AS a, b.element AS b, 7.5::DOUBLE AS score FROM e a JOIN e b USING (k) WHERE a.element < b.element AND a.species <> b.species""")
def positions(spark, d):
    li = table(spark, d, "lineitem")
    one = li.select(F.col("l_orderkey").alias("m"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("element"), (F.col("l_suppkey") % 4).alias("species"))
    two = li.select("l_orderkey", "l_linenumber", F.col("l_partkey") + 100000, F.col("l_partkey") % 4)
    return jn.cross_species_pairs(one.union(two), ["m", "pos"], 7.5)


@register("R52b_partner_sets", f"""
WITH p AS (SELECT DISTINCT part AS a, 1000000 + supp AS b FROM ({SQL_PAIRS}) WHERE score > 70)
SELECT node, array_to_string(list_sort(list(partner)), ',') AS partners FROM (SELECT a AS node, b AS partner FROM p UNION ALL SELECT b, a FROM p) GROUP BY node""")
def partner_sets(spark, d):
    e = pairs(spark, d).where("score > 70").select(F.col("part").alias("src"), (F.lit(1_000_000) + F.col("supp")).alias("dst"))
    return jn.partners(e).withColumn("partners", F.array_join("partners", ","))


@register("R53_foreign_self_hits", f"""
WITH e AS ({SQL_EVENTS}), h AS (SELECT a.event_id AS q, b.event_id AS t, a.start AS os, a."end" AS oe, b.start AS s, b."end" AS z, b.event_id % 3 = 0 AS rev
  FROM e a JOIN e b ON a.user_id = b.user_id AND b.start BETWEEN a.start - 3600 AND a.start + 3600)
SELECT q, t FROM h WHERE rev OR NOT ((s <= os AND z >= oe) OR (s >= os AND z <= oe) OR greatest(least(z, oe) - greatest(s, os), 0) > 0.5 * (z - s))""")
def foreign(spark, d):
    e = intervals(spark, d)
    b = e.select("user_id", F.col("event_id").alias("t"), F.col("start").alias("s"), F.col("end").alias("z"), F.col("start").alias("point"))
    a = e.select("user_id", F.col("event_id").alias("q"), F.col("start").alias("own_start"), F.col("end").alias("own_end"),
                 (F.col("start") - 3600).alias("lo"), (F.col("start") + 3600).alias("hi"))
    met = jn.interval_join(a, b, ["user_id"], ("lo", "hi"), ("s", "point"), 8192).withColumnsRenamed({"s": "start", "z": "end"})
    return jn.foreign_hits(met.withColumn("orientation", F.when(F.col("t") % 3 == 0, "reverse").otherwise("forward"))).select("q", "t")


@register("R53b_quality_filter_counts", """
WITH h AS (SELECT CASE WHEN l_discount < 0.03 THEN 'identity' WHEN l_linenumber > 5 THEN 'frameshifts' WHEN l_quantity < 10 THEN 'bitscore' WHEN l_returnflag = 'R' THEN 'no protein' END AS dropped FROM lineitem)
SELECT dropped, count(*) AS n FROM h GROUP BY dropped""")
def quality(spark, d):
    h = table(spark, d, "lineitem").select(
        F.col("l_discount").alias("identity"), F.col("l_linenumber").alias("frameshifts"), F.col("l_quantity").alias("bitscore"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")).alias("protein"))
    return jn.quality_filtered(h, 0.03, 5, 10.0).groupBy("dropped").agg(F.count("*").alias("n"))


@register("R54_cluster_statistics", """
WITH p AS (SELECT l_orderkey AS g, count(DISTINCT l_returnflag) AS n_species, count(*) AS size FROM lineitem GROUP BY 1)
SELECT n_species, count(*) AS clusters, min(size) AS least, max(size) AS most, round(avg(size), 6) AS mean FROM p GROUP BY 1""")
def species(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_returnflag").alias("species"))
    return jn.species_distribution(m, "g").withColumn("mean", F.round("mean", 6))


@register("R54b_group_means", """
SELECT l_partkey AS g, floor(avg(l_quantity))::BIGINT AS mean_score, floor(avg(l_linenumber))::BIGINT AS mean_length, count(*) AS n FROM lineitem GROUP BY 1""")
def means(spark, d):
    return jn.group_means(table(spark, d, "lineitem").select(F.col("l_partkey").alias("g"), F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("length")), "g")


@register("R54c_coverage_matrix", """
SELECT (l_suppkey % 8)::BIGINT AS org1, (l_partkey % 8)::BIGINT AS org2, round(sum(l_quantity) / (1000.0 * (l_suppkey % 8 + 1)), 6) AS coverage FROM lineitem GROUP BY l_suppkey % 8, l_partkey % 8""")
def coverage(spark, d):
    h = table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("org1"), (F.col("l_partkey") % 8).alias("org2"), F.col("l_quantity").alias("length"))
    sizes = spark.range(8).select(F.col("id").alias("org"), (F.lit(1000.0) * (F.col("id") + 1)).alias("size"))
    return jn.coverage_matrix(h, sizes).withColumn("coverage", F.round("coverage", 6))
