"""Coordinate and interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coords, intervals as iv
from .analogues import SQL_EVENTS, intervals, table
from .catalogue import register


@register("R02_cumulative_offsets", """
SELECT c_nationkey, c_custkey, CAST(floor(c_acctbal) + 1001 AS BIGINT) AS length,
       sum(CAST(floor(c_acctbal) + 1001 AS BIGINT)) OVER w - CAST(floor(c_acctbal) + 1001 AS BIGINT) AS abs_start,
       sum(CAST(floor(c_acctbal) + 1001 AS BIGINT)) OVER w AS abs_end
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)""")
def cumulative(spark, d):
    chrom = table(spark, d, "customer").select(
        "c_nationkey", "c_custkey", (F.floor("c_acctbal") + 1001).alias("length"))
    out = coords.cumulative_offsets(chrom, ["c_nationkey"], ["c_custkey"])
    return out.select("c_nationkey", "c_custkey", "length", "abs_start", "abs_end")


@register("R03_locate_positions", """
WITH c AS (SELECT c_nationkey AS org, c_custkey AS seqid, CAST(floor(c_acctbal) + 1001 AS BIGINT) AS length FROM customer),
o AS (SELECT *, sum(length) OVER (PARTITION BY org ORDER BY seqid ROWS UNBOUNDED PRECEDING) AS abs_end FROM c),
p AS (SELECT o_orderkey, o_orderkey % 25 AS org, o_orderkey * 7919 % 400000 AS pos FROM orders)
SELECT o_orderkey, p.org::BIGINT AS org, pos, seqid, pos - (abs_end - length) AS rel
FROM p JOIN o ON p.org = o.org AND abs_end - length <= pos AND pos < abs_end""")
def locate(spark, d):
    chrom = coords.cumulative_offsets(
        table(spark, d, "customer").select(
            F.col("c_nationkey").cast("long").alias("org"), F.col("c_custkey").alias("seqid"),
            (F.floor("c_acctbal") + 1001).alias("length")), ["org"], ["seqid"])
    points = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 25).alias("org"), (F.col("o_orderkey") * 7919 % 400000).alias("pos"))
    return coords.locate(points, chrom, ["org"], width=8192).select(
        "o_orderkey", "org", "pos", "seqid", coords.relative(F.col("pos"), F.col("abs_start")).alias("rel"))


@register("R03b_spans_within_one_sequence", """
WITH c AS (SELECT c_nationkey::BIGINT AS org, c_custkey AS seqid, CAST(floor(c_acctbal) + 1001 AS BIGINT) AS length FROM customer),
o AS (SELECT *, sum(length) OVER (PARTITION BY org ORDER BY seqid ROWS UNBOUNDED PRECEDING) AS abs_end FROM c),
p AS (SELECT o_orderkey, o_orderkey % 25 AS org, o_orderkey * 7919 % 400000 AS s FROM orders)
SELECT o_orderkey, seqid FROM p JOIN o ON p.org = o.org AND abs_end - length <= s AND s < abs_end WHERE s + 1500 <= abs_end""")
def one_sequence(spark, d):
    chrom = coords.cumulative_offsets(
        table(spark, d, "customer").select(
            F.col("c_nationkey").cast("long").alias("org"), F.col("c_custkey").alias("seqid"),
            (F.floor("c_acctbal") + 1001).alias("length")), ["org"], ["seqid"])
    start = F.col("o_orderkey") * 7919 % 400000
    spans = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 25).alias("org"), start.alias("start"), (start + 1500).alias("end"))
    return coords.within_one_sequence(spans, chrom, ["org"], width=8192).select("o_orderkey", "seqid")


_ISLANDS = """
WITH e AS ({ev}), r AS (
  SELECT user_id, start, "end", max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
i AS (SELECT *, sum(CASE WHEN start <= reach + {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY user_id, island"""


@register("R04_merge_islands", _ISLANDS.format(ev=SQL_EVENTS, gap=3600))
def islands(spark, d):
    return iv.merge_islands(intervals(spark, d), ["user_id"], gap=3600, block=7 * 86400)


@register("R04b_merge_varying_gap", f"""
WITH e AS ({SQL_EVENTS}), g AS (
  SELECT *, greatest(event_id % 3 * 1800, coalesce(lag(event_id % 3 * 1800) OVER w, event_id % 3 * 1800)) AS gap,
         max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY start, "end")),
i AS (SELECT *, sum(CASE WHEN start <= reach + gap THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY user_id, island""")
def varying(spark, d):
    df = intervals(spark, d).withColumn("gap", F.col("event_id") % 3 * 1800)
    return iv.merge_varying_gap(df, ["user_id"], "start", "end", "gap")


@register("R05_cluster_by_previous_end", f"""
WITH e AS ({SQL_EVENTS}), r AS (
  SELECT *, CASE WHEN start - lag("end") OVER w <= 20000 THEN 0 ELSE 1 END AS new FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY start, "end")),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS cluster FROM r)
SELECT user_id, cluster::BIGINT AS cluster, count(*) AS n, min(start) AS lo, max("end") AS hi FROM c GROUP BY user_id, cluster""")
def previous_end(spark, d):
    c = iv.cluster_by_previous(intervals(spark, d), ["user_id"], margin=20000)
    return c.groupBy("user_id", F.col("cluster").cast("long").alias("cluster")).agg(
        F.count("*").alias("n"), F.min("start").alias("lo"), F.max("end").alias("hi"))


@register("R06_overlap_self_join", f"""
WITH e AS ({SQL_EVENTS})
SELECT a.user_id, a.event_id AS a, b.event_id AS b, least(a."end", b."end") - greatest(a.start, b.start) AS shared
FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.start <= b."end" AND b.start <= a."end" """)
def self_join(spark, d):
    met = iv.self_overlaps(intervals(spark, d), ["user_id"], ("start", "end"), "event_id", 16384)
    return met.select("user_id", F.col("event_id").alias("a"), F.col("r_event_id").alias("b"),
                      iv.overlap_length(("start", "end"), ("r_start", "r_end")).alias("shared"))


@register("R06b_overlap_semi_and_anti", f"""
WITH e AS ({SQL_EVENTS})
SELECT user_id, event_id, EXISTS (SELECT 1 FROM e b WHERE b.user_id = e.user_id AND b.event_type = 'error' AND b.event_id <> e.event_id
  AND e.start <= b."end" AND b.start <= e."end") AS touches FROM e WHERE event_type = 'view'""")
def semi_anti(spark, d):
    e = intervals(spark, d)
    views, errors = e.where("event_type = 'view'").select("user_id", "event_id", "start", "end"), e.where("event_type = 'error'")
    errors = errors.select("user_id", "start", "end")
    args = (errors, ["user_id"], ("start", "end"), ("start", "end"), 16384)
    yes = iv.interval_join(views, *args, how="left_semi", row_id=["event_id"]).withColumn("touches", F.lit(True))
    no = iv.interval_join(views, *args, how="left_anti", row_id=["event_id"]).withColumn("touches", F.lit(False))
    return yes.union(no).select("user_id", "event_id", "touches")


_STEP = f"""
e AS (SELECT * FROM ({SQL_EVENTS}) WHERE start < "end"),
r AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
i AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM r),
p AS (SELECT DISTINCT user_id, island, lo FROM (SELECT user_id, island, start AS lo FROM i UNION ALL SELECT user_id, island, "end" FROM i)),
c AS (SELECT *, lead(lo) OVER (PARTITION BY user_id, island ORDER BY lo) AS hi FROM p),
t AS (SELECT c.user_id, c.island, lo, hi, max(value) AS score FROM c JOIN i ON c.user_id = i.user_id AND c.island = i.island AND i.start <= lo AND hi <= i."end" GROUP BY ALL),
f AS (SELECT *, CASE WHEN lag(score) OVER w = score AND lag(hi) OVER w = lo THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY user_id, island ORDER BY lo)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, island ORDER BY lo ROWS UNBOUNDED PRECEDING) AS run FROM f),
seg AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi, any_value(score) AS score FROM g GROUP BY user_id, island, run)"""


@register("R07_step_function_max", f"WITH {_STEP} SELECT user_id, lo, hi, score FROM seg")
def step(spark, d):
    return iv.step_max(intervals(spark, d), ["user_id"], score="value")


_BOUNDS = 'b AS (SELECT user_id, min(start) - 1000 AS lo0, max("end") + 1000 AS hi0 FROM e GROUP BY user_id)'


@register("R08_fill_step_gaps", f"""
WITH {_STEP}, {_BOUNDS},
x AS (SELECT seg.*, lo0, hi0, coalesce(lag(hi) OVER (PARTITION BY user_id ORDER BY lo), lo0) AS before FROM seg JOIN b USING (user_id))
SELECT user_id, lo, hi, score FROM seg
UNION ALL SELECT user_id, before, lo, 40.0 FROM x WHERE before < lo
UNION ALL SELECT user_id, max(hi), any_value(hi0), 40.0 FROM x GROUP BY user_id HAVING max(hi) < any_value(hi0)""")
def fill(spark, d):
    e = intervals(spark, d).where("start < end")
    bounds = e.groupBy("user_id").agg((F.min("start") - 1000).alias("lo0"), (F.max("end") + 1000).alias("hi0"))
    return iv.fill_gaps(iv.step_max(e, ["user_id"], score="value"), bounds, ["user_id"], 40.0)


@register("R08b_range_max_lookup", f"""
WITH {_STEP}
SELECT e.event_id, max(seg.score) AS top FROM e JOIN seg ON e.user_id = seg.user_id AND seg.lo < e."end" AND seg.hi > e.start
GROUP BY e.event_id""")
def range_lookup(spark, d):
    e = intervals(spark, d).where("start < end")
    seg = iv.step_max(e, ["user_id"], score="value").groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi", "score"))).alias("segments"))
    return e.join(seg, "user_id").select(
        "event_id", iv.range_max(F.col("segments"), F.col("start"), F.col("end")).alias("top"))


@register("R09_longest_remainder", f"""
WITH e AS ({SQL_EVENTS}), r AS (SELECT user_id, event_id, start, "end" FROM e WHERE event_type = 'view'),
c AS (SELECT user_id, start AS c0, "end" AS c1 FROM e WHERE event_type <> 'view'),
m AS (SELECT r.user_id, event_id, r.start AS a, r."end" AS z, greatest(c0, r.start) AS s, least(c1, r."end") AS e
      FROM r JOIN c ON r.user_id = c.user_id AND r.start < c1 AND c0 < r."end"),
g AS (
  SELECT event_id, coalesce(max(e) OVER (PARTITION BY event_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS lo, s AS hi FROM m
  UNION ALL SELECT event_id, max(e), any_value(z) FROM m GROUP BY event_id
  UNION ALL SELECT event_id, start, "end" FROM r WHERE event_id NOT IN (SELECT event_id FROM m)),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY hi - lo DESC, lo) AS k FROM g WHERE lo < hi)
SELECT event_id, lo, hi FROM k WHERE k = 1 AND hi - lo >= 50""")
def remainder(spark, d):
    e = intervals(spark, d)
    out = iv.longest_remainder(e.where("event_type = 'view'"), e.where("event_type <> 'view'"), ["user_id"], "event_id", 16384)
    return out.select("event_id", "lo", "hi")


@register("R09b_clip_with_penalty", f"""
WITH e AS ({SQL_EVENTS}), b AS (SELECT user_id, min(start) + 86400 AS lo, max("end") - 86400 AS hi FROM e GROUP BY user_id)
SELECT event_id, greatest(start, lo) AS s, least("end", hi) AS z,
       round(value * 10 - 2 * ((greatest(start, lo) - start) + ("end" - least("end", hi))), 6) AS score
FROM e JOIN b USING (user_id)
WHERE start <= hi AND lo <= "end" AND value * 10 - 2 * ((greatest(start, lo) - start) + ("end" - least("end", hi))) >= 50""")
def clip(spark, d):
    e = intervals(spark, d)
    b = iv.coverage_range(e, ["user_id"], -86400)
    hits = e.join(b, "user_id").withColumn("score", F.col("value") * 10)
    return iv.clip_with_penalty(hits, "lo", "hi").select(
        "event_id", F.col("start").alias("s"), F.col("end").alias("z"), F.round("score", 6).alias("score"))


@register("R09c_resolve_duplications", f"""
WITH e AS ({SQL_EVENTS}), du AS (SELECT * FROM e WHERE event_type = 'error'), ca AS (SELECT * FROM e WHERE event_type = 'view'),
m AS (SELECT du.event_id AS id, ca.event_id AS cid, du.start, ca.start AS cs,
        greatest(least(du."end", ca."end") - greatest(du.start, ca.start), 0) AS ov, ca."end" - ca.start AS len
      FROM du JOIN ca ON du.user_id = ca.user_id AND du.start <= ca."end" AND ca.start <= du."end"),
c AS (SELECT id, max(CASE WHEN ov < 0.3 * len AND cs <= start THEN ov + 100 END) AS cl,
             max(CASE WHEN ov < 0.3 * len AND cs > start THEN ov + 100 END) AS cr FROM m GROUP BY id)
SELECT 'dup' AS what, event_id AS id, start + coalesce(cl, 0) AS s, "end" - coalesce(cr, 0) AS z
FROM du LEFT JOIN c ON du.event_id = c.id WHERE ("end" - coalesce(cr, 0)) - (start + coalesce(cl, 0)) >= 300
UNION ALL SELECT DISTINCT 'deleted', cid, 0, 0 FROM m WHERE NOT ov < 0.3 * len""")
def dup_resolution(spark, d):
    e = intervals(spark, d).select("user_id", F.col("event_id").alias("id"), "start", "end", "event_type")
    kept, gone = iv.resolve_dups(
        e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'view'").drop("event_type"), ["user_id"], 16384)
    zero = F.lit(0).cast("long")
    return kept.select(F.lit("dup").alias("what"), "id", F.col("start").alias("s"), F.col("end").alias("z")).union(
        gone.select(F.lit("deleted"), "id", zero, zero))


@register("R09d_block_spans", """
WITH p AS (SELECT l_orderkey AS block_id, 'part' AS org, l_partkey % 7 AS chr, l_partkey AS pos FROM lineitem
  UNION ALL SELECT l_orderkey, 'supp', l_suppkey % 7, l_suppkey FROM lineitem)
SELECT block_id, org, chr, min(pos) AS start, max(pos) + 10 AS "end" FROM p GROUP BY ALL""")
def block_spans(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda i, name, c: [
        F.lit(name).alias(f"org{i}"), (F.col(c) % 7).alias(f"chr{i}"), F.col(c).alias(f"start{i}"), (F.col(c) + 10).alias(f"end{i}")]
    return iv.block_spans(li.select(F.col("l_orderkey").alias("block_id"), *side(1, "part", "l_partkey"), *side(2, "supp", "l_suppkey")))


@register("R25b_overlapping_neighbours", f"""
WITH e AS ({SQL_EVENTS}), n AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start, "end") AS next_start FROM e)
SELECT user_id, count(*) AS n FROM n WHERE next_start <= "end" GROUP BY user_id""")
def neighbours(spark, d):
    return iv.overlapping_neighbours(intervals(spark, d), ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


@register("R02b_aliases", """
WITH f AS (SELECT l_suppkey % 10 AS org, l_partkey % 13 AS seqid, min(l_orderkey) AS first FROM lineitem GROUP BY ALL),
o AS (SELECT org, row_number() OVER (ORDER BY org) AS org_no FROM (SELECT DISTINCT org FROM f))
SELECT org, org_no || 'org' AS org_id, seqid,
       org_no || 'orgchr' || row_number() OVER (PARTITION BY org ORDER BY first, seqid) AS chrom_id FROM f JOIN o USING (org)""")
def alias_table(spark, d):
    a = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("org"), (F.col("l_partkey") % 13).alias("seqid"), F.col("l_orderkey").alias("anchor_id"))
    return coords.aliases(a)


@register("R02c_track_layout", """
SELECT c_nationkey, c_custkey, sum(l + 50) OVER w - (l + 50) AS abs_start, sum(l + 50) OVER w - 50 AS abs_end
FROM (SELECT *, CAST(floor(c_acctbal) + 1001 AS BIGINT) AS l FROM customer) WHERE l >= 3000
WINDOW w AS (PARTITION BY c_nationkey ORDER BY l DESC, c_custkey ROWS UNBOUNDED PRECEDING)""")
def layout(spark, d):
    chrom = table(spark, d, "customer").select(
        "c_nationkey", "c_custkey", (F.floor("c_acctbal") + 1001).alias("length"))
    return coords.track_layout(chrom, ["c_nationkey"], [F.desc("length"), "c_custkey"], 3000, 50).select(
        "c_nationkey", "c_custkey", "abs_start", "abs_end")


@register("R03c_split_over_sequences", """
WITH c AS (SELECT c_nationkey::BIGINT AS org, c_custkey AS seqid, CAST(floor(c_acctbal) + 1001 AS BIGINT) AS length FROM customer),
o AS (SELECT org, seqid, length, sum(length) OVER (PARTITION BY org ORDER BY seqid ROWS UNBOUNDED PRECEDING) AS abs_end FROM c),
p AS (SELECT o_orderkey % 25 AS org, o_orderkey * 7919 % 400000 AS s, o_orderkey % 5 = 0 AS found FROM orders WHERE o_orderkey % 20 < 10),
q AS (SELECT p.org, seqid, greatest(greatest(s, abs_end - length) - (abs_end - length) - 200, 0) AS a,
        least(least(s + 2500, abs_end) - (abs_end - length) + 200, length) AS z, found
      FROM p JOIN o ON p.org = o.org AND s < abs_end AND abs_end - length < s + 2500),
r AS (SELECT *, max(z) OVER (PARTITION BY org, seqid ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
i AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY org, seqid ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT org, seqid, min(a) AS start, max(z) AS "end", count(*) AS n, bool_or(found) AS is_found FROM i GROUP BY org, seqid, island""")
def split_regions(spark, d):
    chrom = coords.cumulative_offsets(
        table(spark, d, "customer").select(
            F.col("c_nationkey").cast("long").alias("org"), F.col("c_custkey").alias("seqid"),
            (F.floor("c_acctbal") + 1001).alias("length")), ["org"], ["seqid"])
    start = F.col("o_orderkey") * 7919 % 400000
    regions = table(spark, d, "orders").where("o_orderkey % 20 < 10").select(
        (F.col("o_orderkey") % 25).alias("org"), start.alias("start"), (start + 2500).alias("end"),
        (F.col("o_orderkey") % 5 == 0).alias("is_found"))
    return coords.split_over_sequences(regions, chrom, ["org"], pad=200, width=8192)
