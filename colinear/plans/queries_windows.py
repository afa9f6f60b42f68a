"""Window, selection and k-mer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as wn
from .analogues import SQL_EVENTS, intervals, table
from .catalogue import register

_FREQ = f"""f AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS pos, CAST(floor(value) AS BIGINT) % 7 AS freq
  FROM ({SQL_EVENTS}))"""


def _freq(spark, d):
    e = intervals(spark, d).selectExpr(
        "user_id", "cast(row_number() over (partition by user_id order by start, event_id) as bigint) pos",
        "floor(value) % 7 as freq", "floor(value) % 5 as c2")
    return e


@register("R10_sliding_sums_rephased", f"""
WITH {_FREQ}, v AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM f WHERE freq > 0),
s AS (SELECT *, sum(freq) OVER w AS total, count(*) OVER w AS n, min(pos) OVER (PARTITION BY user_id, island) AS first FROM v
      WINDOW w AS (PARTITION BY user_id, island ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT user_id, pos AS start, total FROM s WHERE n = 4 AND (pos - first) % 2 = 0""")
def sliding(spark, d):
    return wn.sliding_sums(_freq(spark, d), ["user_id"], 4, 2)


@register("R11_budgeted_lowest_with_ties", """
WITH w AS (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) AS total FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY total) AS r FROM w),
b AS (SELECT s_suppkey, (s_suppkey % 40) * 300 + 299 AS budget FROM supplier)
SELECT l_suppkey, l_orderkey, l_linenumber, total FROM r JOIN b ON l_suppkey = s_suppkey WHERE r <= budget // 300""")
def lowest(spark, d):
    w = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.floor("l_quantity").alias("total"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), ((F.col("s_suppkey") % 40) * 300 + 299).alias("budget"))
    return wn.lowest_within_budget(w, b, ["l_suppkey"], 300).select("l_suppkey", "l_orderkey", "l_linenumber", "total")


@register("R12_histogram_cutoff_to_budget", """
WITH h AS (SELECT p_brand, p_size AS v, count(*) * 50 AS mass FROM part GROUP BY ALL),
r AS (SELECT *, sum(mass) OVER (PARTITION BY p_brand ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS upto FROM h),
b AS (SELECT p_brand, count(*) * 50 * 42 // 100 AS budget FROM part GROUP BY p_brand),
c AS (SELECT p_brand, min(v) AS cut FROM r JOIN b USING (p_brand) WHERE upto - mass < budget GROUP BY p_brand)
SELECT p_partkey, p_brand, p_size FROM part JOIN c USING (p_brand) WHERE p_size >= cut""")
def cutoff(spark, d):
    p = table(spark, d, "part")
    b = p.groupBy("p_brand").agg(F.floor(F.count("*") * 50 * 42 / F.lit(100)).alias("budget"))
    return wn.highest_until_budget(p, b, ["p_brand"], 50, "p_size").select("p_partkey", "p_brand", "p_size")


@register("R13_normalised_percentile_cut", """
WITH c AS (SELECT l_returnflag AS k, l_linestatus AS series, l_partkey AS w, sum(l_quantity) AS n FROM lineitem GROUP BY ALL),
t AS (SELECT k, series, sum(n) AS t FROM c GROUP BY ALL),
m AS (SELECT k, w, sum(n / t) AS mass FROM c JOIN t USING (k, series) GROUP BY ALL),
q AS (SELECT k, quantile_cont(mass, 0.42) AS cut FROM m GROUP BY k)
SELECT k, w, round(mass, 8) AS mass FROM m JOIN q USING (k) WHERE mass < cut - 1e-12""")
def percentile_cut(spark, d):
    c = table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("series"), F.col("l_partkey").alias("w")
    ).agg(F.sum("l_quantity").alias("n"))
    out = wn.normalised_below_percentile(c, ["k"], "series", ["w"], 42)
    return out.select("k", "w", F.round("mass", 8).alias("mass"))


@register("R14_duplication_windows", f"""
WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS pos,
           CAST(floor(value) AS BIGINT) % 7 AS c1, CAST(floor(value) AS BIGINT) % 5 AS c2 FROM ({SQL_EVENTS})),
w AS (SELECT DISTINCT user_id, pos // 2 * 2 AS start FROM f),
g AS (SELECT w.user_id, w.start, count(*) AS n, count(*) FILTER (c1 BETWEEN 2 AND 5) AS n1, count(*) FILTER (c2 > 3) AS n2
      FROM w JOIN f ON w.user_id = f.user_id AND pos >= w.start AND pos < w.start + 6 GROUP BY ALL)
SELECT user_id, start, n, n1, n2 FROM g WHERE n = 6 AND n1 * 100 >= 60 * n AND n2 * 100 < 20 * n""")
def dup_windows(spark, d):
    f = _freq(spark, d).withColumnRenamed("freq", "c1")
    return wn.duplication_windows(f, ["user_id"], 6, 2, 5, 60, 3, 20)


_SETS = f"""e AS ({SQL_EVENTS}),
a AS (SELECT user_id, start, "end", event_id % 2 AS flag FROM e WHERE event_type = 'view'),
b AS (SELECT user_id, start, "end", event_id % 2 AS flag FROM e WHERE event_type = 'click')"""


@register("R15_combine_by_flag", f"""
WITH {_SETS}
SELECT DISTINCT user_id, start, "end" FROM a WHERE flag = 0 OR EXISTS (SELECT 1 FROM b WHERE b.flag = 1 AND a.user_id = b.user_id AND a.start <= b."end" AND b.start <= a."end")
UNION SELECT DISTINCT user_id, start, "end" FROM b WHERE flag = 0 OR EXISTS (SELECT 1 FROM a WHERE a.flag = 1 AND a.user_id = b.user_id AND a.start <= b."end" AND b.start <= a."end")""")
def combine(spark, d):
    e = intervals(spark, d).withColumn("flag", F.col("event_id") % 2)
    return wn.combine_by_flag(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id"], 16384)


@register("R15b_combine_any_series", f"""
WITH e AS ({SQL_EVENTS}), w AS (SELECT DISTINCT user_id, event_type AS series, start, "end", event_id % 2 AS flag FROM e)
SELECT user_id, series, start, "end" FROM w WHERE flag = 0 OR EXISTS (
  SELECT 1 FROM w b WHERE b.user_id = w.user_id AND b.series <> w.series AND w.start <= b."end" AND b.start <= w."end")""")
def combine_any(spark, d):
    e = intervals(spark, d).withColumn("flag", F.col("event_id") % 2).withColumnRenamed("event_type", "series")
    return wn.combine_any(e, ["user_id"], 16384)


@register("R15c_merge_candidates", f"""
WITH e AS ({SQL_EVENTS}), c AS (SELECT user_id, max(start) - min(start) + 5000 AS length, min(start) AS s0 FROM e GROUP BY user_id),
w AS (SELECT user_id, start - s0 AS a, least("end" - s0, length - 1) AS z FROM e JOIN c USING (user_id)),
r AS (SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, sum(CASE WHEN a <= reach + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, min(a) AS start, max(z) AS "end", count(*) AS n FROM i GROUP BY user_id, island""")
def merged(spark, d):
    e = intervals(spark, d)
    c = e.groupBy("user_id").agg((F.max("start") - F.min("start") + 5000).alias("length"), F.min("start").alias("s0"))
    w = e.join(c.select("user_id", "s0"), "user_id").select(
        "user_id", (F.col("start") - F.col("s0")).alias("start"), (F.col("end") - F.col("s0")).alias("end"))
    return wn.merge_candidates(w, c, ["user_id"], 100)


@register("R15d_windows_from_midpoints", """
SELECT o_orderkey, c_custkey, greatest(o_orderkey % 3000 - 500, 0) AS start, greatest(o_orderkey % 3000 - 500, 0) + 1000 AS "end"
FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(floor(c_acctbal) AS BIGINT) >= 1000""")
def midpoints(spark, d):
    series = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 3000).alias("midpoint"))
    chrom = table(spark, d, "customer").select("c_custkey", F.floor("c_acctbal").alias("length"))
    return wn.from_midpoints(series, chrom, ["c_custkey"], 1000).select("o_orderkey", "c_custkey", "start", "end")


@register("R15e_reconcile_candidates", f"""
WITH e AS ({SQL_EVENTS}),
nw AS (SELECT user_id, event_id AS id, start, "end" FROM e WHERE event_type = 'view' AND "end" > start),
ol AS (SELECT user_id, event_id AS id, start, "end" FROM e WHERE event_type = 'error' AND "end" > start),
m AS (SELECT nw.user_id, nw.id, nw.start, nw."end", ol.id AS oid, ol.start AS os, ol."end" AS oe,
        (ol.start <= nw.start AND nw."end" <= ol."end") AS inside,
        (nw.start <= ol.start AND ol."end" <= nw."end" AND NOT (ol.start <= nw.start AND nw."end" <= ol."end")) AS holds,
        greatest(least(nw."end", ol."end") - greatest(nw.start, ol.start), 0) / (nw."end" - nw.start) > 0.3 AS much
      FROM nw JOIN ol ON nw.user_id = ol.user_id AND nw.start <= ol."end" AND ol.start <= nw."end"),
dr AS (SELECT DISTINCT id FROM m WHERE inside OR (NOT holds AND much)),
live AS (SELECT * FROM m WHERE id NOT IN (SELECT id FROM dr)),
sp AS (SELECT user_id, start, "end" FROM nw WHERE id NOT IN (SELECT id FROM dr) UNION ALL SELECT user_id, os, oe FROM live),
r AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
i AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT 'insert' AS what, user_id, min(start) AS a, max("end") AS z FROM i GROUP BY user_id, island
UNION ALL SELECT DISTINCT 'delete', user_id, oid, oid FROM live""")
def reconciled(spark, d):
    e = intervals(spark, d).where("start < end").select("user_id", F.col("event_id").alias("id"), "start", "end", "event_type")
    ins, gone = wn.reconcile(e.where("event_type = 'view'"), e.where("event_type = 'error'"), ["user_id"], 16384)
    return ins.select(F.lit("insert").alias("what"), "user_id", F.col("start").alias("a"), F.col("end").alias("z")).union(
        gone.select(F.lit("delete"), "user_id", "id", "id"))


@register("R15f_split_into_parts", """
WITH s AS (SELECT doc_id, n_chars AS length, greatest(CAST(floor((n_chars - 700) / 400) AS BIGINT) + 1, 0) AS n FROM documents),
p AS (SELECT doc_id, length, n, unnest(range(0, n + 1)) AS part_no FROM s)
SELECT doc_id, part_no, part_no * 400 AS part_start, CASE WHEN part_no = n THEN length ELSE part_no * 400 + 300 END AS part_end FROM p""")
def parts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("length"))
    return wn.split_into_parts(docs).select("doc_id", "part_no", "part_start", "part_end")


_MERS = """s AS (SELECT item_id AS seq_id, translate(lower(left(text, 120)), 'bcdefghijklmnopqrstuvwxyz .,', 'cgtacgtacgtacgtacgtacgtacgt') AS seq FROM benchmark),
m AS (SELECT seq_id, p - 1 AS pos, substr(seq, p, 6) AS kmer FROM s, unnest(range(1, len(seq) - 4)) AS u(p))"""


def _sequences(spark, d):
    letters = F.translate(F.lower(F.left("text", F.lit(120))), "bcdefghijklmnopqrstuvwxyz .,", "cgtacgtacgtacgtacgtacgtacgt")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("seq_id"), letters.alias("seq"))


@register("R41_kmer_frequency", f"""
WITH {_MERS}, f AS (SELECT kmer, count(*) AS freq FROM m GROUP BY kmer)
SELECT seq_id, pos, kmer, freq FROM m JOIN f USING (kmer) WHERE NOT contains(upper(kmer), 'N')""")
def kmers(spark, d):
    return wn.kmer_counts(_sequences(spark, d), 6).select("seq_id", "pos", "kmer", "freq")


@register("R41b_kmer_frequency_one_mismatch", f"""
WITH {_MERS}, k AS (SELECT kmer, count(*) AS n FROM m GROUP BY kmer),
f AS (SELECT a.kmer, sum(b.n)::BIGINT AS freq FROM k a JOIN k b ON len(list_filter(range(1, 7), lambda i: substr(a.kmer, i, 1) <> substr(b.kmer, i, 1))) <= 1 GROUP BY a.kmer)
SELECT seq_id, pos, kmer, freq FROM m JOIN f USING (kmer)""")
def kmers_near(spark, d):
    return wn.kmer_counts_with_errors(_sequences(spark, d), 6).select("seq_id", "pos", "kmer", "freq")


@register("R41c_window_complexity", f"""
WITH {_MERS}, w AS (SELECT seq_id, s, substr(seq, s + 1, 40) AS w FROM s, unnest(range(0, len(seq) - 40 + 1, 10)) AS u(s) WHERE len(seq) >= 40)
SELECT seq_id, s + 20 AS midpoint, round(len(list_distinct(list_transform(range(1, 39), lambda i: substr(w, i, 3)))) / 38.0, 6) AS cm FROM w""")
def complexity(spark, d):
    return wn.complexity(_sequences(spark, d), 40, 10).withColumn("cm", F.round("cm", 6))
