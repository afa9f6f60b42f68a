"""Boundary cases of single operators on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from colinear.functions import names, params, sequences as sq
from colinear.operators import coords, delta, graph, intervals as iv, matching as mt, stats, validate, windows as wn


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture(scope="module")
def chrom(spark):
    c = spark.createDataFrame([("o", 0, "a", 100), ("o", 1, "b", 50), ("o", 2, "c", 10)], "org string, ordinal int, seqid string, length bigint")
    return coords.cumulative_offsets(c, ["org"], ["ordinal"])


def test_position_on_an_end_belongs_to_the_next_sequence(spark, chrom):
    p = spark.createDataFrame([("o", x) for x in (0, 99, 100, 149, 150, 159, 160)], "org string, pos bigint")
    assert rows(coords.locate(p, chrom, ["org"], width=16), "pos", "seqid") == [
        (0, "a"), (100, "b"), (149, "b"), (150, "c"), (159, "c"), (99, "a")]


def test_spans_over_two_sequences_are_rejected(spark, chrom):
    s = spark.createDataFrame([("o", 90, 100), ("o", 90, 101), ("o", 100, 150)], "org string, start bigint, end bigint")
    assert rows(coords.within_one_sequence(s, chrom, ["org"], width=16), "start", "end", "seqid") == [(100, 150, "b"), (90, 100, "a")]


def test_islands_at_the_gap_and_one_more(spark):
    s = spark.createDataFrame([("k", 0, 10), ("k", 15, 20), ("k", 26, 30), ("k", 3, 4), ("k", 30, 30)], "k string, start int, end int")
    assert rows(iv.merge_islands(s, ["k"], gap=5), "start", "end", "n") == [(0, 20, 3), (26, 30, 2)]
    assert rows(iv.merge_islands(s, ["k"], gap=5, block=7), "start", "end", "n") == [(0, 20, 3), (26, 30, 2)]
    previous = iv.cluster_by_previous(s, ["k"], margin=5)
    assert [r.cluster for r in previous.orderBy("start", "end").collect()] == [1, 1, 2, 3, 3]  # the row before, not the running end


def test_touching_and_contained_intervals(spark):
    s = spark.createDataFrame([(1, "k", 0, 10), (2, "k", 10, 20), (3, "k", 2, 3), (4, "k", 40, 41)], "id int, k string, start int, end int")
    pair = lambda closed: rows(iv.self_overlaps(s, ["k"], ("start", "end"), "id", 4, closed), "id", "r_id")
    assert pair(True) == [(1, 2), (1, 3)] and pair(False) == [(1, 3)]


def test_step_function_maximum_and_fill(spark):
    s = spark.createDataFrame([("k", 0, 10, 1.0), ("k", 5, 15, 2.0), ("k", 15, 20, 2.0), ("k", 30, 30, 9.0), ("k", 40, 50, 3.0)], "k string, start int, end int, score double")
    seg = iv.step_max(s, ["k"])
    assert rows(seg, "lo", "hi", "score") == [(0, 5, 1.0), (40, 50, 3.0), (5, 20, 2.0)]
    bounds = spark.createDataFrame([("k", 0, 60), ("empty", 0, 5)], "k string, lo0 int, hi0 int")
    assert rows(iv.fill_gaps(seg, bounds, ["k"], 40.0), "k", "lo", "hi", "score") == [
        ("empty", 0, 5, 40.0), ("k", 0, 5, 1.0), ("k", 20, 40, 40.0), ("k", 40, 50, 3.0), ("k", 5, 20, 2.0), ("k", 50, 60, 40.0)]


def test_range_maximum_on_a_breakpoint(spark):
    seg = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(v).alias("score")) for a, b, v in ((1, 10, 5.0), (10, 20, 7.0))])
    q = spark.createDataFrame([(1, 10), (10, 12), (9, 11), (0, 3), (20, 25)], "s int, e int")
    got = {r[0]: r[1] for r in q.select(F.struct("s", "e"), iv.range_max(seg, F.col("s"), F.col("e"))).collect()}
    assert list(got.values()) == [5.0, 7.0, 7.0, 5.0, None]


def test_longest_remainder(spark):
    r = spark.createDataFrame([("k", 1, 0, 100), ("k", 2, 200, 240)], "k string, id int, start int, end int")
    c = spark.createDataFrame([("k", 10, 30), ("k", 20, 35), ("k", 90, 120)], "k string, start int, end int")
    assert rows(iv.longest_remainder(r, c, ["k"], "id", 16, 50), "id", "lo", "hi") == [(1, 35, 90)]
    assert rows(iv.longest_remainder(r, c, ["k"], "id", 16, 40), "id", "lo", "hi") == [(1, 35, 90), (2, 200, 240)]


def test_windows_restart_after_an_invalid_position(spark):
    f = spark.createDataFrame([("k", i, v) for i, v in enumerate([1, 2, 3, 0, 1, 1, 1, 1, 0, 5])], "k string, pos int, freq int")
    assert rows(wn.sliding_sums(f, ["k"], 2, 2), "start", "total") == [(0, 3), (4, 2), (6, 2)]


@pytest.mark.parametrize("budget, want", [(0, []), (299, []), (300, [1, 1]), (600, [1, 1]), (900, [1, 1, 2]), (9999, [1, 1, 2, 5])])
def test_budget_keeps_ties(spark, budget, want):
    w = spark.createDataFrame([("k", i, v) for i, v in enumerate([5, 1, 2, 1])], "k string, id int, total int")
    b = spark.createDataFrame([("k", budget)], "k string, budget int")
    assert sorted(r.total for r in wn.lowest_within_budget(w, b, ["k"], 300).collect()) == want


def test_cutoff_keeps_the_value_that_crosses(spark):
    w = spark.createDataFrame([("k", v) for v in (9, 8, 8, 7)], "k string, cm int")
    keep = lambda n: sorted(r.cm for r in wn.highest_until_budget(w, spark.createDataFrame([("k", n)], "k string, budget int"), ["k"], 10).collect())
    assert keep(10) == [9] and keep(11) == [8, 8, 9] and keep(100) == [7, 8, 8, 9]


@pytest.mark.parametrize("length, want", [(200, [(0, 200)]), (699, [(0, 699)]), (700, [(0, 300), (400, 700)]), (1100, [(0, 300), (400, 700), (800, 1100)])])
def test_parts(spark, length, want):
    df = spark.createDataFrame([(length,)], "length int")
    assert [(r.part_start, r.part_end) for r in wn.split_into_parts(df).orderBy("part_no").collect()] == want


def test_acceptance_is_strict(spark):
    df = spark.createDataFrame([(110.0, 100.0, False), (110.1, 100.0, False), (1.0, 100.0, True)], "s double, t double, d boolean")
    assert [r[0] for r in df.select(mt.accepted(F.col("s"), F.col("t"), F.col("d"))).collect()] == [False, True, True]
    strict = spark.createDataFrame([(80.0, 40.0, 40.0, 100.0), (81.0, 40.0, 40.0, 811.0), (81.0, 40.0, 40.0, 810.0), (81.0, 40.0, 39.0, 9999.0)], "s double, a double, b double, m double")
    assert [r[0] for r in strict.select(mt.strictly_accepted(*map(F.col, "sabm"))).collect()] == [False, False, True, True]


@pytest.mark.parametrize("targets, want", [
    ([("a", 0, 10), ("a", 10_010, 10_020)], (False, False)), ([("a", 0, 10), ("a", 10_011, 10_020)], (True, False)),
    ([("a", 0, 10), ("b", 0, 10)], (True, True)), ([("a", 5, 6)], (False, False))])
def test_tolerance(spark, targets, want):
    df = spark.createDataFrame([("x", 1, "y", *x) for x in targets], "org1 string, id1 int, org2 string, seqid string, start int, end int")
    (r,) = mt.spread_flags(df).collect()
    assert (r.out_of_tolerance, r.different_chromosomes) == want


def test_support_needs_500_on_all_four_sides(spark):
    dup = spark.createDataFrame([("k", 1, 1_000_000, 2, 1_000_000)], "k string, id1 long, pos1 long, id2 long, pos2 long")
    near = lambda d: [("k", 10 + i, 1_000_000 + x, 20 + i, 1_000_000 + y, 250.0) for i, (x, y) in enumerate([(-d, -d), (-d, d), (d, -d), (d, d)])]
    schema = "k string, id1 long, pos1 long, id2 long, pos2 long, score double"
    ok = lambda n: mt.synteny_support(dup, spark.createDataFrame(n, schema), ["k"]).first().syntenic
    assert ok(near(99_999)) and not ok(near(100_000)) and not ok(near(99_999)[:3])


def test_nearest_neighbours_and_ties(spark):
    e = spark.createDataFrame([("k", 1, 100, 110), ("k", 2, 5, 6)], "k string, id long, start long, end long")
    a = spark.createDataFrame([("k", 7, 80, 99), ("k", 8, 90, 99), ("k", 9, 60, 100), ("k", 5, 111, 120)], "k string, id long, start long, end long")
    assert rows(mt.nearest_neighbours(e, a, ["k"]), "id", "upstream", "downstream") == [(1, 7, 5), (2, None, 9)]


def test_density_regions_border_and_noise(spark):
    p = spark.createDataFrame([("k", x) for x in (0, 1, 2, 3, 6, 50, 100, 101, 102, 103)], "k string, pos long")
    got = rows(graph.region_bounds(graph.dbscan_1d(p, ["k"], 3, 4), ["k"]), "start", "end", "n")
    assert got == [(0, 6, 5), (100, 103, 4)]


def test_components_of_a_long_chain(spark):
    e = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in graph.components(e).collect()} == {0}
    assert graph.components(e.limit(0)).count() == 0


def join_rows(spark, run):
    """Rows that the joins of all queries made while ``run`` ran, by Spark's own metrics."""
    store = spark._jsparkSession.sharedState().statusStore()

    def settled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return store.executionsCount()

    known, total = settled(), 0
    run()
    for i in range(known, settled()):
        execution = store.executionsList(i, 1).apply(0).executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for n in (nodes.apply(j) for j in range(nodes.size())):
            metrics = [n.metrics().apply(j) for j in range(n.metrics().size())] if "Join" in n.name() else []
            for m in metrics:
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_components_join_an_edge_once_not_in_each_round(spark):
    import random

    rng = random.Random(7)
    pairs = {tuple(sorted((x, min(x + rng.randint(1, 25), 599)))) for x in range(600) for _ in range(16)}  # wide chains take rounds
    pairs |= {(rng.randint(1000, 1099), 1100 + i) for i in range(60)} | {(2000, 2000)}
    e = spark.createDataFrame([rng.choice([p, p[::-1]]) for p in sorted(pairs)] + [(None, 5), (5, None)], "src long, dst long")
    label = {x: x for p in pairs for x in p}
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label = {x: low if y == high else y for x, y in label.items()}
    found = []
    rows = join_rows(spark, lambda: found.extend(graph.components(e).collect()))
    assert sorted((r.node, r.component) for r in found) == sorted(label.items())
    assert 0 < rows <= 4 * len(pairs), (rows, len(pairs))


def test_tombstones_and_snapshots(spark):
    m = spark.createDataFrame([("a", 1, "b", 2), ("b", 2, "a", 1), ("a", 3, "b", 2), ("b", 2, "a", 3)], "org1 string, id1 int, org2 string, id2 int")
    gone = spark.createDataFrame([("a", 1)], "org string, id int")
    stones = delta.tombstones(gone, m)
    assert rows(stones) == [("b", 2, "a", 1)]
    assert rows(delta.apply_tombstones(m, stones, gone)) == [("a", 3, "b", 2), ("b", 2, "a", 3)]
    assert rows(delta.to_reevaluate(stones, m.limit(0))) == [("b", 2, "a")]


def test_checks(spark, chrom):
    cand = spark.createDataFrame([("o", 1, "a", 10, 20), ("o", 2, "a", 20, 30), ("o", 3, "a", 90, 101), ("o", 4, "zz", 1, 2), ("o", 5, "b", 9, 8)], "org string, anchor_id int, seqid string, start int, end int")
    assert {(r.check, r.detail) for r in validate.candidate_checks(cand, chrom).collect()} == {
        ("overlap", "o:1"), ("outside_genome", "o:3"), ("unknown_sequence", "o:4"), ("end_before_start", "o:5")}
    with pytest.raises(Exception, match="overlap"):
        validate.fail_on_errors(validate.candidate_checks(cand.where("anchor_id < 3"), chrom)).collect()
    bad = validate.format_problems(cand, {"org": "string", "start": "bigint", "nope": "int"}, [("start_le_end", F.col("start") <= F.col("end"))], ["anchor_id"])
    assert {r.detail for r in bad.collect()} >= {"missing nope", "start is int, not bigint", "5"}


def test_single_copy_ignores_absent_species(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "c")], "g int, s string")
    assert rows(stats.single_copy(m, "g", "s"), "g", "single_copy") == [(1, True), (2, False), (3, True)]
    assert rows(stats.size_ranked_ids(m, "g", "s"), "g", "group_id") == [(1, "SOG0000000"), (2, "SOG0000001"), (3, "SOG0000002")]


def test_sequences(spark):
    df = spark.createDataFrame([("ATGGCCTAAtt",)], "s string")
    one = lambda c: df.select(c).first()[0]
    s = F.col("s")
    assert one(sq.reverse_complement(s)) == "aaTTAGGCCAT"
    assert one(sq.translate(s)) == "MA*" and one(sq.translate(s, to_stop=True)) == "MA" and one(sq.translate(s, 1)) == "WPN"
    assert one(sq.longest_frame(s)) == "WPN"
    exons = F.array(F.struct(F.lit(5).alias("start"), F.lit("GGG").alias("seq")), F.struct(F.lit(1).alias("start"), F.lit("ATGA").alias("seq")))
    assert one(sq.splice(exons, F.lit("+"), F.lit(1))) == "TGAGGG" and one(sq.splice(exons, F.lit("-"), F.lit(0))) == "CCCTCA"
    assert one(sq.auto_k(F.lit(64))) == 3 and one(sq.auto_k(F.lit(65))) == 4


def test_names(spark):
    df = spark.createDataFrame([("my_org_chr1_5_9_reverse", "2orgchr3ele7to19", "GCF_000001405.40")], "r string, e string, a string")
    r = df.select(names.parse_region_name(F.col("r")).alias("r"), names.parse_element(F.col("e")).alias("e"), names.is_accession(F.col("a")).alias("a")).first()
    assert (r.r.org, r.r.seqid, r.r.start, r.r.end, r.r.direction) == ("my_org", "chr1", 5, 9, "reverse")
    assert (r.e.org_id, r.e.chrom_id, r.e.start, r.e.end) == ("2org", "chr3", 7, 19) and r.a
    with pytest.raises(Exception, match="not an element"):
        df.select(names.parse_element(F.col("a"))).collect()


def test_parameters(spark):
    g = spark.createDataFrame([("a", 4096), ("b", 5000)], "org string, size long")
    k = params.default_parameters(g, "kmer")
    assert rows(k, "org", "k", "window", "percentile") == [("a", 6, 300, 42), ("b", 7, 300, 42)]
    bad = params.default_parameters(g, "dups").withColumn("pitch", F.lit(300)).withColumn("y1", F.lit(101))
    assert {r.problem for r in params.parameter_problems(bad, g.where("org = 'a'")).collect()} == {"pitch not below window", "y1 not within 0..100", "unknown organism"}


def test_links_within_very_many_tracks(spark):
    import time

    from colinear.operators import joins as jn

    tracks = spark.range(4000).selectExpr("id + 7 as track", "0L as seqid", "-id as start", "9000 + id as end")
    tracks = tracks.union(spark.sql("select 3L, 0L, 0L, 50L"))
    links = spark.range(60).selectExpr("id as link_id", "0L as seqid1", "id * 10 as pos1", "0L as seqid2", "300 - id as pos2")
    began = time.time()
    got = {(r.pos1, r.pos2): (r.track1, r.track2) for r in jn.links_within_tracks(links, tracks, 4096).collect()}
    assert time.time() - began < 60  # all pairs of tracks of all links: 960 million
    want = {}
    for i in range(60):
        ends, on = (10 * i, 300 - i), tuple(3 if p <= 50 else 7 for p in (10 * i, 300 - i))
        want[min(ends), max(ends)] = min(on, want.get((min(ends), max(ends)), on))
    assert got == want


def test_a_clipped_score_of_just_the_least_gives_an_edge(spark):
    from colinear.operators import joins as jn

    alignments = spark.createDataFrame([(1, 0, 65, 300, 50.7), (2, 0, 64, 300, 50.7)], "aln_id long, seqid long, start long, end long, score double")
    genes = spark.createDataFrame([(5, 0, 200, 300)], "gene_id long, seqid long, start long, end long")
    got = jn.augmented_edges(alignments, genes, 100, 64, 50.0, 0.02).collect()
    assert [tuple(r) for r in got] == [(5, 1, 50.0)]  # 0.02 * 35 as doubles is more than 0.7


def test_near_elements_counts_repeated_rows_and_copies(spark):
    from colinear.operators import joins as jn

    al = [(1, 0, 100, 120, 1, 500, 520), (1, 0, 100, 120, 1, 500, 520), (None, 0, 100, 120, 1, 500, 520), (2, 0, 100, 120, 1, 900, 920),
          (3, 1, 510, 515, 0, 90, 95), (4, None, 100, 120, 1, 500, 520)]
    el = [(10, 0, 95, 110), (11, 0, 95, 110), (12, 0, 300, 310), (20, 1, 505, 530), (20, 1, 505, 530), (None, 1, 480, 600)]
    inside = lambda q, s, e: [x for x, c, lo, hi in el if c == q and s > lo - 15 and e < hi + 15]
    want = [(a, x, y) for a, q1, s1, e1, q2, s2, e2 in al for x in inside(q1, s1, e1) for y in inside(q2, s2, e2)]
    a = spark.createDataFrame(al, "aln_id long, seqid1 long, start1 long, end1 long, seqid2 long, start2 long, end2 long")
    e = spark.createDataFrame(el, "element long, seqid long, start long, end long")
    got = jn.near_elements(a, e, 15, 64)
    assert got.columns == ["aln_id", "element1", "element2"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 20
    many = jn.near_elements(a.crossJoin(spark.range(40)).drop("id"), e.crossJoin(spark.range(40)).drop("id"), 15, 64)
    assert many.count() == 40**3 * len(want)


def shuffled(df, metric="shuffleRecordsWritten"):
    """Rows (``dataSize``: bytes) that all shuffles of ``df`` wrote, after it ran: from the metrics of its own final plan."""
    found, open_, seen = 0, [df._jdf.queryExecution().executedPlan()], set()
    while open_:
        node = open_.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            open_.append(node.plan())
        elif name != "ReusedExchangeExec":
            if name == "ShuffleExchangeExec" and node.id() not in seen:
                seen.add(node.id())
                found += node.metrics().get(metric).get().value()
            children = node.children()
            open_.extend(children.apply(i) for i in range(children.size()))
    return found


def test_augmented_edges_shuffle_no_pairs_of_single_ids(spark):
    from colinear.operators import joins as jn

    alignments = spark.range(400).selectExpr("id as aln_id", "0L as seqid", "id as start", "id + 500 as end", "90.0D as score").repartition(3)
    genes = spark.range(150).selectExpr("id as gene_id", "0L as seqid", "id + 100 as start", "id + 400 as end").repartition(3)
    edges = jn.augmented_edges(alignments, genes, 50, 1024, 50.0, 0.02)
    assert len(edges.collect()) == 400 * 150
    assert 0 < shuffled(edges) <= 10 * (400 + 150)


def test_augmented_edges_of_ids_with_several_spans(spark):
    import random

    from colinear.operators import joins as jn

    rng = random.Random(3)
    span = lambda: (rng.choice([0, 0, 0, 1, None]), rng.randint(0, 200))
    al = [(i, q, s, s + rng.randint(0, 150), rng.choice([None, float(rng.randint(40, 70))])) for i in [None, 1, 1, 1, *range(2, 40)] for q, s in [span()]]
    el = [(i, q, s, s + rng.randint(0, 150)) for i in [None, None, 5, 5, *range(6, 30)] for q, s in [span()]]
    al, el = al + al[:6] + [(*x[:4], 65.0) for x in al[3:9]], el + el[:5]
    want = {}
    for a, q, s, e, score in al:
        for g, c, x, y in el:
            if q is not None and q == c and score is not None and s <= y + 20 and x - 20 <= e:
                v = score - 0.5 * ((max(s, x - 20) - s) + (e - min(e, y + 20)))
                if v >= 45.0:
                    want[g, a] = max(v, want.get((g, a), v))
    a = spark.createDataFrame(al, "aln_id long, seqid long, start long, end long, score double")
    g = spark.createDataFrame(el, "gene_id long, seqid long, start long, end long")
    got = jn.augmented_edges(a, g, 20, 64, 45.0, 0.5)
    assert got.columns == ["gene_id", "aln_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(*k, v) for k, v in want.items()], key=repr) and len(want) > 50


def test_near_elements_shuffle_no_lists_of_a_side(spark):
    from colinear.operators import joins as jn

    al = spark.range(500).selectExpr("id as aln_id", "0L as seqid1", "id + 1000 as start1", "id + 1100 as end1", "1L as seqid2", "id + 2000 as start2", "id + 2100 as end2").repartition(3)
    el = spark.range(200).selectExpr("id as element", "0L as seqid", "id as start", "id + 3000 as end")
    near = jn.near_elements(al, el.union(el.selectExpr("element + 200", "1L", "start + 1000", "end")).repartition(3), 50, 4096)
    assert near.count() == 500 * 200 * 200
    rows = near.where("aln_id % 50 = 7").collect()
    assert sorted((r.aln_id, r.element1, r.element2) for r in rows) == [(a, x, y) for a in range(7, 500, 50) for x in range(200) for y in range(200, 400)]
    whole = near.groupBy().count()
    whole.collect()
    assert 0 < shuffled(whole, "dataSize") < 1_000_000  # lists of 200 ids for each of 500 alignments: some megabytes
