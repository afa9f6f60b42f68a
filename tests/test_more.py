"""Operators that no named query covers."""

import pickle

import pytest
from pyspark.sql import functions as F

from colinear.operators import coords, graph, joins, kernels, matching as mt, stats, validate
from colinear.sources import readers as rd, writers as wr


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_collinearity_inputs_and_markers(spark):
    mutual = spark.createDataFrame([("a", 1, "b", 2, 9.0)], "org1 string, id1 long, org2 string, id2 long, score double")
    anchors = spark.createDataFrame([("a", 1, "c", 5, 9), ("b", 2, "d", 1, 4), ("b", 3, "d", 7, 8)], "org string, anchor_id long, seqid string, start long, end long")
    out = wr.collinearity_inputs(mutual, anchors, coords.aliases(anchors))
    assert rows(out["homology"]) == [("1orgchr1ele5to9", "2orgchr1ele1to4", 9.0)]
    assert rows(out["gff"]) == [("1orgchr1", "1orgchr1ele5to9", 5, 9), ("2orgchr1", "2orgchr1ele1to4", 1, 4)]
    m = graph.markers(spark.createDataFrame([(1, "s", "x", 5, 9), (1, "s", "y", 1, 2), (1, "s", "y", 4, 6)], "cluster int, species string, chrom string, start int, end int"))
    assert rows(m) == [(1, "s", "y", 2, 1, 6)]
    assert [r.line for r in wr.marker_lines(m).collect()] == ["1\ty\t1\t6"]
    region = spark.createDataFrame([("a", "c", 5, 9, 3)], "org string, seqid string, start long, end long, n int")
    assert wr.verbose_regions(region).first().line == "a c:5-9 (3 anchors)"


def test_region_coordinates_and_mirror(spark):
    df = spark.createDataFrame([(10, 20, 100, 200, False, "+"), (10, 20, 100, 200, True, "+")], "s int, e int, a int, z int, r boolean, d string")
    lo, hi, d = coords.region_to_genome(*(F.col(c) for c in ("s", "e", "a", "z", "r", "d")))
    assert [tuple(r) for r in df.select(lo, hi, d).collect()] == [(110, 120, "+"), (181, 191, "-")]
    assert df.select(coords.mirror(coords.mirror(F.col("s"), F.col("z")), F.col("z"))).first()[0] == 10
    assert [tuple(r) for r in df.limit(1).select(*coords.flip(F.col("s"), F.col("e"), F.col("z"))).collect()] == [(180, 190)]


def test_match_filters(spark):
    schema = "org1 string, id1 int, org2 string, id2 int, kind string, score double"
    m = spark.createDataFrame([("a", 1, "b", 2, "regular", 5.0), ("a", 1, "b", 2, "not_considered", 5.0), ("a", 1, "b", 3, "not_considered", 5.0), ("a", 4, "b", 9, "dup", 1.0)], schema)
    assert rows(mt.drop_repeated(m), "id1", "id2", "kind") == [(1, 2, "regular"), (1, 3, "not_considered"), (4, 9, "dup")]
    assert rows(mt.without_dups(m, spark.createDataFrame([("b", 3)], "org string, id int")), "id2", "kind") == [(2, "not_considered"), (2, "regular")]
    flags = spark.createDataFrame([("a", 1, "b", False, True), ("a", 4, "b", False, False)], "org1 string, id1 int, org2 string, out_of_tolerance boolean, ambiguous boolean")
    assert rows(mt.clean_pairs(m, flags), "id1") == [(4,)]
    weak = mt.refilter(m, flags.withColumn("out_of_tolerance", F.lit(True)), F.col("score") > 9)
    assert {r.kind for r in weak.collect()} == {"not_considered", "dup"}


def test_chain_sides_and_labels(spark):
    e = spark.createDataFrame([(1, 2), (1, 3)], "gene1 int, gene2 int")
    m = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 1)], "gene int, chain int, side int")
    assert rows(mt.opposite_sides(e, m), "gene1", "gene2") == [(1, 2)]
    comp = spark.createDataFrame([(1, 1), (2, 1)], "node int, component int")
    assert rows(joins.chain_labels(m, comp), "gene", "label") == [(1, "1"), (2, "1"), (3, "own:3")]


def test_assignment_by_hits_and_singletons(spark):
    h = spark.createDataFrame([("c", "x", 1.0), ("c", "x", 1.0), ("c", "y", 9.0)], "contig string, chrom string, score double")
    assert rows(graph.assign_by_mass(h, score=None), "chrom") == [("x",)] and rows(graph.assign_by_mass(h), "chrom") == [("y",)]
    cl = spark.createDataFrame([(1, 1), (1, 2)], "cluster int, block_id int")
    assert rows(graph.add_singletons(cl, spark.createDataFrame([(1,), (3,)], "block_id int"))) == [(1, 1), (1, 2), (3, 3)]
    shared = spark.createDataFrame([("e", 1), ("e", 2), ("f", 2), ("f", 3), ("g", 9)], "element string, group int")
    assert rows(graph.clusters_by_shared(shared)) == [(1, 1), (2, 1), (3, 1), (9, 9)]
    full = graph.complete_edges(spark.createDataFrame([("a", "b", -1.0), ("b", "c", -2.0)], "src string, dst string, weight double"))
    assert rows(full) == [("a", "b", -1.0), ("a", "c", 0.0), ("b", "c", -2.0)]


def test_validators(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    assert rows(validate.differences(a, b)) == [(2, "y", "expected"), (2, "z", "actual")]
    assert rows(validate.repeated_ids(a.union(b), ["k"]), "detail") == [("1:2",), ("2:2",)]
    assert rows(validate.in_several(a.union(b), ["k"], "v"), "detail") == [("2:2",)]
    assert rows(validate.subset(a, b.where("k = 1"), ["k"]), "detail") == [("2",)]
    assert rows(validate.same_keys(a, b.where("k = 1"), ["k"]), "detail") == [("left:2",)]
    files = spark.createDataFrame([("a", 5, bytearray(b">x")), ("b", 3, bytearray(b"..")), ("c", 0, bytearray(b""))], "path string, length long, head binary")
    want = spark.createDataFrame([("a", "fasta"), ("b", "uint16"), ("c", "text"), ("d", "text"), ("a", "odd")], "path string, kind string")
    assert rows(validate.file_states(files, want)) == [("a", "fasta", "PASS"), ("a", "odd", "UNKNOWN"), ("b", "uint16", "FAIL"), ("c", "text", "FAIL"), ("d", "text", "MISSING")]
    hits = spark.createDataFrame([(True, True, 5), (True, False, 3), (False, False, 1), (True, True, 7)], "forward boolean, backward boolean, overlap int")
    assert rows(validate.confirmation_counts(hits)) == [("both", 2, 5, 6.0, 7), ("neither", 1, 1, 1.0, 1), ("one", 1, 3, 3.0, 3)]
    twice = spark.createDataFrame([("a", 1, "b", 2, "regular"), ("a", 1, "b", 2, "not_considered")], "org1 string, id1 int, org2 string, id2 int, kind string")
    assert rows(validate.considered_twice(twice), "detail") == [("a:1:b:2",)]


def test_flags_that_only_one_side_has(spark):
    m = spark.createDataFrame([("a", 1, "b", 2), ("b", 2, "a", 1)], "org1 string, id1 int, org2 string, id2 int")
    f = spark.createDataFrame([("a", 1, "b", True), ("b", 2, "a", False)], "org1 string, id1 int, org2 string, far boolean")
    assert len(rows(validate.asymmetric_flags(f, m, ["far"]))) == 2


def test_spans_and_partners(spark):
    df = spark.createDataFrame([("t", 5, 9), ("t", 1, 3)], "id string, start int, end int")
    assert rows(stats.spans(df, ["id"])) == [("t", 1, 9)]


def test_pickled_matches(spark, tmp_path):
    p = tmp_path / "m.pkl"
    p.write_bytes(pickle.dumps({1: {"b": {2: (50.7, (3, 9), "forward")}}}))
    schema = "org1 string, id1 long, org2 string, id2 long, score double, hit_start int, hit_end int, orientation string"
    with pytest.raises(ValueError):
        rd.pickled_matches(spark, str(p), "a", schema)
    assert rows(rd.pickled_matches(spark, str(p), "a", schema, trusted=True)) == [("a", 1, "b", 2, 50.7, 3, 9, "forward")]


def test_kernels_on_frames(spark):
    df = spark.createDataFrame([("k", 1, 0, 10), ("k", 2, 5, 30), ("k", 3, 40, 50)], "k string, id long, start long, end long")
    assert rows(kernels.keep_longest(df, ["k"], "id"), "id") == [(2,), (3,)]
    d = kernels.dedup_reciprocal(df.withColumn("start", F.when(F.col("id") == 2, 1).otherwise(F.col("start"))).withColumn("end", F.when(F.col("id") == 2, 12).otherwise(F.col("end")))
                                 .withColumn("quality", F.col("id")), ["k"], 8)
    assert rows(d, "id", "start", "end", "n") == [(2, 0, 12, 2), (3, 40, 50, 1)]
    c = spark.createDataFrame([(1, "a", 1, 0, 10, "b", 1, 0, 10), (2, "a", 1, 5, 12, "b", 1, 5, 12), (3, "a", 1, 50, 60, "b", 2, 0, 9), (4, "a", 1, 55, 65, "b", 3, 0, 9)],
                              "chain_id long, org1 string, chr1 int, start1 long, end1 long, org2 string, chr2 int, start2 long, end2 long")
    assert rows(kernels.resolve_chains(c, 8), "chain_id") == [(1,)]
