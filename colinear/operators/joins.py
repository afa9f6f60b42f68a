"""Range and membership joins of elements, anchors, alignments and tracks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intervals import interval_join


def inside_both_windows(hits: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Hits strictly inside both windows of a marker: ``windows(marker, chr1, w1_start, w1_end, chr2, w2_start, w2_end)``."""
    met = interval_join(hits, windows, ["chr1"], ("start1", "end1"), ("w1_start", "w1_end"), width, closed=False)
    second = (F.col("chr2") == F.col("r_chr2")) & (F.col("start2") > F.col("w2_start")) & (F.col("end2") < F.col("w2_end"))
    return met.where((F.col("start1") > F.col("w1_start")) & (F.col("end1") < F.col("w1_end")) & second).drop("r_chr2")


def links_within_tracks(links: DataFrame, tracks: DataFrame, width: int) -> DataFrame:
    """Links with both ends on some track ``(track, seqid, start, end)``, each pair of end points once.

    A point's least track is found once for each point, where the points meet the tracks: the least pair of tracks of a
    link is that of its ends, so no table of all tracks of a point, or of all pairs of them, is made.
    """
    ends = links.select(*[F.col(f"{c}{i}") for i in (1, 2) for c in ("seqid", "pos")]).distinct()
    point = lambda i: ends.select(F.col(f"seqid{i}").alias("seqid"), F.col(f"pos{i}").alias("p0"))
    points = point(1).union(point(2)).distinct().withColumn("p1", F.col("p0"))
    spans = tracks.groupBy("seqid", "start", "end").agg(F.min("track").alias("track"))
    least = interval_join(points, spans, ["seqid"], ("p0", "p1"), ("start", "end"), width).groupBy("seqid", "p0").agg(F.min("track").alias("track"))
    on = lambda i: least.select(F.col("seqid").alias(f"seqid{i}"), F.col("p0").alias(f"pos{i}"), F.col("track").alias(f"track{i}"))
    a, b = (F.struct(F.col(f"seqid{i}").alias("seqid"), F.col(f"pos{i}").alias("pos")) for i in (1, 2))
    met = ends.join(on(1), ["seqid1", "pos1"]).join(on(2), ["seqid2", "pos2"]).withColumn("x", F.least(a, b)).withColumn("y", F.greatest(a, b))
    return met.groupBy("x", "y").agg(F.min(F.struct("track1", "track2")).alias("t")).select(
        F.col("x.seqid").alias("seqid1"), F.col("x.pos").alias("pos1"), F.col("y.seqid").alias("seqid2"), F.col("y.pos").alias("pos2"), "t.*")


def sharing_position(elements: DataFrame, keys: Sequence[str], element: str = "element", species: str = "species") -> DataFrame:
    """Pairs of elements of different species at the same aligned position, once each."""
    b = elements.select(*keys, F.col(element).alias("b"), F.col(species).alias("sb"))
    return elements.select(*keys, F.col(element).alias("a"), F.col(species).alias("sa")).join(b, list(keys)).where("a < b and sa <> sb").select(*keys, "a", "b")


def cross_species_pairs(elements: DataFrame, group: Sequence[str], score: float, element: str = "element", species: str = "species") -> DataFrame:
    """All pairs of elements of one group in different species, with a constant score."""
    return sharing_position(elements, group, element, species).withColumn("score", F.lit(score))


#: Spans of elements that one task of ``near_elements`` holds for a side, about.
HELD_SPANS = 1 << 21


def _near_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists ``x1``, ``x2`` of the elements that both sides of each class of alignments (``a``) are inside of.

    The rows of a cell come as the spans of side 1, those of side 2, then the alignments.
    """
    held: dict[int, list[pa.RecordBatch]] = {1: [], 2: []}
    sides = None
    for b in batches:
        kind = b.column("kind").to_numpy()
        for k in held:
            if (part := b.filter(pa.array(kind == k))).num_rows:
                held[k].append(part)
        lines = b.filter(pa.array(kind == 3))
        if lines.num_rows and sides is None:
            sides = [_spans(held.pop(k)) for k in (1, 2) if held[k]]
        if not lines.num_rows or len(sides) < 2:
            continue
        ends = [zip(*[lines.column(f"{c}{k}").to_pylist() for c in ("seqid", "bin", "s", "e")]) for k in (1, 2)]
        rows: list[int] = []
        met: tuple[list, list] = [], []
        size = 0
        for row, both in enumerate(zip(*ends)):
            hits = [_inside(side, *end) for side, end in zip(sides, both)]
            if len(hits[0]) and len(hits[1]):
                rows.append(row)
                for m, side, h in zip(met, sides, hits):
                    m.append(h)
                    size += int(side["n"][h].sum())
            if rows and (size >= 1 << 20 or row + 1 == lines.num_rows):
                yield pa.RecordBatch.from_arrays([lines.column("a").take(pa.array(rows)), *map(_ids, sides, met)], ["a", "x1", "x2"])
                rows, met, size = [], ([], []), 0


def _spans(batches: list[pa.RecordBatch]) -> dict:
    """One side's spans by sequence and bin: bounds, numbers of ids and where each one's ids begin."""
    seqid, at, lo, hi, x = (pa.concat_arrays([b.column(c) for b in batches]) for c in ("seqid1", "bin1", "s1", "e1", "x"))
    known = seqid.dictionary_encode()
    code, at = known.indices.to_numpy(), at.to_numpy()
    order = np.lexsort((at, code))
    code, at, x = code[order], at[order], x.take(pa.array(order))
    n = x.value_lengths().to_numpy().astype(np.int64)
    edge = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(at) != 0)) + 1).tolist(), len(code)]
    names = known.dictionary.to_pylist()
    return {"where": {(names[code[a]], int(at[a])): (a, z) for a, z in zip(edge, edge[1:])}, "n": n, "first": np.cumsum(n) - n, "ids": x.flatten().field(0),
            "lo": lo.to_numpy(zero_copy_only=False)[order], "hi": hi.to_numpy(zero_copy_only=False)[order]}


def _inside(side: dict, seqid, at: int, start, end) -> np.ndarray:
    """The spans of ``side`` that an interval is strictly inside of."""
    a, z = side["where"].get((seqid, at), (0, 0))
    lo, hi = side["lo"][a:z], side["hi"][a:z]
    return a + np.flatnonzero((lo < start) & (hi > end) & (hi >= start) & (lo <= end))


def _ids(side: dict, met: list[np.ndarray]) -> pa.Array:
    """A list of ids for each list of spans."""
    spans = np.concatenate(met)
    n = side["n"][spans]
    ends = np.cumsum(n)
    place = np.repeat(side["first"][spans] - (ends - n), n) + np.arange(n.sum())
    lengths = np.array([side["n"][h].sum() for h in met])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), side["ids"].take(pa.array(place)))


def near_elements(alignments: DataFrame, elements: DataFrame, margin: int, width: int) -> DataFrame:
    """Alignments whose two sides are each inside a padded element (strictly): ``elements(element, seqid, start, end)``.

    The bins of the sequences are dealt to groups, and a task gets the alignments with side 1 in one group and side 2 in another
    (a cell), and the elements of both groups: neither pairs nor lists of a side ever go through a shuffle, only elements do, once for each
    cell of their groups.  Equal spans are one class.  Pairs and triples are only expanded as the last step.  Repeated rows count
    each, null ids are ids.
    """
    n = max(1, int(alignments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = max(math.isqrt(n - 1) + 1, -(-2 * elements.count() // HELD_SPANS))
    ends = [f"{c}{i}" for i in (1, 2) for c in ("seqid", "start", "end")]
    bin_ = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    group = lambda i: F.pmod(F.xxhash64(F.col(f"seqid{i}").cast("string"), f"bin{i}"), F.lit(groups)).cast("int")
    lines = alignments.groupBy(*ends).agg(F.collect_list(F.struct("aln_id")).alias("a")).dropna(subset=ends).select(
        F.lit(3).alias("kind"), *[F.col(a).alias(b) for i in (1, 2) for a, b in ((f"seqid{i}", f"seqid{i}"), (f"start{i}", f"s{i}"), (f"end{i}", f"e{i}"))],
        *[bin_(f"start{i}").alias(f"bin{i}") for i in (1, 2)], "a").withColumn("cell", group(1) * groups + group(2))
    padded = elements.groupBy(F.col("seqid").alias("seqid1"), (F.col("start") - margin).alias("s1"), (F.col("end") + margin).alias("e1")).agg(
        F.collect_list(F.struct("element")).alias("x")).dropna(subset=["seqid1", "s1", "e1"])
    spans = padded.withColumn("bin1", F.explode(F.sequence(bin_("s1"), F.greatest(bin_("s1"), bin_("e1"))))).withColumn(
        "to", F.explode(F.sequence(F.lit(0), F.lit(2 * groups - 1))))
    other = F.pmod(F.col("to"), F.lit(groups))
    spans = spans.withColumn("kind", F.when(F.col("to") < groups, 1).otherwise(2)).withColumn(
        "cell", F.when(F.col("kind") == 1, group(1) * groups + other).otherwise(other * groups + group(1))).drop("to")
    cells = lines.unionByName(spans, allowMissingColumns=True).repartitionById(groups * groups, "cell").sortWithinPartitions("kind")
    form = T.StructType([lines.schema["a"], *[T.StructField(f"x{i}", T.ArrayType(elements.schema["element"].dataType)) for i in (1, 2)]])
    both = cells.mapInArrow(_near_lists, form)
    return both.select("x1", "x2", F.explode("a").alias("a")).select("a", "x2", F.explode("x1").alias("element1")).select(
        "a.aln_id", "element1", F.explode("x2").alias("element2"))


def around_elements(anchors: DataFrame, elements: DataFrame, margin: int, width: int) -> DataFrame:
    """Anchors that begin within ``margin`` of an element and don't reach over its upper bound."""
    padded = elements.select("element", "seqid", (F.col("start") - margin).alias("lo"), (F.col("end") + margin).alias("hi"))
    return interval_join(anchors, padded, ["seqid"], ("start", "end"), ("lo", "hi"), width).where("start >= lo and end <= hi")


def inside_genes(alignments: DataFrame, genes: DataFrame, margin: int, width: int) -> DataFrame:
    """Alignments wholly inside some padded gene."""
    g = genes.select("seqid", (F.col("start") - margin).alias("g0"), (F.col("end") + margin).alias("g1"))
    return interval_join(alignments, g, ["seqid"], ("start", "end"), ("g0", "g1"), width, how="left_semi",
                         extra=(F.col("start") >= F.col("g0")) & (F.col("end") <= F.col("g1")), row_id=["aln_id"])


def without_inserted(anchors: DataFrame, inserted: DataFrame, width: int) -> DataFrame:
    """Anchors that overlap no inserted element."""
    return interval_join(anchors, inserted.select("seqid", "start", "end"), ["seqid"], ("start", "end"), ("start", "end"), width,
                         how="left_anti", row_id=["anchor_id"])


def partners(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Symmetric map of partner sets."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("partner")).union(edges.select(b, a))
    return both.groupBy("node").agg(F.array_sort(F.collect_set("partner")).alias("partners"))


def foreign_hits(hits: DataFrame, share: float = 0.5) -> DataFrame:
    """Forward self-alignment hits that aren't the query itself: ``(own_start, own_end, start, end)``.

    Dropped: hits that contain or lie in the query's own span, or more than ``share`` of them inside it.
    """
    inside = F.greatest(F.least("end", "own_end") - F.greatest("start", "own_start"), F.lit(0))
    contains = (F.col("start") <= F.col("own_start")) & (F.col("end") >= F.col("own_end"))
    within = (F.col("start") >= F.col("own_start")) & (F.col("end") <= F.col("own_end"))
    own = contains | within | (inside > share * (F.col("end") - F.col("start")))
    return hits.where((F.col("orientation") == "reverse") | ~own)


def oriented(start: Column, end: Column) -> tuple[Column, Column, Column]:
    """Ordered coordinates and strand of a hit whose reverse strand is told by swapped ends."""
    return F.least(start, end), F.greatest(start, end), F.when(start > end, "-").otherwise("+")


def quality_filtered(hits: DataFrame, least_identity: float, most_frameshifts: int, least_bitscore: float) -> DataFrame:
    """``hits`` with ``dropped``: null if kept, else the first reason."""
    return hits.withColumn("dropped", F.when(F.col("identity") < least_identity, "identity").when(F.col("frameshifts") > most_frameshifts, "frameshifts")
                           .when(F.col("bitscore") < least_bitscore, "bitscore").when(F.coalesce("protein", F.lit("")) == "", "no protein"))


def _by_repeats(df: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id no other row has, and the rest; null is an id."""
    again = df.groupBy(row_id).count().where("count > 1").select(F.col(row_id).alias("__again"))
    same = F.col(row_id).eqNullSafe(F.col("__again"))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def augmented_edges(alignments: DataFrame, genes: DataFrame, tolerance: int, width: int, least: float = 50.0, penalty: float = 2.0) -> DataFrame:
    """Edges between genes and the alignments clipped to them (with ``tolerance``), best score each.

    Each position cut off costs ``penalty``; what falls under ``least`` gives no edge.  The cost is the nearest double to
    the decimal product, so that a score of just ``least`` doesn't hang on how the penalty is held.  Equal spans of an id
    are one row, and a pair whose ids have no other rows is an edge as it is met: only pairs of ids with several spans are grouped.
    """
    rate = Fraction(str(penalty))
    a1, an = _by_repeats(alignments.groupBy("aln_id", "seqid", "start", "end").agg(F.max("score").alias("score")), "aln_id")
    g1, gn = _by_repeats(genes.select("gene_id", "seqid", (F.col("start") - tolerance).alias("lo"), (F.col("end") + tolerance).alias("hi")).distinct(), "gene_id")
    cut = (F.greatest("start", "lo") - F.col("start")) + (F.col("end") - F.least("end", "hi"))
    clipped = F.col("score") - cut * rate.numerator / F.lit(float(rate.denominator))

    def edges(a: DataFrame, g: DataFrame) -> DataFrame:
        met = interval_join(a, g, ["seqid"], ("start", "end"), ("lo", "hi"), width)
        return met.select("gene_id", "aln_id", clipped.alias("score")).where(F.col("score") >= least)

    several = edges(an, g1).union(edges(an, gn)).union(edges(a1, gn))
    return edges(a1, g1).union(several.groupBy("gene_id", "aln_id").agg(F.max("score").alias("score")))


def chain_labels(genes: DataFrame, components: DataFrame) -> DataFrame:
    """Genes of chains with the label by which they align: their homology component, or their own id."""
    c = components.select(F.col("node").alias("gene"), F.col("component").cast("string").alias("label"))
    return genes.join(c, "gene", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("own:"), F.col("gene").cast("string"))))


def group_means(members: DataFrame, group: str, score: str = "score", length: str = "length") -> DataFrame:
    """Mean score and length of each cluster, cut to integers."""
    return members.groupBy(group).agg(F.floor(F.avg(score)).alias("mean_score"), F.floor(F.avg(length)).alias("mean_length"), F.count("*").alias("n"))


def species_distribution(members: DataFrame, group: str, species: str = "species") -> DataFrame:
    """By number of species: how many clusters, and their least, greatest and mean size."""
    per = members.groupBy(group).agg(F.countDistinct(species).alias("n_species"), F.count("*").alias("size"))
    return per.groupBy("n_species").agg(F.count("*").alias("clusters"), F.min("size").alias("least"), F.max("size").alias("most"), F.avg("size").alias("mean"))


def coverage_matrix(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """Share of each organism's genome that its hits with each other one cover."""
    return hits.groupBy("org1", "org2").agg(F.sum("length").alias("mass")).join(
        F.broadcast(sizes.select(F.col("org").alias("org1"), "size")), "org1").select("org1", "org2", (F.col("mass") / F.col("size")).alias("coverage"))
