"""Exports: each makes the rows as a DataFrame; ``write_lines`` puts text on any store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import format_element, format_query_header, format_region_name
from ..functions.sequences import reverse_complement


def write_lines(df: DataFrame, path: str, by: Sequence[str] = (), order: Sequence[str] = ("line_no",), compression: str = "none") -> None:
    """Text files of ``line``, ordered within each file, one folder by value of ``by``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by, *order) if by else df.repartitionByRange(n, *order)
    w = dealt.sortWithinPartitions(*by, *order).select(*by, "line").write.option("compression", compression)
    (w.partitionBy(*by) if by else w).text(path)


def query_fasta(candidates: DataFrame, reverse: bool = False) -> DataFrame:
    """FASTA records of candidates ``(org, anchor_id, seqid, rel_start, end, seq)``, forward or reverse complement."""
    seq = reverse_complement(F.col("seq")) if reverse else F.col("seq")
    head = format_query_header(F.col("anchor_id"), F.col("seqid"), F.col("rel_start"), F.col("end"))
    return candidates.select("org", F.col("anchor_id").alias("line_no"), F.concat(F.lit(">"), head, F.lit("\n"), seq).alias("line"))


def gff3_anchors(anchors: DataFrame, source: str = "anchors") -> DataFrame:
    """GFF3 lines of anchors with a running id for each organism."""
    n = F.row_number().over(Window.partitionBy("org").orderBy("anchor_id"))
    line = F.concat_ws("\t", "seqid", F.lit(source), F.lit("anchor"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"),
                       F.lit("."), F.lit("."), F.lit("."), F.concat(F.lit("ID=anchor"), n.cast("string")))
    return anchors.select("org", n.alias("line_no"), line.alias("line"))


def pairwise_table(matches: DataFrame, candidates: DataFrame, order: DataFrame) -> DataFrame:
    """13-column alignments: each unordered pair once (the organism earlier in ``order(org, rank)`` is
    side 1), regular matches then syntenic dups, coordinates on the sequence."""
    c = lambda i: candidates.select(
        F.col("org").alias(f"org{i}"), F.col("anchor_id").alias(f"id{i}"), F.col("seqid").alias(f"chr{i}"), F.col("start").alias(f"base{i}"))
    r = lambda i: order.select(F.col("org").alias(f"org{i}"), F.col("rank").alias(f"rank{i}"))
    usable = matches.where("kind = 'regular' or (kind = 'dup' and syntenic)").withColumn("class", F.when(F.col("kind") == "regular", 0).otherwise(1))
    j = usable.join(F.broadcast(r(1)), "org1").join(F.broadcast(r(2)), "org2").where("rank1 < rank2").join(c(1), ["org1", "id1"]).join(c(2), ["org2", "id2"])
    n = F.row_number().over(Window.partitionBy("org1", "org2").orderBy("class", "id1", "id2"))
    return j.select(
        n.cast("long").alias("aln_id"), "org1", "chr1", (F.col("base1") + F.col("own_start")).alias("start1"), (F.col("base1") + F.col("own_end")).alias("end1"),
        "org2", "chr2", (F.col("base2") + F.col("other_start")).alias("start2"), (F.col("base2") + F.col("other_end")).alias("end2"),
        F.when(F.col("inverted"), "reverse").otherwise("forward").alias("orientation"), "score",
        F.lit(None).cast("string").alias("score12"), F.lit(None).cast("string").alias("score21"))


def as_lines(df: DataFrame, order: Sequence[str], null: str = "NA", sep: str = "\t") -> DataFrame:
    """All columns as one line; nulls are written as ``null``."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in df.columns]
    return df.select(*order, F.concat_ws(sep, *cols).alias("line"))


def collinearity_inputs(mutual: DataFrame, anchors: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """gff, homology and bed rows of mutual pairs ``(org1, id1, org2, id2, score)``, named by alias."""
    ids = anchors.join(aliases, ["org", "seqid"]).select(
        "org", F.col("anchor_id").alias("id"), "chrom_id", "start", "end", format_element(F.col("chrom_id"), F.col("start"), F.col("end")).alias("name"))
    used = mutual.select(F.col("org1").alias("org"), F.col("id1").alias("id")).union(mutual.select("org2", "id2")).distinct()
    gff = ids.join(used, ["org", "id"], "left_semi")
    side = lambda i: ids.select(F.col("org").alias(f"org{i}"), F.col("id").alias(f"id{i}"), F.col("name").alias(f"name{i}"))
    homology = mutual.join(side(1), ["org1", "id1"]).join(side(2), ["org2", "id2"]).select("name1", "name2", "score").distinct()
    return {"gff": gff.select("chrom_id", "name", "start", "end").distinct(), "homology": homology,
            "bed": gff.select("chrom_id", "start", "end", "name").distinct()}


def region_fasta(regions: DataFrame, chunks: DataFrame) -> DataFrame:
    """FASTA of regions ``(org, seqid, start, end)`` from chunks that hold them whole: ``{org}_{seqid}_{start}_{end}_forward``."""
    c = chunks.select("org", "seqid", F.col("start").alias("c0"), (F.col("start") + F.length("seq")).alias("c1"), "seq")
    j = regions.join(c, ["org", "seqid"]).where("c0 <= start and end <= c1")
    one = j.groupBy("org", "seqid", "start", "end").agg(F.min(F.struct("c0", "seq")).alias("c"))
    seq = F.substr(F.col("c.seq"), (F.col("start") - F.col("c.c0") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    head = format_region_name(F.col("org"), F.col("seqid"), F.col("start"), F.col("end"))
    return one.select("org", F.row_number().over(Window.partitionBy("org").orderBy("seqid", "start")).alias("line_no"),
                      F.concat(F.lit(">"), head, F.lit("\n"), seq).alias("line"))


def scaffold_fasta(placed: DataFrame, contigs: DataFrame, gap: int = 100) -> DataFrame:
    """``placed(scaffold, pos, contig, orientation)`` and ``contigs(contig, seq)`` -> sequences joined by
    ``gap`` N, contigs that aren't placed appended as themselves."""
    oriented = placed.join(contigs, "contig").withColumn(
        "seq", F.when(F.col("orientation") == "reverse", reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    joined = oriented.groupBy("scaffold").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seq"))), lambda x: x["seq"]), "N" * gap).alias("seq"))
    rest = contigs.join(placed.select("contig"), "contig", "left_anti").select(F.col("contig").alias("scaffold"), "seq")
    return joined.unionByName(rest)


def marker_lines(markers: DataFrame) -> DataFrame:
    """Markers of each species in order along its chromosomes."""
    n = F.row_number().over(Window.partitionBy("species").orderBy("chrom", "start", "cluster"))
    return markers.select("species", n.alias("line_no"), F.concat_ws("\t", "cluster", "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("line"))


def alignment_anchors(hits: DataFrame) -> DataFrame:
    """Anchors of marker windows ``(w1_start, w2_start, w2_end, start1, end1, start2, end2, inverted, score)``
    contained in both: offsets from 1 in each window, from its end on an inverted one."""
    inside = (F.col("start1") > F.col("w1_start")) & (F.col("end1") < F.col("w1_end")) & (F.col("start2") > F.col("w2_start")) & (F.col("end2") < F.col("w2_end"))
    off2 = F.when(F.col("inverted"), F.col("w2_end") - F.col("end2")).otherwise(F.col("start2") - F.col("w2_start"))
    return hits.where(inside).select(
        "marker", (F.col("start1") - F.col("w1_start") + 1).alias("offset1"), (off2 + 1).alias("offset2"), (F.col("end1") - F.col("start1")).alias("length"), "score")


def verbose_regions(regions: DataFrame, found: Column | str = "n") -> DataFrame:
    """Readable line for each region."""
    return regions.select("org", "seqid", "start", F.format_string("%s %s:%d-%d (%d anchors)", "org", "seqid", "start", "end", F.col(found).cast("int") if isinstance(found, str) else found).alias("line"))
