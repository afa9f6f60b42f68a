"""Identifiers: parsing, formatting, minting and classifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Formats of identifiers (fixed values).
ELEMENT = r"^(\d+org)(chr\d+)ele(\d+)to(\d+)$"
REGION = r"^(.+)_([^_]+)_(\d+)_(\d+)_(forward|reverse)$"
ACCESSION = r"^GC[AF]_\d{9}\.\d+$"


def parse_query_header(header: Column) -> Column:
    """``kmer$abs_start$chrom$rel_start$abs_end`` as a struct."""
    p = F.split(header, r"\$")
    return F.struct(F.get(p, F.lit(1)).cast("long").alias("abs_start"), F.get(p, F.lit(2)).alias("seqid"),
                    F.get(p, F.lit(3)).cast("long").alias("rel_start"), F.get(p, F.lit(4)).cast("long").alias("abs_end"))


def format_query_header(abs_start: Column, seqid: Column, rel_start: Column, abs_end: Column) -> Column:
    return F.concat_ws("$", F.lit("kmer"), abs_start.cast("string"), seqid, rel_start.cast("string"), abs_end.cast("string"))


def parse_region_name(name: Column) -> Column:
    """``org_chrom_start_end_direction``, read from the right (an organism's name may hold underscores)."""
    part = lambda i: F.regexp_extract(name, REGION, i)
    return F.when(name.rlike(REGION), F.struct(
        part(1).alias("org"), part(2).alias("seqid"), part(3).cast("long").alias("start"), part(4).cast("long").alias("end"), part(5).alias("direction")))


def format_region_name(org: Column, seqid: Column, start: Column, end: Column, direction: Column | str = "forward") -> Column:
    d = F.lit(direction) if isinstance(direction, str) else direction
    return F.concat_ws("_", org, seqid, start.cast("string"), end.cast("string"), d)


def parse_element(name: Column, strict: bool = True) -> Column:
    """``NorgchrMeleXtoY`` as a struct; any other name is an error (null if not ``strict``)."""
    part = lambda i: F.regexp_extract(name, ELEMENT, i)
    good = F.struct(part(1).alias("org_id"), part(2).alias("chrom_id"), part(3).cast("long").alias("start"), part(4).cast("long").alias("end"))
    bad = F.raise_error(F.concat(F.lit("not an element name: "), name)).cast("struct<org_id:string,chrom_id:string,start:bigint,end:bigint>")
    return F.when(name.rlike(ELEMENT), good).otherwise(bad) if strict else F.when(name.rlike(ELEMENT), good)


def format_element(chrom_id: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom_id, F.lit("ele"), start.cast("string"), F.lit("to"), end.cast("string"))


def is_accession(name: Column) -> Column:
    """True for an assembly accession, false for a custom name."""
    return name.rlike(ACCESSION)


def mint_hit_ids(hits: DataFrame, org: str, query: str, *order: str) -> DataFrame:
    """``hit-{n}_{org}_{query}``, n from 1 within organism and query."""
    n = F.row_number().over(Window.partitionBy(org, query).orderBy(*order))
    return hits.withColumn("hit_id", F.concat(F.lit("hit-"), n.cast("string"), F.lit("_"), org, F.lit("_"), query))


def strand_id(seqid: Column, start: Column, end: Column, strand: Column) -> Column:
    """``{seqid}_{start}_{end}_{m|p}``."""
    return F.concat_ws("_", seqid, start.cast("string"), end.cast("string"), F.when(strand == "-", "m").otherwise("p"))
