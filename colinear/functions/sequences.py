"""Nucleotide and protein sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC letters and their complements (fixed values).
_BASES = "ACGTURYSWKMBDHVN"
_PAIRED = "TGCAAYRSWMKVHDBN"

#: Standard genetic code, codons in the order T, C, A, G at each position (fixed values).
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_ORDER = "TCAG"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, _BASES + _BASES.lower(), _PAIRED + _PAIRED.lower()))


def _codon(codon: Column) -> Column:
    at = [F.instr(F.lit(_ORDER), F.substr(codon, F.lit(i), F.lit(1))) for i in (1, 2, 3)]
    index = (at[0] - 1) * 16 + (at[1] - 1) * 4 + at[2]
    known = (at[0] > 0) & (at[1] > 0) & (at[2] > 0)
    return F.when(known, F.substr(F.lit(_AMINO), index, F.lit(1))).otherwise("X")


def translate(seq: Column, frame: int | Column = 0, to_stop: bool = False) -> Column:
    """Protein of whole codons from ``frame`` (0..2); unknown codons are X; ``to_stop`` cuts at the first stop."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    dna = F.translate(F.upper(seq), "U", "T")
    n = F.floor((F.length(dna) - frame) / F.lit(3)).cast("int")
    codons = F.when(n > 0, F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: _codon(F.substr(dna, i * 3 + frame + 1, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    protein = F.array_join(codons, "")
    return F.substring_index(protein, "*", 1) if to_stop else protein


def longest_frame(seq: Column, both_strands: bool = False) -> Column:
    """Longest protein without a stop among the 3 (or 6) frames; the first on ties."""
    strands = [seq, reverse_complement(seq)] if both_strands else [seq]
    every = F.flatten(F.array(*[F.split(translate(s, f), r"\*") for s in strands for f in range(3)]))
    best = F.aggregate(every, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    return best


def splice(exons: Column, strand: Column, phase: Column) -> Column:
    """Coding sequence of ``array<struct<start,seq>>``: exons in order (reversed and complemented on
    the minus strand), ``phase`` bases dropped in front and a partial codon behind."""
    joined = F.array_join(F.transform(F.array_sort(exons), lambda e: e["seq"]), "")
    oriented = F.when(strand == "-", reverse_complement(joined)).otherwise(joined)
    phased = F.substr(oriented, phase + 1, F.greatest(F.length(oriented) - phase, F.lit(0)))
    return F.substr(phased, F.lit(1), F.length(phased) - F.length(phased) % 3)


def auto_k(genome_size: Column) -> Column:
    """ceil(log4(size))."""
    return F.ceil(F.log2(genome_size.cast("double")) / 2).cast("int")
