"""Schemas of the library's tables, as DDL."""

CHROM = "org string, ordinal int, seqid string, length bigint, abs_start bigint, abs_end bigint"
SEQUENCE = "org string, seqid string, chunk_no int, abs_start bigint, seq string"
KMER_FREQ = "org string, pos bigint, freq int"
COMPLEXITY = "org string, seqid string, midpoint bigint, cm double"
CANDIDATE = (
    "org string, anchor_id bigint, seqid string, start bigint, end bigint, word_size int, is_dup boolean,"
    " regions array<struct<lo:int,hi:int,score:double>>"
)
MATCH = (
    "org1 string, id1 bigint, org2 string, id2 bigint, kind string, score double, own_start int, own_end int,"
    " other_start int, other_end int, inverted boolean, syntenic boolean"
)
PAIR_META = (
    "org1 string, id1 bigint, org2 string, out_of_tolerance boolean, ambiguous boolean, not_in_order boolean,"
    " different_strands boolean, different_chromosomes boolean, changed boolean"
)
SUCCINCT = (
    "org1 string, id1 bigint, seqid string, start bigint, end bigint, org2 string, id2 bigint, score int,"
    " hit_start int, hit_end int, orientation string"
)
TOMBSTONE = "dst_org string, dst_id bigint, src_org string, src_id bigint"
PAIRWISE = (
    "aln_id bigint, org1 string, chr1 string, start1 bigint, end1 bigint, org2 string, chr2 string, start2 bigint,"
    " end2 bigint, orientation string, score double, score12 string, score21 string"
)
CHAINED_HIT = (
    "query string, subject string, q_start int, q_end int, s_start int, s_end int, score double, orientation string"
)
TABULAR_HIT = (
    "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int,"
    " sstart int, send int, evalue double, bitscore double"
)
PROTEIN_HIT = "qseqid string, sseqid string, pident double, length int, evalue double, bitscore double, qcov double"
GFF = (
    "seqid string, source string, type string, start bigint, end bigint, score string, strand string, phase string,"
    " attributes string"
)
GENE = "species string, seqid string, start bigint, end bigint, strand string, gene_id string"
COORDS = "org string, seqid string, start bigint, end bigint, orientation string, name string"
PARAM_KMER = "org string, k int, e int, window int, pitch int, percentile int, flag int"
PARAM_COMPLEXITY = "org string, window int, pitch int, percentile int, flag int"
PARAM_DUPS = (
    "org string, k1 int, e1 int, k2 int, e2 int, window int, pitch int, x1 int, y1 int, x2 int, y2 int, flag int"
)

#: Defaults of the whole pipeline (fixed values).
DEFAULTS = {
    "word_size": 11, "e_value": 1e-3, "score_threshold": 40.0, "match_tolerance": 10_000, "min_anchor": 300,
    "dup_overlap": 0.3, "dup_gap": 100, "synteny_margin": 100_000, "synteny_score": 500.0,
    "kmer_e": 0, "kmer_window": 300, "kmer_pitch": 50, "kmer_percent": 42,
    "complexity_window": 1000, "complexity_pitch": 50, "complexity_percent": 42,
    "dup_k1": 50, "dup_e1": 4, "dup_k2": 21, "dup_e2": 2, "dup_window": 300, "dup_pitch": 50,
    "dup_x1": 16, "dup_y1": 90, "dup_x2": 10, "dup_y2": 10,
    "merge_gap": 100, "self_overlap": 0.5, "regions_iterations": 3, "regions_margin": 1_000_000,
    "regions_scope": 500_000, "regions_min_anchors": 4, "regions_buffer": 10_000,
    "edge_score": 40.0, "clip_tolerance": 10_000, "clip_min": 50.0, "clip_penalty": 2.0,
    "dp_match": 2.0, "dp_gap": -1.0, "dp_tandem": 0.1, "dp_max_tandem": 20,
    "dedup_overlap": 0.5, "dedup_ratio": 2.0, "mcl_inflation": 2.0, "min_species": 2,
    "divergent_share": 0.2, "orientation_low": 0.1, "orientation_high": 0.9, "scaffold_gap": 100,
    "segment_gap": 500_000,
}
