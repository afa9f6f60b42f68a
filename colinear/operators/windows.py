"""Window aggregation over positions and selection of candidate windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import interval_join, merge_islands, overlap_length


def sliding_sums(freq: DataFrame, keys: Sequence[str], length: int, pitch: int, pos: str = "pos",
                 value: str = "freq") -> DataFrame:
    """``start, total``: sums of ``length`` consecutive valid values, starts ``pitch`` apart.

    A value of 0 (or a missing position) is invalid.  In each valid stretch the starts are its
    first position and every ``pitch`` after it while the window fits; the phase begins anew in the next
    stretch.  Stretches shorter than ``length`` give nothing.
    """
    order = Window.partitionBy(*keys).orderBy(pos)
    valid = freq.where(F.col(value) > 0).withColumn("__island", F.col(pos) - F.row_number().over(order))
    own = Window.partitionBy(*keys, "__island").orderBy(pos)
    reach = own.rowsBetween(0, length - 1)
    out = (
        valid.withColumn("total", F.sum(value).over(reach)).withColumn("__n", F.count("*").over(reach))
        .withColumn("__first", F.first(pos).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return out.where((F.col("__n") == length) & ((F.col(pos) - F.col("__first")) % pitch == 0)).select(
        *keys, F.col(pos).alias("start"), "total")


def _running(hist: DataFrame, keys: Sequence[str], by: Column) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(by)
    return hist.withColumn("__upto", F.sum("__mass").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def lowest_within_budget(windows: DataFrame, budgets: DataFrame, keys: Sequence[str], length: int,
                         value: str = "total") -> DataFrame:
    """The ``budget // length`` windows of least ``value``, with all that tie with the last one.

    ``budgets(keys, budget)``.  A count of 0 keeps none, one above the number of windows all.
    The threshold comes from a histogram of values, so no window is ranked against all others.
    """
    hist = windows.groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__mass"))
    wanted = budgets.select(*keys, F.floor(F.col("budget") / F.lit(length)).alias("__k"))
    run = _running(hist, keys, F.col("__v")).join(wanted, list(keys)).where("__upto - __mass < __k")
    cut = run.groupBy(*keys).agg(F.max("__v").alias("__cut"))
    return windows.join(cut, list(keys)).where(F.col(value) <= F.col("__cut")).drop("__cut")


def highest_until_budget(windows: DataFrame, budgets: DataFrame, keys: Sequence[str], width: int,
                         value: str = "cm") -> DataFrame:
    """Windows with ``value`` at least the first one, from the top, at which count * width reaches the budget.

    The value that crosses the budget is still kept; a budget above everything keeps all.
    """
    hist = windows.groupBy(*keys, F.col(value).alias("__v")).agg((F.count("*") * width).alias("__mass"))
    run = _running(hist, keys, F.desc("__v")).join(budgets.select(*keys, "budget"), list(keys))
    cut = run.where("__upto - __mass < budget").groupBy(*keys).agg(F.min("__v").alias("__cut"))
    return windows.join(cut, list(keys)).where(F.col(value) >= F.col("__cut")).drop("__cut")


def normalised_below_percentile(counts: DataFrame, keys: Sequence[str], series: str, window: Sequence[str],
                                percent: float, value: str = "n") -> DataFrame:
    """Windows whose sum over series of value / series total lies below the percentile (linear interpolation)."""
    totals = counts.groupBy(*keys, series).agg(F.sum(value).alias("__t"))
    mass = (
        counts.join(totals, [*keys, series]).groupBy(*keys, *window)
        .agg(F.sum(F.col(value) / F.col("__t")).alias("mass"))
    )
    cut = mass.groupBy(*keys).agg(F.percentile("mass", percent / 100.0).alias("__cut"))
    return mass.join(cut, list(keys)).where("mass < __cut").drop("__cut")


def from_midpoints(series: DataFrame, chrom: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Windows of ``width`` around midpoints, clamped at the sequence start; short sequences are left out."""
    start = F.greatest(F.col("midpoint") - F.lit(width // 2), F.lit(0))
    return series.join(chrom.where(F.col("length") >= width), list(keys)).withColumn("start", start).withColumn(
        "end", F.col("start") + width)


def combine_by_flag(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Distinct windows: those of flag 0, and those of flag 1 that overlap a flag-1 window of the other set."""
    span = ("start", "end")
    cols = [*keys, "start", "end"]
    one = lambda df: df.where("flag = 1").select(*cols).distinct()
    both = (
        interval_join(one(a), one(b), keys, span, span, width, how="left_semi", row_id=cols)
        .union(interval_join(one(b), one(a), keys, span, span, width, how="left_semi", row_id=cols))
    )
    free = a.where("flag = 0").select(*cols).union(b.where("flag = 0").select(*cols))
    return free.union(both).distinct()


def combine_any(windows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Windows of flag 0, and those of flag 1 that overlap a window of any other ``series``."""
    cols = [*keys, "series", "start", "end"]
    span = ("start", "end")
    own = windows.select(*cols, "flag").distinct()
    hit = interval_join(own.where("flag = 1").select(*cols), own.select(*cols), keys, span, span, width,
                        how="left_semi", extra=F.col("series") != F.col("r_series"), row_id=cols)
    return own.where("flag = 0").select(*cols).union(hit)


def merge_candidates(windows: DataFrame, chrom: DataFrame, keys: Sequence[str], gap: int = 100) -> DataFrame:
    """Windows at most ``gap`` apart united within their sequence, ends clamped to its last base."""
    inside = windows.join(chrom.select(*keys, "length"), list(keys)).where("start < length")
    clamped = inside.withColumn("end", F.least(F.col("end"), F.col("length") - 1))
    return merge_islands(clamped.select(*keys, "start", "end"), keys, gap=gap)


def reconcile(new: DataFrame, old: DataFrame, keys: Sequence[str], width: int, share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """New windows against existing candidates, set-wise: ``(windows to insert, candidates to delete)``.

    A new window inside a candidate is dropped; one that holds candidates absorbs them; one that
    overlaps a candidate by at most ``share`` of itself extends it; one that overlaps more is
    dropped.  A window inside or overlapping much counts as dropped whatever else it meets.  Inserted
    spans that then overlap unite.  ``id, start, end`` on both sides; half-open lengths.
    """
    cols = [*keys, "id", "start", "end"]
    met = interval_join(new.select(*cols), old.select(*cols), keys, ("start", "end"), ("start", "end"), width)
    inside = (F.col("r_start") <= F.col("start")) & (F.col("end") <= F.col("r_end"))
    holds = (F.col("start") <= F.col("r_start")) & (F.col("r_end") <= F.col("end")) & ~inside
    much = overlap_length(("start", "end"), ("r_start", "r_end")) / (F.col("end") - F.col("start")) > share
    judged = met.withColumn("drop", inside | (~holds & much))
    dropped = judged.where("drop").select(*keys, "id").distinct()
    live = judged.join(dropped, [*keys, "id"], "left_anti")
    gone = live.select(*keys, F.col("r_id").alias("id")).distinct()
    spans = (
        new.select(*cols).join(dropped, [*keys, "id"], "left_anti").select(*keys, "start", "end")
        .union(live.select(*keys, "r_start", "r_end"))
    )
    return merge_islands(spans, keys).select(*keys, "start", "end"), gone


def duplication_windows(freqs: DataFrame, keys: Sequence[str], length: int, pitch: int, x1: int, y1: float,
                        x2: int, y2: float, inclusive: bool = True) -> DataFrame:
    """Windows in which at least ``y1`` % of positions have 2 <= c1 <= x1 and under ``y2`` % have c2 > x2.

    ``freqs(keys, pos, c1, c2)``; starts are multiples of ``pitch``, windows must be complete.
    ``inclusive=False`` takes c1 < x1.  Each position is dealt to the windows that hold it and counted.
    """
    first = F.greatest(F.ceil((F.col("pos") - F.lit(length - 1)) / F.lit(pitch)), F.lit(0)).cast("long")
    at = F.explode(F.sequence(first, F.floor(F.col("pos") / F.lit(pitch)).cast("long")))
    one = (F.col("c1") >= 2) & ((F.col("c1") <= x1) if inclusive else (F.col("c1") < x1))
    return (
        freqs.where(first <= F.floor(F.col("pos") / F.lit(pitch))).select(*keys, "c1", "c2", at.alias("w"))
        .groupBy(*keys, (F.col("w") * pitch).alias("start"))
        .agg(F.count("*").alias("n"), F.count_if(one).alias("n1"), F.count_if(F.col("c2") > x2).alias("n2"))
        .where((F.col("n") == length) & (F.col("n1") * 100 >= y1 * F.col("n")) & (F.col("n2") * 100 < y2 * F.col("n")))
    )


def split_into_parts(sequences: DataFrame, length: str = "length", part: int = 300, gap: int = 100) -> DataFrame:
    """Parts of ``part`` bases ``gap`` apart; a part behind which less than part + gap remains takes the rest."""
    step = part + gap
    n = F.greatest(F.floor((F.col(length) - (2 * part + gap)) / F.lit(step)) + 1, F.lit(0))
    out = sequences.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))))
    start = F.col("part_no") * step
    return out.withColumns({
        "part_start": start,
        "part_end": F.when(F.col("part_no") == n, F.col(length)).otherwise(start + part)})


def kmer_counts(sequences: DataFrame, k: int, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """``(key, pos, kmer)`` of all k-mers without an N, and their number in all sequences as ``freq``."""
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length(seq) - (k - 1), F.lit(0))))
    mers = (
        sequences.where(F.length(seq) >= k).select(key, seq, at.alias("p"))
        .select(key, (F.col("p") - 1).alias("pos"), F.substr(F.col(seq), F.col("p"), F.lit(k)).alias("kmer"))
    )
    mers = mers.where(~F.upper("kmer").contains("N"))
    return mers.join(mers.groupBy("kmer").agg(F.count("*").alias("freq")), "kmer")


def kmer_counts_with_errors(sequences: DataFrame, k: int, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """As ``kmer_counts`` but ``freq`` counts k-mers within one mismatch.

    k-mers are first counted; each is filed under its k patterns with one letter left out, where
    the counts of all that agree elsewhere add up: no pairs of k-mers are formed.
    """
    exact = kmer_counts(sequences, k, key, seq)
    kinds = exact.select("kmer", "freq").distinct()
    hole = F.explode(F.sequence(F.lit(1), F.lit(k)))
    filed = kinds.select("kmer", "freq", hole.alias("h")).withColumn(
        "pattern", F.overlay("kmer", F.lit("."), F.col("h"), F.lit(1)))
    sums = filed.groupBy("pattern").agg(F.sum("freq").alias("t"))
    near = filed.join(sums, "pattern").groupBy("kmer").agg(
        (F.sum("t") - (k - 1) * F.first("freq")).alias("near"))  # itself is in all k patterns
    return exact.drop("freq").join(near.withColumnRenamed("near", "freq"), "kmer")


def complexity(sequences: DataFrame, width: int, pitch: int, k: int = 3, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """Windows with ``cm``: distinct k-mers over the most possible (a substitute for an external score)."""
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.length(seq) - width, F.lit(0)), F.lit(pitch)))
    win = sequences.where(F.length(seq) >= width).select(key, seq, start.alias("s")).select(
        key, (F.col("s") + width // 2).alias("midpoint"), F.substr(F.col(seq), F.col("s") + 1, F.lit(width)).alias("w"))
    mers = F.transform(F.sequence(F.lit(1), F.lit(width - k + 1)), lambda i: F.substr(F.col("w"), i, F.lit(k)))
    most = float(min(4**k, width - k + 1))
    return win.select(key, "midpoint", (F.size(F.array_distinct(mers)) / F.lit(most)).alias("cm"))
