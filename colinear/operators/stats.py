"""Descriptive statistics, group reports and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import best_first


def score_stats(df: DataFrame, by: Sequence[str], score: str = "score", length: str | None = None,
                extra: Sequence[Column] = ()) -> DataFrame:
    """Count, mean, median, sample deviation (null for one row) and summed length by ``by``."""
    aggs = [F.count("*").alias("n"), F.avg(score).alias("mean"), F.median(score).alias("median"),
            F.stddev_samp(score).alias("stdev"), *extra]
    if length:
        aggs.append(F.sum(length).alias("total_length"))
    return df.groupBy(*by).agg(*aggs)


def stats_with_total(df: DataFrame, by: str, score: str = "score", extra: Sequence[Column] = ()) -> DataFrame:
    """Detail rows and one summary row (``by`` null, ``is_total``) in one pass: a rollup."""
    return df.rollup(by).agg(
        (F.grouping(by) == 1).alias("is_total"), F.count("*").alias("n"), F.avg(score).alias("mean"),
        F.median(score).alias("median"), F.stddev_samp(score).alias("stdev"), *extra)


def coverage_percent(hits: DataFrame, sizes: DataFrame, by: Sequence[str], org: str, length: str = "length") -> DataFrame:
    """Summed hit length as a percentage of the organism's size."""
    total = hits.groupBy(*by).agg(F.sum(length).alias("aligned"))
    return total.join(F.broadcast(sizes), org).withColumn("percent", 100.0 * F.col("aligned") / F.col("size"))


def count_matrix(members: DataFrame, group: str, category: str, values: Sequence) -> DataFrame:
    """Groups by categories with a ``total``; ``values`` are the columns wanted."""
    wide = members.groupBy(group).pivot(category, list(values)).agg(F.count(F.lit(1))).na.fill(0)
    total = F.lit(0)
    for v in values:
        total = total + F.col(f"`{v}`")
    return wide.withColumn("total", total)


def single_copy(members: DataFrame, group: str, category: str) -> DataFrame:
    """Groups in which every category present occurs exactly once (absent ones don't matter)."""
    per = members.groupBy(group, category).agg(F.count("*").alias("__n"))
    return per.groupBy(group).agg((F.max("__n") == 1).alias("single_copy"), F.count("*").alias("n_categories"))


def size_ranked_ids(members: DataFrame, group: str, tie: str, prefix: str = "SOG", digits: int = 7) -> DataFrame:
    """``(group, size, group_id)``: numbered by size, largest first, ties by smallest member.

    Numbers come from counts by size and the rank within a size, so no task sorts all groups.
    """
    sized = members.groupBy(group).agg(F.count("*").alias("size"), F.min(tie).alias("__first"))
    run = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    # one row a distinct size
    before = sized.groupBy("size").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(run), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("size").orderBy("__first", group))
    out = sized.withColumn("__own", own).join(before.select("size", "__before"), "size")
    return out.select(group, "size", F.concat(F.lit(prefix), F.lpad((F.col("__before") + F.col("__own") - 1).cast("string"), digits, "0")).alias("group_id"))


def upper_median(values: Column) -> Column:
    """Element ``n // 2`` of the sorted array: of an even number the upper of the two in the middle."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) / F.lit(2)) + 1).cast("int"))


def waterfall(edges: DataFrame, stages: Sequence[str], chosen: str) -> DataFrame:
    """Edges alive after each boolean stage (all stages up to it true), all and ``chosen`` ones, and what each removes."""
    alive = F.lit(True)
    aggs = [F.count("*").alias("a0"), F.count_if(chosen).alias("c0")]
    for i, s in enumerate(stages, 1):
        alive = alive & F.col(s)
        aggs += [F.count_if(alive).alias(f"a{i}"), F.count_if(alive & F.col(chosen)).alias(f"c{i}")]
    one = edges.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"a{i}").alias("n_all"), F.col(f"c{i}").alias("n_chosen"),
                     (F.col(f"a{max(i - 1, 0)}") - F.col(f"a{i}")).alias("removed_all"), (F.col(f"c{max(i - 1, 0)}") - F.col(f"c{i}")).alias("removed_chosen"))
            for i, name in enumerate(["input", *stages])]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def endpoint_counts(edges: DataFrame, a: str, b: str, name: str = "species") -> DataFrame:
    """Number of edges at each end label."""
    return edges.select(F.explode(F.array(a, b)).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def connectivity(edges: DataFrame, node: str, partner: str) -> DataFrame:
    """Histogram: how many nodes have how many distinct partners."""
    per = edges.groupBy(node).agg(F.countDistinct(partner).alias("partners"))
    return per.groupBy("partners").agg(F.count("*").alias("nodes"))


def top_partners(edges: DataFrame, node: str, partner: str, keep: int = 3) -> DataFrame:
    """The ``keep`` most frequent partners of each node, with all that tie with the last."""
    per = edges.groupBy(node, partner).agg(F.count("*").alias("n"))
    w = Window.partitionBy(node).orderBy(F.desc("n"))
    return per.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= keep)


def best_by_total(parts: DataFrame, owner: str, item: str, length: str) -> DataFrame:
    """The item (transcript) of greatest summed part length for each owner; ties to the smaller item."""
    per = parts.groupBy(owner, item).agg(F.sum(length).alias("total"))
    return best_first(per, [owner], F.desc("total"), F.col(item))


def spans(parts: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Least start and greatest end of each id."""
    return parts.groupBy(*keys).agg(F.min(start).alias("start"), F.max(end).alias("end"))


def mostly(df: DataFrame, keys: Sequence[str], condition: Column, share: float = 0.5) -> DataFrame:
    """Keys of which at least ``share`` of the rows meet ``condition``."""
    return df.groupBy(*keys).agg((F.count_if(condition) / F.count("*")).alias("share")).where(F.col("share") >= share)


def orthogroup_report(members: DataFrame, all_genes: DataFrame, least_species: int = 2) -> DataFrame:
    """One row by group id: members and species as sorted lists, size, single-copy; unassigned genes last.

    ``members(group, gene_id, species)``, ``all_genes(gene_id, species)``.
    """
    ids = size_ranked_ids(members, "group", "gene_id")
    per = members.groupBy("group").agg(
        F.array_join(F.array_sort(F.collect_list("gene_id")), ",").alias("genes"),
        F.array_join(F.array_sort(F.collect_set("species")), ",").alias("species"),
        F.countDistinct("species").alias("n_species"))
    copies = single_copy(members, "group", "species").select("group", "single_copy")
    grouped = per.join(ids, "group").join(copies, "group").where(F.col("n_species") >= least_species).select(
        "group_id", "genes", "species", "size", "single_copy")
    inside = members.join(per.where(F.col("n_species") >= least_species).select("group"), "group", "left_semi").select("gene_id")
    rest = all_genes.join(inside, "gene_id", "left_anti").select(
        F.lit("unassigned").alias("group_id"), F.col("gene_id").cast("string").alias("genes"), F.col("species").cast("string").alias("species"),
        F.lit(1).cast("long").alias("size"), F.lit(False).alias("single_copy"))
    return grouped.unionByName(rest)


def not_selected(everything: DataFrame, selected: DataFrame, reasons: Sequence[tuple[str, Column]], key: str) -> DataFrame:
    """Counts by reason of what wasn't selected, with the accounting row ``total``.

    The first reason that holds counts; ``other`` if none; selected + not selected = total.
    """
    chosen = selected.select(key).distinct().withColumn("__in", F.lit(True))
    reason = F.lit("other")
    for name, cond in reversed(list(reasons)):
        reason = F.when(cond, name).otherwise(reason)
    rows = everything.join(chosen, key, "left").withColumn("reason", F.when(F.col("__in"), "selected").otherwise(reason))
    return rows.rollup("reason").agg(F.count("*").alias("n"), F.grouping("reason").alias("__g")).select(
        F.when(F.col("__g") == 1, "total").otherwise(F.col("reason")).alias("reason"), "n")
