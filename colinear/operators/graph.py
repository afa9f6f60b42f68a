"""Graph operators on edge tables; iterative ones store each round in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .intervals import interval_join, merge_islands


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``(node, component)``: the component is its smallest node.

    In each round a node goes to the root it reaches by steps to its smallest neighbour, in jumps that double, and the
    edges go along: those inside a component vanish and equal ones are one, so later rounds join only the edges that are
    still open, never all of them again.  Nodes may be of any orderable type; null ends are left out, a loop gives its node.
    """
    ends = F.col(src), F.col(dst)
    rest = stored(edges.where(ends[0].isNotNull() & ends[1].isNotNull()).select(
        F.least(*ends).alias("u"), F.greatest(*ends).alias("v")).distinct(), "edges")
    labels = None
    for _ in range(max_rounds):
        up = _roots(rest.select(F.col("u").alias("node"), F.col("u").alias("component")).union(rest.select("v", "u")))
        to = lambda node, component: up.select(F.col("node").alias(node), F.col("component").alias(component))
        labels = up if labels is None else stored(labels.join(to("component", "root"), "component", "left").select(
            "node", F.coalesce("root", "component").alias("component")), "labels")
        rest = stored(rest.join(to("u", "a"), "u").join(to("v", "b"), "v").where("a <> b").select(
            F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        if rest.isEmpty():
            return labels
    raise RuntimeError(f"components still meet after {max_rounds} rounds")


def _roots(steps: DataFrame) -> DataFrame:
    """``steps(node, component)`` -> where the steps to the least component of each node end; every component is a node."""
    up = stored(steps.groupBy("node").agg(F.min("component").alias("component")), "steps")
    while True:
        above = up.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jump = stored(up.join(above, "component").select("node", "component", "above"), "steps")
        up = jump.select("node", F.col("above").alias("component"))
        if jump.where("above <> component").isEmpty():
            return up


def with_species(members: DataFrame, least: int = 2, group: str = "component", species: str = "species") -> DataFrame:
    """Members of groups that span at least ``least`` species."""
    ok = members.groupBy(group).agg(F.countDistinct(species).alias("__n")).where(F.col("__n") >= least).select(group)
    return members.join(ok, group, "left_semi")


def transitive_pairs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Cross-species pairs of one component that no edge joins: ``members(node, component, species)``."""
    b = members.select(F.col("node").alias("dst"), "component", F.col("species").alias("sp2"))
    pairs = members.select(F.col("node").alias("src"), "component", F.col("species").alias("sp1")).join(b, "component").where(
        "src < dst and sp1 <> sp2").select("component", "src", "dst")
    direct = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return pairs.join(direct, ["src", "dst"], "left_anti")


def dbscan_1d(points: DataFrame, keys: Sequence[str], eps: int, least: int = 4, pos: str = "pos") -> DataFrame:
    """``points`` with ``region``: density clusters on a line; noise is left out.

    A core point has at least ``least`` points (itself included) within ``eps``; cores at most
    ``eps`` apart are one region; other points within ``eps`` of a core join it (the region to
    their left, if both sides have one).
    """
    at = Window.partitionBy(*keys).orderBy(pos)
    near = at.rangeBetween(-eps, eps)
    cored = points.withColumn("__core", F.when(F.count("*").over(near) >= least, F.col(pos)))
    before = at.rangeBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("__core").isNotNull() & (F.coalesce(F.col("__core") - F.col("__last"), F.lit(eps + 1)) > eps), 1).otherwise(0)
    flagged = cored.withColumn("__last", F.max("__core").over(before))
    # equal positions are all core or none, and only the first of them opens a region
    first = F.row_number().over(Window.partitionBy(*keys, pos).orderBy(F.lit(0)))
    flagged = flagged.withColumn("__new", F.when(first == 1, new).otherwise(0))
    run = at.rangeBetween(Window.unboundedPreceding, 0)
    numbered = flagged.withColumn("__no", F.sum("__new").over(run)).withColumn(
        "__next", F.min("__core").over(at.rangeBetween(1, Window.unboundedFollowing)))
    region = (
        F.when(F.col("__core").isNotNull(), F.col("__no"))
        .when(F.col(pos) - F.col("__last") <= eps, F.col("__no"))
        .when(F.col("__next") - F.col(pos) <= eps, F.col("__no") + 1))
    return numbered.withColumn("region", region).where("region is not null").select(*points.columns, "region")


def region_bounds(clustered: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    return clustered.groupBy(*keys, "region").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("n"))


def grow_regions(seeds: DataFrame, links: DataFrame, eps: int, least: int, margin: int, rounds: int = 3,
                 width: int = 1 << 20) -> DataFrame:
    """Regions found from ``seeds(org, seqid, start, end)`` through ``links(org1, seqid1, pos1, org2, seqid2, pos2)``.

    In each round the anchors in the new regions lead to positions in other organisms, which are
    clustered; clusters farther than ``margin`` from every known region are the next round's new
    ones.  Ends early if there are none.  Each round is stored.
    """
    keys = ["org", "seqid"]
    known = stored(seeds.select(*keys, "start", "end").withColumn("round", F.lit(0)), "regions")
    fresh = known
    for i in range(1, rounds + 1):
        hits = interval_join(
            links.select(F.col("org1").alias("org"), F.col("seqid1").alias("seqid"), F.col("pos1").alias("p0"),
                         (F.col("pos1") + 1).alias("p1"), "org2", "seqid2", "pos2"),
            fresh.select(*keys, "start", "end"), keys, ("p0", "p1"), ("start", "end"), width)
        points = hits.select(F.col("org2").alias("org"), F.col("seqid2").alias("seqid"), F.col("pos2").alias("pos")).distinct()
        found = region_bounds(dbscan_1d(points, keys, eps, least), keys).drop("n", "region")
        far = interval_join(
            found.withColumns({"lo": F.col("start") - margin, "hi": F.col("end") + margin}),
            known.select(*keys, F.col("start").alias("k0"), F.col("end").alias("k1")), keys, ("lo", "hi"), ("k0", "k1"),
            max(width, margin), how="left_anti", row_id=[*keys, "start", "end"])
        fresh = stored(far.select(*keys, "start", "end").withColumn("round", F.lit(i)), "regions")
        if fresh.isEmpty():
            break
        known = stored(known.unionByName(fresh), "regions")
    return known


def region_weights(regions: DataFrame, links: DataFrame, width: int = 1 << 20) -> DataFrame:
    """``(a, b, weight)``: number of links between two regions ``(region_id, org, seqid, start, end)``."""
    keys = ["org", "seqid"]
    side = lambda i: links.select(
        "link_id", F.col(f"org{i}").alias("org"), F.col(f"seqid{i}").alias("seqid"), F.col(f"pos{i}").alias("p0"), (F.col(f"pos{i}") + 1).alias("p1"))
    at = lambda i, name: interval_join(
        side(i), regions, keys, ("p0", "p1"), ("start", "end"), width).select("link_id", F.col("region_id").alias(name))
    met = at(1, "x").join(at(2, "y"), "link_id").where("x <> y")
    return met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.countDistinct("link_id").alias("weight"))


def homology_edges(hits: DataFrame, least: float = 40.0) -> DataFrame:
    """Undirected edges of hits with at least ``least``, best score each, no self hits."""
    return (
        hits.where((F.col("score") >= least) & (F.col("src") != F.col("dst")))
        .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("score").alias("score"))
    )


def union_graph(graphs: Sequence[DataFrame], attributes: Sequence[str]) -> DataFrame:
    """Edges of all graphs once; attributes of later graphs win."""
    tagged = [g.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *attributes,
                       F.lit(i).alias("__from")) for i, g in enumerate(graphs)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("src", "dst").agg(F.max(F.struct("__from", *attributes)).alias("__s")).select(
        "src", "dst", *[F.col(f"__s.{a}").alias(a) for a in attributes])


def shared_element_edges(members: DataFrame, block: str = "block_id", element: str = "element") -> DataFrame:
    """Pairs of blocks that share an element, as a chain through each element's blocks.

    Blocks of one element are linked in a row (not in all pairs), which gives the same
    components and stays linear for an element that very many blocks hold.
    """
    own = members.select(F.col(block).alias("b"), F.col(element).alias("e")).distinct()
    nxt = F.lead("b").over(Window.partitionBy("e").orderBy("b"))
    return own.withColumn("dst", nxt).where("dst is not null").select(F.col("b").alias("src"), "dst").distinct()


def shared_element_pairs(members: DataFrame, block: str = "block_id", element: str = "element") -> DataFrame:
    """All pairs of blocks that share an element, with how many they share."""
    own = members.select(F.col(block).alias("src"), F.col(element).alias("e")).distinct()
    return own.join(own.withColumnRenamed("src", "dst"), "e").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("shared"))


def overlapping_block_edges(spans: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pairs of blocks whose spans overlap on some sequence."""
    met = interval_join(spans, spans, keys, ("start", "end"), ("start", "end"), width,
                        extra=F.col("block_id") < F.col("r_block_id"))
    return met.select(F.col("block_id").alias("src"), F.col("r_block_id").alias("dst")).distinct()


def markers(members: DataFrame) -> DataFrame:
    """``members(cluster, species, chrom, start, end)`` -> extent by cluster and species on its main chromosome.

    The chromosome with most members wins, the smaller name on ties.
    """
    per = members.groupBy("cluster", "species", "chrom").agg(
        F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    top = F.min_by(F.struct("chrom", "n", "start", "end"), F.struct(-F.col("n"), F.col("chrom")))
    return per.groupBy("cluster", "species").agg(top.alias("t")).select("cluster", "species", "t.*")


def add_singletons(clusters: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(cluster, block_id)`` with a cluster of its own for each block in none."""
    rest = blocks.select("block_id").distinct().join(clusters.select("block_id"), "block_id", "left_anti")
    return clusters.select("cluster", "block_id").unionByName(rest.select(F.col("block_id").alias("cluster"), "block_id"))


def best_edges(anchors: DataFrame, least: float) -> DataFrame:
    """Best score of each unordered pair, from ``least`` on."""
    return anchors.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.max("score").alias("score")).where(F.col("score") >= least)


def shared_length_distance(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """1 - (own-side hit lengths in both directions) / (sum of both sizes): ``hits(org1, org2, length)``, ``sizes(org, size)``."""
    mass = hits.groupBy(F.least("org1", "org2").alias("a"), F.greatest("org1", "org2").alias("b")).agg(F.sum("length").alias("m"))
    s1, s2 = (sizes.select(F.col("org").alias(x), F.col("size").alias(f"size_{x}")) for x in ("a", "b"))
    return mass.join(F.broadcast(s1), "a").join(F.broadcast(s2), "b").select(
        "a", "b", (1 - F.col("m") / (F.col("size_a") + F.col("size_b"))).alias("distance"))


def score_distance(scores: DataFrame, orgs: DataFrame) -> DataFrame:
    """1 - S12 / mean(S1, S2) of summed scores; pairs without any have 1: ``scores(org1, org2, score)`` of unordered pairs."""
    s = scores.select(F.least("org1", "org2").alias("a"), F.greatest("org1", "org2").alias("b"), "score").groupBy("a", "b").agg(F.sum("score").alias("s"))
    own = s.where("a = b").select(F.col("a").alias("o"), F.col("s").alias("own"))
    x, y = orgs.select(F.col("org").alias("a")), orgs.select(F.col("org").alias("b"))
    pairs = x.crossJoin(F.broadcast(y)).where("a < b")  # a matrix of organisms, small by nature
    return (
        pairs.join(s, ["a", "b"], "left").join(own.select(F.col("o").alias("a"), F.col("own").alias("oa")), "a", "left")
        .join(own.select(F.col("o").alias("b"), F.col("own").alias("ob")), "b", "left")
        .select("a", "b", F.coalesce(1 - F.col("s") / ((F.col("oa") + F.col("ob")) / 2), F.lit(1.0)).alias("distance"))
    )


def propagate_orientation(edges: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Orientation (1 or -1) of each node reached from ``roots(node)``, along ``edges(src, dst, sign)``.

    Breadth first: a node takes the majority of the products over the edges from the round before
    (+1 on a tie).  Each round is stored; rounds end when no new node is reached.
    """
    both = stored(edges.select("src", "dst", "sign").union(edges.select("dst", "src", "sign")), "edges")
    done = stored(roots.select("node", F.lit(1).alias("orientation"), F.lit(0).alias("depth")), "orient")
    front = done
    for depth in range(1, max_rounds + 1):
        votes = (
            both.join(front.select(F.col("node").alias("src"), "orientation"), "src")
            .join(done.select(F.col("node").alias("dst")), "dst", "left_anti")
            .groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("orientation") * F.col("sign")).alias("v"))
        )
        front = stored(votes.select("node", F.when(F.col("v") >= 0, 1).otherwise(-1).alias("orientation"), F.lit(depth).alias("depth")), "orient")
        if front.isEmpty():
            break
        done = done.unionByName(front)
    return done


def clusters_by_shared(members: DataFrame) -> DataFrame:
    """Groups united as long as they share an element: ``(element, group)`` -> ``(group, cluster)``."""
    chain = shared_element_edges(members, "group", "element")
    comp = components(chain)
    own = members.select("group").distinct()
    return own.join(comp.withColumnRenamed("node", "group"), "group", "left").select(
        "group", F.coalesce("component", "group").alias("cluster"))


def merge_fragments(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlapping fragments united; colours that meet in one interval become one colour set.

    ``fragments(keys, start, end, colour)`` -> ``(keys, start, end, colour_set)``.
    """
    merged = merge_islands(fragments, keys, aggs=[F.array_sort(F.collect_set("colour")).alias("colours")])
    pairs = merged.select(F.col("colours")[0].alias("src"), F.explode("colours").alias("dst"))
    comp = components(pairs)
    return merged.withColumn("node", F.col("colours")[0]).join(comp, "node").select(*keys, "start", "end", F.col("component").alias("colour_set"))


# -- scaffolding ---------------------------------------------------------------------------


def assign_by_mass(hits: DataFrame, contig: str = "contig", target: str = "chrom", score: str | None = "score") -> DataFrame:
    """Target of the largest summed score of each contig (number of hits without ``score``)."""
    mass = F.sum(score) if score else F.count("*").cast("double")
    per = hits.groupBy(contig, target).agg(mass.alias("mass"))
    return per.groupBy(contig).agg(F.min_by(F.struct(target, "mass"), F.struct(-F.col("mass"), F.col(target))).alias("t")).select(contig, "t.*")


def order_along_reference(hits: DataFrame, contig: str = "contig", target: str = "chrom", pos: str = "pos") -> DataFrame:
    """Contigs on the target with most of their hits, in the order of their middle hit there.

    ``(target, contig, mass, at, position)``: ``at`` is the lower median of the hits' positions, ``position`` runs from 1.
    """
    placed = assign_by_mass(hits, contig, target, None)
    at = hits.join(placed, [contig, target]).groupBy(target, contig, "mass").agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{pos}`)").cast("long").alias("at"))
    return at.withColumn("position", F.row_number().over(Window.partitionBy(target).orderBy("at", contig)))


def half_mass_positions(hits: DataFrame, contig: str = "contig", target: str = "chrom", pos: str = "pos", score: str = "score") -> DataFrame:
    """First position along a target at which a contig has gathered half of its score there."""
    key = [contig, target]
    order = Window.partitionBy(*key).orderBy(pos)
    run = hits.withColumn("__run", F.sum(score).over(order)).withColumn("__all", F.sum(score).over(Window.partitionBy(*key)))
    return run.where(F.col("__run") * 2 >= F.col("__all")).groupBy(*key).agg(F.min(pos).alias("at"))


def orientations(hits: DataFrame, keys: Sequence[str], forward: Column, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Majority orientation (forward only if strictly more) and whether it is mixed (share within low..high)."""
    n, f = F.count("*"), F.count_if(forward)
    return hits.groupBy(*keys).agg(
        F.when(f * 2 > n, "forward").otherwise("reverse").alias("orientation"),
        ((f / n >= low) & (f / n <= high)).alias("divergent"), n.alias("n"))


def divergent_contigs(hits: DataFrame, contig: str, target: str, share: float = 0.2) -> DataFrame:
    """Contigs with at least ``share`` of their hits on more than one target."""
    per = hits.groupBy(contig, target).agg(F.count("*").alias("__n"))
    total = per.groupBy(contig).agg(F.sum("__n").alias("__t"))
    return per.join(total, contig).where(F.col("__n") >= share * F.col("__t")).groupBy(contig).agg(
        F.count("*").alias("n_targets")).where("n_targets > 1")


def adjacency(placed: DataFrame, keys: Sequence[str], order: Sequence[str], contig: str = "contig", orientation: str = "orientation") -> DataFrame:
    """Edges between the ends that face each other in a placement: ``(left, left_end, right, right_end)``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    nxt, nxt_o = F.lead(contig).over(w), F.lead(orientation).over(w)
    tail = lambda o: F.when(o == "forward", "tail").otherwise("head")
    head = lambda o: F.when(o == "forward", "head").otherwise("tail")
    return placed.select(
        *keys, F.col(contig).alias("left"), tail(F.col(orientation)).alias("left_end"), nxt.alias("right"), head(nxt_o).alias("right_end")
    ).where("right is not null")


def merge_reference_edges(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Adjacencies of all references as one graph: minus the summed weight x count of each edge."""
    node = lambda a, b: F.concat_ws(":", a, b)
    e = edges.join(F.broadcast(weights), "ref").select(
        F.least(node("left", "left_end"), node("right", "right_end")).alias("src"),
        F.greatest(node("left", "left_end"), node("right", "right_end")).alias("dst"), "weight")
    return e.groupBy("src", "dst").agg((-F.sum("weight")).alias("weight"))


def complete_edges(edges: DataFrame) -> DataFrame:
    """``edges`` with weight-0 edges for every other pair of nodes (contig ends, few by nature)."""
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct()
    pairs = nodes.select(F.col("n").alias("src")).crossJoin(F.broadcast(nodes.select(F.col("n").alias("dst")))).where("src < dst")
    return edges.unionByName(pairs.join(edges, ["src", "dst"], "left_anti").withColumn("weight", F.lit(0.0)))


def reference_weights(aligned: DataFrame, most: float = 1e5) -> DataFrame:
    """Summed aligned length by reference, divided by the power of 10 that brings the largest to ``most``, at least 1."""
    total = aligned.groupBy("ref").agg(F.sum("length").cast("double").alias("total"))
    top = total.agg(F.max("total").alias("top"))
    power = F.greatest(F.ceil(F.log10(F.col("top") / most)), F.lit(0))
    return total.crossJoin(F.broadcast(top)).select("ref", F.greatest(F.col("total") / F.pow(F.lit(10.0), power), F.lit(1.0)).alias("weight"))
