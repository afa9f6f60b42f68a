"""SimHash near-dedup through vantage-point trees in Hamming space."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import SPACE_WORD, ascii_lower, partitions, small, stored

BITS = 64


def majority(hashes: np.ndarray) -> np.ndarray:
    """The 64-bit word whose bit i is set if it is set in over half of ``hashes``."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def shingles(words: list[bytes], n: int) -> Iterator[bytes]:
    """Runs of ``n`` words, space-joined; fewer words than that make one, no words none."""
    if len(words) < n:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(n))))


def fingerprint(text: bytes | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash: bit i is set if it is set in over half the shingle hashes, repeats included.

    Words are split at ASCII white space after lower-casing A-Z.  Fewer words than a shingle
    has make one shingle; no words (or null) give 0.
    """
    import xxhash

    words = text.lower().split() if text else []
    return int(majority(np.fromiter(
        map(xxhash.xxh64_intdigest, shingles(words, words_per_shingle), repeat(seed)), np.uint64)))


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Hashes as another hash function would give them."""
    with np.errstate(over="ignore"):
        x = h + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_fingerprints(text: bytes | None, n: int, words_per_shingle: int) -> np.ndarray:
    """``n`` SimHashes of the distinct words under as many hash functions, then two of the distinct shingles."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(n + 2, np.uint64)
    single = np.fromiter(map(xxhash.xxh64_intdigest, set(words)), np.uint64)
    several = np.fromiter(map(xxhash.xxh64_intdigest, set(shingles(words, words_per_shingle))), np.uint64)
    return np.array([majority(_mixed(single, i)) for i in range(n)] + [majority(_mixed(several, i)) for i in range(2)], np.uint64)


def _map_texts(fields: Sequence[str], make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary())
            made = np.zeros((len(texts), len(fields)), np.uint64)
            for i, x in enumerate(texts):
                made[i] = make(x.as_py())
            rest = [i for i, n in enumerate(b.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in rest), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in made.T)],
                names=[*(b.schema.names[i] for i in rest), *fields])

    return run


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with the column ``text`` replaced by ``fp`` (the fingerprint's bits as a long)."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", "fp")]
    schema = T.StructType([*kept, T.StructField("fp", T.LongType())])
    return docs.select(*[f.name for f in kept], "text").mapInArrow(
        _map_texts(["fp"], lambda text: fingerprint(text, words_per_shingle, seed)), schema)


# -- one shard of fingerprints ------------------------------------------------------------


def vantage_hits(index: np.ndarray, queries: np.ndarray, radius: int,
                 leaf: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``(in queries, in index)`` of all pairs within ``radius``, through a vantage-point tree.

    A node halves its part of ``index`` at the median distance mu from a vantage point.  By the
    triangle inequality a query at distance d finds nothing in the inner half if d > mu + radius
    and nothing in the outer one if d <= mu - radius, so those branches are pruned.
    """
    stack = [(np.arange(len(index)), np.arange(len(queries)), 0)]
    while stack:
        own, asked, depth = stack.pop()
        if not len(own) or not len(asked):
            continue
        if len(own) > leaf:
            point = index[own[(len(own) * 7919 + depth * 104729) % len(own)]]
            d = np.bitwise_count(index[own] ^ point)
            mu = int(np.partition(d, len(d) // 2)[len(d) // 2])
            mu -= mu == d.max()  # the outer half isn't empty, unless all are equally far
            inner = d <= mu
            if inner.any():
                dq = np.bitwise_count(queries[asked] ^ point).astype(np.int16)
                stack += [(own[inner], asked[dq <= mu + radius], depth + 1),
                          (own[~inner], asked[dq > mu - radius], depth + 1)]
                continue
        step = max(1, (1 << 17) // len(own))
        for at in range(0, len(asked), step):
            q = asked[at : at + step]
            a, b = np.nonzero(np.bitwise_count(queries[q][:, None] ^ index[own][None, :]) <= radius)
            if len(a):
                yield q[a], own[b]


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of ``a`` and ``b`` pairwise; ``labels`` holds each place's root, the least of its set."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (more := labels[labels] != labels).any():
            labels[more] = labels[labels[more]]


def _stars(radius: int):
    """Links of a tile as stars: each fingerprint that is linked with the least of its set."""

    def tile(role: np.ndarray, ids: np.ndarray, fps: np.ndarray, rest: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        names, place = np.unique(ids, return_inverse=True)
        i, q = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        labels = np.arange(len(names))
        for a, b in vantage_hits(fps[i], fps[q], radius):
            unite(labels, place[q[a]], place[i[b]])
        linked = np.flatnonzero(labels != np.arange(len(names)))
        return names[linked], names[labels[linked]]

    return tile


def _nearest(radius: int, check_radius: int):
    """Links of a tile: each query with the most similar of the smaller ids and of the larger ones; the other texts met, each with itself.

    Similar is told by the two check words, within ``check_radius`` bits of their 128.
    """

    def tile(role: np.ndarray, ids: np.ndarray, fps: np.ndarray, rest: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        i, q = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        far = check_radius + 1
        best = np.full((2, len(ids)), far, np.int32)
        whom = np.zeros((2, len(ids)), np.int64)
        met = np.zeros(len(ids), bool)
        for a, b in vantage_hits(fps[i], fps[q], radius):
            a, b = q[a], i[b]
            d = sum(np.bitwise_count(r[a] ^ r[b]).astype(np.int32) for r in rest)
            ok = (d < far) & (ids[a] != ids[b])
            a, b, d = a[ok], b[ok], d[ok]
            met[b] = True
            for side, there in ((0, ids[b] < ids[a]), (1, ids[b] > ids[a])):
                x, y, z = a[there], b[there], d[there]
                order = np.lexsort([ids[y], z, x])
                x, y, z = x[order], y[order], z[order]
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)
                x, y, z = x[first], y[first], z[first]
                better = (z < best[side][x]) | ((z == best[side][x]) & (ids[y] < whom[side][x]))
                x, y, z = x[better], y[better], z[better]
                best[side][x], whom[side][x] = z, ids[y]
        found = [np.flatnonzero(best[side] < far) for side in (0, 1)]
        own = np.unique(ids[met])
        return np.concatenate([*(ids[f] for f in found), own]), np.concatenate([*(whom[s][f] for s, f in enumerate(found)), own])

    return tile


def _apart(radius: int, check_radius: int):
    """Rows of a tile -> stars over its pairs that ``_nearest`` may keep and whose texts have different ``group``."""

    def each(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        role, ids, group = (_column(parts, c) for c in ("role", "id", "group"))
        fps, one, two = (_column(parts, c).view(np.uint64) for c in ("fp", "check0", "check1"))
        names, place = np.unique(ids, return_inverse=True)
        i, q = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        labels = np.arange(len(names))
        for a, b in vantage_hits(fps[i], fps[q], radius):
            a, b = q[a], i[b]
            other = group[a] != group[b]
            a, b = a[other], b[other]
            d = np.bitwise_count(one[a] ^ one[b]).astype(np.int32) + np.bitwise_count(two[a] ^ two[b])
            unite(labels, place[a[d <= check_radius]], place[b[d <= check_radius]])
        linked = np.flatnonzero(labels != np.arange(len(names)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(names[labels[linked]]), pa.array(names[linked])], names=["src", "dst"])

    return _by_group(["shard", "tile"], each)


def forest(labels: np.ndarray, side: np.ndarray, checks: Sequence[np.ndarray], values: np.ndarray, sizes: np.ndarray,
           similarity: float, check_radius: int) -> Iterator[tuple[int, int]]:
    """Places ``(a, b)`` of pairs as similar as ``similarity`` that join all sets such pairs join, one pair a union.

    The set of place i is the next ``sizes[i]`` (one or more) of ``values``; ``labels`` are the sets joined before (changed
    here).  A pair has one place of ``side`` 0 and one of 1; side 2 is both.  Every such pair is compared whose ``checks``
    differ in at most ``check_radius`` bits, the nearest first, unless it is joined already or an exact bound rules it out: what
    two sets share is at least ``similarity`` times the larger one, and no more than either shares with all others.
    """
    values = np.unique(values, return_inverse=True)[1]
    at, left = np.repeat(np.arange(len(sizes)), sizes), np.ones(len(sizes), bool)
    for _ in range(16):  # each round may rule out more; those not ruled out are compared
        seen = np.bincount(values[left[at]], minlength=len(values) + 1)
        out = left & (np.bincount(at, seen[values] > 1, len(sizes)) < similarity * sizes - 1e-9)
        if not out.any():
            break
        left &= ~out
    start = np.cumsum(sizes) - sizes
    mark = np.zeros(len(values) + 1, bool)
    asked, searched = np.flatnonzero(left & (side != 1)), np.flatnonzero(left & (side != 0))
    bands = [-1, *(check_radius * i // 4 for i in range(1, 5))]
    for low, high in zip(bands, bands[1:]):
        for a in asked:
            b = searched[np.searchsorted(searched, a) :] if side[a] == 2 else searched
            b = b[labels[b] != labels[a]]
            d = sum(np.bitwise_count(c[b] ^ c[a]).astype(np.int32) for c in checks)
            b = b[(d > low) & (d <= high)]
            b = b[np.minimum(sizes[b], sizes[a]) >= similarity * np.maximum(sizes[b], sizes[a]) - 1e-9]
            if not len(b):
                continue
            own = values[start[a] : start[a] + sizes[a]]
            first = np.cumsum(sizes[b]) - sizes[b]
            mark[own] = True
            both = np.add.reduceat(mark[values[np.repeat(start[b] - first, sizes[b]) + np.arange(sizes[b].sum())]].astype(np.int64), first)
            mark[own] = False
            for x in b[both >= similarity * (sizes[a] + sizes[b] - both) - 1e-9]:
                if labels[x] != labels[a]:
                    labels[labels == labels[x]] = labels[a]
                    yield a, x


def _forests(similarity: float, check_radius: int):
    """Rows of a tile of a unit -> the edges of its ``forest``."""

    def each(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, group, side = (_column(parts, c) for c in ("id", "group", "side"))
        lists = [p.column(p.schema.get_field_index("s")) for p in parts]
        values = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists])
        sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]).astype(np.int64)
        checks = [_column(parts, c).view(np.uint64) for c in ("check0", "check1")]
        found = list(forest(np.unique(group, return_inverse=True)[1], side, checks, values, sizes, similarity, check_radius))
        if found:
            a, b = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], names=["src", "dst"])

    return _by_group(["unit", "tile"], each)


def _by_group(keys: Sequence[str], each):
    """Sorted rows -> what ``each`` gives for the rows of one value of ``keys`` after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(b.num_rows, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                now = tuple(c[a] for c in columns)
                if held and now != last:
                    yield from each(held)
                    held = []
                last = now
                held.append(b.slice(a, z - a))
        if held:
            yield from each(held)

    return run


def _column(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    at = parts[0].schema.get_field_index(name)
    return np.concatenate([p.column(at).to_numpy(zero_copy_only=False) for p in parts])


def _tile_links(tile, rest: Sequence[str]):
    def each(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [_column(parts, c).view(np.uint64) for c in ("fp", *rest)]
        src, dst = tile(_column(parts, "role"), _column(parts, "id"), words[0], words[1:])
        if len(src):
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return _by_group(["shard", "tile"], each)


# -- shards around vantage points ---------------------------------------------------------


def _assign(radius: int, rest: Sequence[str]):
    """Points (home -1) and rows of a shard -> rows by the cell they live in or must visit."""

    def each(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, ids = _column(parts, "home"), _column(parts, "id")
        fps = _column(parts, "fp").view(np.uint64)
        points = np.sort(fps[home < 0])
        shard = _column(parts, "shard")[0]
        more = [_column(parts, c) for c in rest]
        rows = np.flatnonzero(home >= 0)
        step = max(1, (1 << 22) // max(1, len(points)))
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            if not len(points):
                i, cell, lives = r, np.zeros(len(r), np.uint64), home[r]
            else:
                d = np.bitwise_count(fps[r][:, None] ^ points[None, :]).astype(np.int16)
                own = d.argmin(axis=1)
                reach = d[np.arange(len(r)), own] + np.where(home[r] > 0, radius, 2 * radius)
                a, b = np.nonzero(d <= reach[:, None])
                i, cell = r[a], points[b]
                lives = ((home[i] > 0) & (b == own[a])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), shard)), pa.array(cell.view(np.int64)), pa.array(lives.astype(np.int32)),
                 pa.array(ids[i]), pa.array(fps[i].view(np.int64)), *(pa.array(m[i]) for m in more)],
                names=["shard", "cell", "home", "id", "fp", *rest])

    return _by_group(["shard", "salt"], each)


def shards(rows: DataFrame, radius: int = 3, shard_rows: int = 2_048, max_points: int = 4_096,
           again: int = 16, max_levels: int = 6) -> DataFrame:
    """``rows(id long, fp long, ...)`` -> ``(shard, home, id, fp, ...)``: where each lives and visits.

    A tree of vantage points.  A shard that is too large draws a seeded sample of its own
    fingerprints as vantage points, about one for ``shard_rows`` and at most ``max_points``; each row
    lives (home 1) in the cell of the nearest one.  Of two rows within ``radius`` in different cells the
    one farther from its own point is, by the triangle bound, at most ``radius`` farther from the other's
    point than from its own: it visits (home 0) all such cells.  A visitor of a shard that is cut again
    visits the cells at most twice ``radius`` farther than the nearest.  So each pair within
    ``radius`` meets in a shard in which at least one of the two lives.  The first cut is made above
    ``2 * shard_rows`` rows, later ones above ``again * shard_rows``.
    """
    spark, rest = rows.sparkSession, [c for c in rows.columns if c not in ("id", "fp")]
    columns = ["shard", "home", "id", "fp", *rest]
    now = rows.select(F.pmod("id", F.lit(1)).cast("long").alias("shard"), F.lit(1).alias("home"), "id", "fp", *rest)  # all in shard 0
    for level in range(max_levels):
        wanted = F.least(F.ceil(F.col("n") / shard_rows), F.lit(max_points))
        sizes = stored(
            now.groupBy("shard").agg(F.sum("home").alias("n"), F.count("*").alias("total"))
            .where(F.col("n") > (2 if level == 0 else again) * shard_rows)
            .select("shard", F.col("n").cast("long").alias("n"), wanted.cast("long").alias("points"),
                    F.ceil(F.col("total") / F.greatest(F.lit(8192), 16 * wanted)).cast("int").alias("salts")), "sizes")
        n_large = sizes.count()
        if not n_large:
            break
        marked = now.join(small(sizes, n_large, 28), "shard", "left")
        large = marked.where("n is not null")
        chance = F.pmod(F.xxhash64("fp", F.lit(level)), F.lit(1 << 30)) * F.col("n") < (1 << 30) * F.col("points")
        points = (
            large.where((F.col("home") == 1) & chance).groupBy("shard", "fp").agg(F.first("salts").alias("salts"))
            .select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(-1).alias("home"),
                    F.lit(0).cast("long").alias("id"), "fp", *[F.lit(0).cast("long").alias(c) for c in rest])
        )
        dealt = large.select(
            "shard", F.pmod(F.xxhash64("id", "fp"), F.col("salts")).cast("int").alias("salt"), "home", "id", "fp", *rest)
        cells = (
            dealt.union(points).repartition(partitions(spark), "shard", "salt").sortWithinPartitions("shard", "salt")
            .mapInArrow(_assign(radius, rest), "shard long, cell long, home int, id long, fp long" + "".join(f", `{c}` long" for c in rest))
            .withColumn("shard", F.xxhash64("shard", F.lit(level), "cell")).select(*columns)
        )
        now = stored(marked.where("n is null").select(*columns).union(cells), "cells")
    return now


def _dealt(rows: DataFrame, radius: int, shard_rows: int, tile_queries: int, **how) -> DataFrame:
    """Rows of all shards in tiles of bounded size, each with what is asked (role 2) and what is searched (1)."""
    spark = rows.sparkSession
    placed = shards(rows, radius, shard_rows, **how)
    sizes = stored(
        placed.groupBy("shard").agg(F.sum("home").alias("n"), F.count("*").alias("total")).where("n > 0 and total > 1")
        .select("shard", F.ceil(F.col("n") / (2 * shard_rows)).cast("int").alias("across"),
                F.ceil(F.col("total") / tile_queries).cast("int").alias("down")), "tiles")
    met = placed.join(small(sizes, sizes.count(), 16), "shard")
    at = lambda tile, role: F.struct(tile.cast("int").alias("tile"), F.lit(role).cast("int").alias("role"))
    place = lambda salt, n: F.pmod(F.xxhash64("id", "fp", F.lit(salt)), F.col(n))
    none = F.array().cast("array<struct<tile:int,role:int>>")
    searched = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda j: at(place(1, "across") * F.col("down") + j, 1))
    asked = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda i: at(i * F.col("down") + place(2, "down"), 2))
    one = F.array(F.struct(F.lit(0).alias("tile"), (F.col("home") + 2).cast("int").alias("role")))
    copies = F.when((F.col("across") == 1) & (F.col("down") == 1), one).otherwise(
        F.concat(F.when(F.col("home") == 1, searched).otherwise(none), asked))
    rest = [c for c in rows.columns if c not in ("id", "fp")]
    return (
        met.withColumn("c", F.explode(copies)).select("shard", "c.tile", "c.role", "id", "fp", *rest)
        .repartition(partitions(spark), "shard", "tile").sortWithinPartitions("shard", "tile")
    )


def links(fps: DataFrame, radius: int = 3, shard_rows: int = 2_048, tile_queries: int = 32_768, **how) -> DataFrame:
    """Distinct ``fps(fp)`` -> edges ``(src, dst)`` whose components are those of all near pairs.

    Fingerprints are dealt to shards around vantage points (``shards``), oversized shards to tiles, and
    each tile is searched through a vantage-point tree.  A tile gives at most one edge for each of its
    fingerprints, so copies and dense groups give stars, never all their pairs.
    """
    rows = fps.select(F.col("fp").alias("id"), "fp")
    dealt = _dealt(rows, radius, shard_rows, tile_queries, **how)
    return dealt.mapInArrow(_tile_links(_stars(radius), []), "src long, dst long")


def near_groups(docs: DataFrame, radius: int = 3, words_per_shingle: int = 3, seed: int = 42,
                **how) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp, group, component_id)``, one row per row.

    Fingerprints that differ in at most ``radius`` bits link; ``group`` is the smallest linked
    fingerprint and ``component_id`` the smallest doc_id among the rows reachable.
    Null or empty text and text without words have fingerprint 0 and link like any other.
    Null doc_ids never become a component_id (null only if all reachable ones are null);
    repeated rows stay; other columns of ``docs`` are not read; an empty table gives no rows.
    Very long texts are hashed in parts of bounded size.
    """
    own = stored(fingerprints(docs.select("doc_id", "text"), words_per_shingle, seed), "fingerprints")
    first = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    groups = components(links(first.select("fp"), radius, **how))
    named = first.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("group"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    of_fp = named.select("fp", "group").join(least, "group")
    return own.join(of_fp, "fp").select("doc_id", "fp", "group", "component_id")


# -- documents ------------------------------------------------------------------------------


def near_texts(texts: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, hashes: int = 5,
               radius: int = 4, check_radius: int = 34, shard_rows: int = 2_048, tile_queries: int = 32_768,
               **how) -> DataFrame:
    """``texts(id long, text)`` -> edges ``(src, dst)`` of texts as similar as ``similarity``; rows of one id have one text.

    Candidates come from ``hashes`` SimHashes of the distinct words: texts that share 0.8 of their five-word
    shingles differ in few words, so at least one of the fingerprints is within ``radius`` bits.  In each
    tile a text keeps the most similar text of smaller and of larger id, told by 128 SimHash bits of the shingles (texts of
    Jaccard similarity 0.8 differ in 19 of them on average; ``check_radius`` is four deviations more).
    Every edge is then checked: the Jaccard similarity of the sets of shingles is at least ``similarity``.  Where
    texts met that those edges leave in different components, a second pass compares the texts so connected inside blocks
    of bounded size (``_between``), so no partner is lost: the components are those of all candidates that pass the check, and of other texts of
    such a block that pass it.  Pairs of the second pass are never rows: each pass gives at most a few edges a text.
    Texts without words are alike; fewer words than a shingle has are one shingle.
    """
    fields = [f"fp{i}" for i in range(hashes)] + ["check0", "check1"]
    made = stored(texts.select("id", "text").mapInArrow(
        _map_texts(fields, lambda text: word_fingerprints(text, hashes, words_per_shingle)),
        "id long" + "".join(f", {f} long" for f in fields)).dropDuplicates(["id"]), "sketches")

    def met(rows: DataFrame, tiles, *rest: str) -> DataFrame:
        found = None
        for i in range(hashes):
            dealt = _dealt(rows.select("id", F.col(f"fp{i}").alias("fp"), "check0", "check1", *rest), radius, shard_rows, tile_queries, **how)
            one = dealt.mapInArrow(tiles, "src long, dst long")
            one = stored(one.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "near")
            found = one if found is None else found.union(one)
        return found.distinct()

    seen = stored(met(made, _tile_links(_nearest(radius, check_radius), ["check0", "check1"])), "candidates")
    near = stored(_similar(texts, seen.where("src <> dst"), similarity, words_per_shingle), "links")
    ends = seen.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    group = components(near).select(F.col("node").alias("id"), "component")
    rows = stored(made.join(ends, "id", "left_semi").join(group, "id", "left").withColumn("group", F.coalesce("component", "id")), "met")
    units = components(met(rows, _apart(radius, check_radius), "group"))
    return near.union(stored(_between(texts, rows, units, similarity, words_per_shingle, check_radius), "rest"))


def _between(texts: DataFrame, rows: DataFrame, units: DataFrame, similarity: float, words_per_shingle: int, check_radius: int,
             block: int = 1 << 22, small_block: int = 1 << 18, small_blocks: int = 8) -> DataFrame:
    """Edges that join the groups of ``rows(id, group, check0, check1)`` in each unit of ``units(node, component)`` as all its similar pairs do.

    A unit is cut into blocks of about ``small_block`` shingles, from ``small_blocks`` of them on of up to ``block``;
    each two blocks meet in a tile.
    """
    spark = rows.sparkSession
    member = units.select(F.col("node").alias("id"), F.col("component").alias("unit"))
    n = member.count()
    sets = _sets(texts, member.select("id"), n, words_per_shingle)
    full = stored(
        rows.select("id", "group", "check0", "check1").join(small(member, n, 16), "id").join(sets, "id"), "units")
    total = F.sum(F.size("s"))
    cut = stored(full.groupBy("unit").agg(
        F.greatest(F.ceil(total / block), F.least(F.lit(small_blocks), F.ceil(total / small_block))).cast("int").alias("k")), "blocks")
    k, own = F.col("k"), F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct(
        (F.least(j, own) * k + F.greatest(j, own)).alias("tile"), F.when(j == own, 2).when(own < j, 0).otherwise(1).alias("side")))
    return (
        full.join(small(cut, cut.count(), 12), "unit").withColumn("t", F.explode(tiles))
        .select("unit", "t.tile", "t.side", "id", "group", "check0", "check1", "s")
        .repartition(partitions(spark), "unit", "tile").sortWithinPartitions("unit", "tile")
        .mapInArrow(_forests(similarity, check_radius), "src long, dst long")
    )


def _sets(texts: DataFrame, ids: DataFrame, n: int, words_per_shingle: int) -> DataFrame:
    """``(id, s)``: the hashed shingles of each text of ``ids(id)`` (``n`` counted), once each."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(SPACE_WORD), F.lit(0))
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - words_per_shingle, F.lit(0)))
    return stored(
        texts.select("id", "text").join(small(ids, n, 8), "id", "left_semi")
        .dropDuplicates(["id"]).select("id", words.alias("w"))  # a hot text sends one row a task
        .select("id", F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("w", i + 1, words_per_shingle)))).alias("s")), "sets")


def _similar(texts: DataFrame, edges: DataFrame, similarity: float, words_per_shingle: int) -> DataFrame:
    """``edges(src, dst)`` whose texts share ``similarity`` (Jaccard) of their sets of shingles."""
    ends = stored(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "ends")
    sets = _sets(texts, ends, ends.count(), words_per_shingle)
    both = F.size(F.array_intersect("a", "b"))
    return (
        edges.join(sets.select(F.col("id").alias("src"), F.col("s").alias("a")), "src")
        .join(sets.select(F.col("id").alias("dst"), F.col("s").alias("b")), "dst")
        .where(both >= similarity * (F.size("a") + F.size("b") - both) - 1e-9).select("src", "dst")
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each near group: the one of least doc_id (nulls last).

    Equal texts, and texts that ``near_texts`` links (five-word shingles, similarity 0.8 by default), are a group.
    Rows of the kept doc_id are told apart by their text; exact repeats of the kept row go too.
    Null text is a group of its own; texts without words are alike, so one of them stays.  Columns and
    texts are unchanged, whatever the other columns are named; an empty table gives no rows.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"))
    rows = stored(docs.select(key.alias("key"), F.xxhash64("text").alias("id")), "rows")
    first = stored(rows.groupBy("id").agg(F.min("key").alias("key")), "first")
    groups = components(near_texts(docs.select(F.xxhash64("text").alias("id"), "text"), **how))
    least = (
        first.join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
        .groupBy(F.coalesce("component", "id").alias("group")).agg(F.min(F.struct("key", "id")).alias("k"))
        .select(F.col("k.key.id").alias("__id"), F.col("k.id").alias("__h"))
    )
    marked = docs.withColumn("__h0", F.xxhash64("text"))
    kept = marked.join(
        least, marked["doc_id"].eqNullSafe(least["__id"]) & (marked["__h0"] == least["__h"]), "left_semi")
    if not rows.groupBy("key", "id").count().where("count > 1").isEmpty():  # rows repeat: texts are sorted then
        kept = kept.dropDuplicates(["doc_id", "__h0"])
    return kept.select(*docs.columns)
