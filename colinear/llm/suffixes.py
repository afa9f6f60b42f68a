"""Repeated passages through a sparse suffix array over content-selected positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small, spread_join, stored

_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_codes(text: bytes | None) -> np.ndarray:
    """64-bit hash of each white-space separated word, A-Z lower-cased."""
    import xxhash

    words = text.lower().split() if text else []
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * _ODD + codes[j : j + n]
        return _mix(h)


def minimisers(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the rightmost minimum of some ``w`` consecutive hashes.

    Equal runs select equal relative positions, so two texts that share w + k - 1 words both
    select at least one position in them.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    value, at, span = h, np.arange(len(h)), 1
    while span < w:
        s = min(span, w - span)
        left, right = value[: len(value) - s], value[s:]
        take = right <= left
        at = np.where(take, at[s:], at[: len(at) - s])
        value = np.where(take, right, left)
        span += s
    return np.unique(at)


def _seeds(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, b.num_rows, 1000):
                seed, doc, pos = [], [], []
                for d, text in zip(ids[at : at + 1000], b.column(1).slice(at, 1000).cast(pa.binary())):
                    h = grams(word_codes(text.as_py()), k)
                    p = minimisers(h, w)
                    seed.append(h[p])
                    pos.append(p.astype(np.int32))
                    doc.append(np.full(len(p), d, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(seed).view(np.int64)), pa.array(np.concatenate(doc)),
                     pa.array(np.concatenate(pos))], names=["seed", "text_key", "pos"])

    return run


def _contexts(k: int, least: int, rows_a_batch: int = 4096):
    """Texts with chosen positions -> one row each: the words right of and left of the position.

    A very long text is written in parts of ``rows_a_batch`` positions.
    """
    reach = least - k  # a run of ``least`` words around a k-gram goes this far left at most
    names = ["seed", "text_key", "pos", "low", "high", "right", "left"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]

            def batch() -> pa.RecordBatch:
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.binary(), pa.binary()]
                made = pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names=names)
                for o in out:
                    o.clear()
                return made

            for key, text, chosen in zip(b.column(0), b.column(1).cast(pa.binary()), b.column(2)):
                words = word_codes(text.as_py())
                every = np.sort(np.array(chosen.as_py(), np.int64))
                h = grams(words, k)
                none = np.full(reach, np.iinfo(np.uint64).max)
                around = np.concatenate([none, h, none])
                codes = np.maximum((words >> np.uint64(32)).astype(np.uint32), np.uint32(1))  # 0 is padding
                padded = np.concatenate([np.zeros(reach, np.uint32), codes, np.zeros(least, np.uint32)])
                for at in range(0, len(every), rows_a_batch):
                    pos = every[at : at + rows_a_batch]
                    rows = padded[pos[:, None] + np.arange(reach + least)[None, :]]
                    right, left = rows[:, reach:], rows[:, :reach][:, ::-1]
                    # the runs of ``least`` words of which this is the minimiser begin ``low`` to ``high`` words before it
                    near = around[pos[:, None] + np.arange(2 * reach + 1)[None, :]]
                    less = np.concatenate([near[:, :reach][:, ::-1] < h[pos][:, None], np.ones((len(pos), 1), bool)], axis=1)
                    more = np.concatenate([near[:, reach + 1 :] <= h[pos][:, None], np.ones((len(pos), 1), bool)], axis=1)
                    high = np.minimum(less.argmax(axis=1), pos)
                    low = np.maximum(reach - more.argmax(axis=1), reach - (len(h) - 1 - pos))
                    for o, x in zip(out, (
                            h[pos].view(np.int64).tolist(), [key.as_py()] * len(pos), pos.tolist(), np.maximum(low, 0).tolist(), high.tolist(),
                            [r.tobytes() for r in np.ascontiguousarray(right.byteswap())],
                            [r.tobytes() for r in np.ascontiguousarray(left.byteswap())])):
                        o += x
                    if len(out[0]) >= rows_a_batch:
                        yield batch()
            if out[0]:
                yield batch()

    return run


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of each pair of rows; padding (0) matches nothing."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _grid(rows: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), ">u4").reshape(len(rows), -1)


_PLAIN = ("seed", "c", "low", "high", "a", "z")
_CONTEXT = (*_PLAIN, "right", "left")
_REACH = ("far", "r", "l")


def _neighbours(least: int, by: str, edges: bool):
    """Sorted suffix classes -> what each shares with the nearest ones of another text on both sides.

    A class is what has the same words around it; ``a`` and ``z`` are its least and greatest text.  A class of several texts
    shares all its words.  ``far`` is the longest common run of words in the direction of the sort, which no
    suffix of another text exceeds; ``r`` and ``l`` are the farthest ends of matches of ``least`` words or more.  The last
    run of classes of one text is held until a class of another text follows.  With ``edges``, the first
    and the last run of a task go on as rows with contexts, for the joint between tasks.
    """

    def compare(rows: pa.Table, starts: np.ndarray, run: np.ndarray, a: int, z: int) -> pa.RecordBatch:
        seed = rows.column("seed").to_numpy()
        several = rows.column("a").to_numpy() != rows.column("z").to_numpy()
        grids = {c: _grid(rows, c) for c in ("right", "left")}
        own = np.arange(a, z)
        out = {c: np.zeros(z - a, np.int32) for c in _REACH}

        def found(at: np.ndarray, r: np.ndarray, l: np.ndarray) -> None:  # noqa: E741
            out["far"][at] = np.maximum(out["far"][at], r if by == "right" else l)
            ok = r + l >= least
            out["r"][at[ok]] = np.maximum(out["r"][at[ok]], r[ok])
            out["l"][at[ok]] = np.maximum(out["l"][at[ok]], l[ok])

        whole = own[several[a:z]]
        found(whole - a, *((grids[c][whole] != 0).sum(axis=1).astype(np.int32) for c in ("right", "left")))
        before, after = starts[run[own]] - 1, np.r_[starts[1:], len(seed)][run[own]]
        for other, there in ((before, before >= 0), (after, after < len(seed))):
            there = there & ~several[a:z]
            x, y = own[there], other[there]
            same = seed[x] == seed[y]
            x, y = x[same], y[same]
            found(x - a, *(_common(grids[c][x], grids[c][y]).astype(np.int32) for c in ("right", "left")))
        part = rows.slice(a, z - a)
        columns = [part.column(c).combine_chunks() for c in _PLAIN] + [pa.array(out[c]) for c in _REACH]
        columns += [pa.nulls(z - a, pa.binary())] * 2 if edges else []
        return pa.RecordBatch.from_arrays(columns, names=[*_PLAIN, *_REACH, *(_CONTEXT[-2:] if edges else ())])

    def edge(rows: pa.Table) -> pa.RecordBatch:
        own = [rows.column(c).combine_chunks() for c in _CONTEXT]
        return pa.RecordBatch.from_arrays(
            [*own[:-2], *[pa.nulls(len(rows), pa.int32())] * 3, *own[-2:]], names=[*_PLAIN, *_REACH, *_CONTEXT[-2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, head = None, 0, not edges  # ``known``: leading rows of ``held`` that are done with
        starts = number = None
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                rows = pa.Table.from_batches([b.slice(at, 20_000)]).select(list(_CONTEXT))
                rows = rows if held is None else pa.concat_tables([held, rows])
                seed, least_text, last_text = (rows.column(c).to_numpy() for c in ("seed", "a", "z"))
                several = least_text != last_text
                new = np.r_[True, (seed[1:] != seed[:-1]) | (least_text[1:] != least_text[:-1]) | several[1:] | several[:-1]]
                starts, number = np.flatnonzero(new), np.cumsum(new) - 1
                last = int(starts[-1])
                if not head and len(starts) > 1:
                    yield edge(rows.slice(0, int(starts[1]) + 1))
                    head = True
                if last > known:
                    yield compare(rows, starts, number, known, last)
                held, known = rows.slice(max(last - 1, 0)), min(last, 1)
                number = number[max(last - 1, 0) :] - number[max(last - 1, 0)]
                starts = np.array([0, 1][: int(number[-1]) + 1])
        if held is not None:
            yield compare(held, starts, number, known, len(held))
            if edges:
                yield edge(held)

    return run


def _beside(classes: DataFrame, by: str, least: int) -> DataFrame:
    """``(seed, c, low, high, far, r, l)`` by the order of the words to the right or to the left."""
    n = partitions(classes.sparkSession)
    order = ["seed", by, "left" if by == "right" else "right", "c"]
    form = "seed long, c long, low int, high int, a long, z long, far int, r int, l int"
    found = stored(
        classes.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*_CONTEXT)
        .mapInArrow(_neighbours(least, by, True), f"{form}, right binary, left binary"), "beside")
    # the first and last run of each task meet by seed
    seams = found.where("right is not null").select(*_CONTEXT).distinct().repartition(n, "seed").sortWithinPartitions(*order)
    return found.where("right is null").drop("right", "left").union(
        seams.select(*_CONTEXT).mapInArrow(_neighbours(least, by, False), form))


def _windows(least: int, k: int):
    """Classes with a range of offsets -> the hash of each asked run of ``least`` words around the seed."""
    reach = least - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.uint64(1)
        with np.errstate(over="ignore"):
            for _ in range(least):
                power = power * _ODD
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                rows = pa.Table.from_batches([b.slice(at, 4096)])
                seed, c, a, z, low, high, mask, mine = (rows.column(x).to_numpy() for x in ("seed", "c", "a", "z", "low", "high", "mask", "mine"))
                words = np.concatenate([_grid(rows, "left")[:, ::-1], _grid(rows, "right")], axis=1).astype(np.uint64)
                out = []
                with np.errstate(over="ignore"):
                    upto = np.zeros((len(words), words.shape[1] + 1), np.uint64)
                    for i, column in enumerate(words.T):
                        upto[:, i + 1] = upto[:, i] * _ODD + _mix(column + _ODD)
                    for j in range(reach + 1):
                        own = np.flatnonzero((low <= j) & (j <= high) & (mask >> j & 1 == 1))
                        h = _mix(upto[own, reach - j + least] - upto[own, reach - j] * power)
                        out.append((seed[own], np.full(len(own), j, np.int32), h.view(np.int64), c[own], a[own], z[own], mine[own] >> j & 1 == 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*out)], names=["seed", "j", "h", "c", "a", "z", "asks"])

    return run


def repeated_spans(docs: DataFrame, least_words: int = 50, gram: int = 8) -> DataFrame:
    """``(text_key, start, end)``: maximal runs of words in passages that several texts share.

    Texts count once each, by ``text_key`` = xxhash64(text) (whole copies: see ``repeats``).  Suffixes
    are kept at the minimisers of ``gram``-word hashes over windows that make every passage of
    ``least_words`` words hold one; those whose gram only one text has are done with.  What has
    the same words around it is one class.  Classes are sorted by the words to the right and once more by the words to the left;
    each is compared with the nearest one of another text on both sides and the match extended left and right.

    A class is settled if no other text can share more than its neighbours do: the longest match to the right
    and the one to the left are both part of matches of ``least_words``, or together too short for one.  What isn't
    settled (a partner may be next in neither order) is refined within its seed: it asks for the runs of
    ``least_words`` words at the offsets that are open, all classes of the seed name theirs, and runs that two texts have
    are matches.  Each run is asked for at its own minimiser only.  So no
    shared passage is lost.  A match longer than the context around one seed holds further seeds; overlapping
    matches of a text unite, which extends each passage to its true ends.

    A hot passage is one class; a hot seed is sorted over many tasks and its runs are counted by partial
    aggregation.  Memory: the classes of one text with one gram that follow each other in the order.
    """
    w = least_words - gram + 1
    own = docs.where("text is not null").select(F.xxhash64("text").alias("text_key"), "text")
    seeds = stored(own.mapInArrow(_seeds(gram, w), "seed long, text_key long, pos int"), "seeds")
    shared = seeds.groupBy("seed").agg(F.min("text_key").alias("a"), F.max("text_key").alias("z")).where("a <> z")
    again = stored(shared.select("seed"), "shared")  # a table of its own, so that a hot seed's join can be split
    places = stored(
        seeds.join(again, "seed", "left_semi").groupBy("text_key").agg(F.collect_set("pos").alias("places")), "places")
    # copies are dropped where they are read, so that a hot text sends one row a task, not all
    chosen = own.dropDuplicates(["text_key"]).join(places, "text_key").select("text_key", "text", "places")
    contexts = stored(chosen.mapInArrow(
        _contexts(gram, least_words),
        "seed long, text_key long, pos int, low int, high int, right binary, left binary").withColumn("c", F.xxhash64("right", "left")), "contexts")
    classes = stored(
        contexts.groupBy("seed", "c", "low", "high", "right", "left").agg(F.min("text_key").alias("a"), F.max("text_key").alias("z")), "classes")
    key = ["seed", "c"]
    none = F.lit(0).alias
    to_right, to_left = (_beside(classes, by, least_words) for by in ("right", "left"))
    reached = stored(
        to_right.select(*key, "low", "high", F.col("far").alias("fr"), none("fl"), "r", "l")
        .union(to_left.select(*key, "low", "high", none("fr"), F.col("far").alias("fl"), "r", "l"))
        .groupBy(*key).agg(*[F.max(x).alias(x) for x in ("low", "high", "fr", "fl", "r", "l")]), "reached")
    first, last = F.greatest("low", least_words - F.col("fr")), F.least("high", "fl")
    asked = F.when(first <= last, F.filter(F.sequence(first, last), lambda j: (j > F.col("l")) | (least_words - j > F.col("r"))))
    mask = F.aggregate(asked, F.lit(0).cast("long"), lambda m, j: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)))
    bounded = reached.where(first <= last).select(*key, first.alias("low"), last.alias("high"), F.coalesce(mask, F.lit(0)).cast("long").alias("mine"))
    masks = stored(bounded.where("mine <> 0").groupBy("seed").agg(F.bit_or("mine").alias("mask")), "asked")
    bounds = stored(bounded.join(small(masks, masks.count(), 16), "seed"), "bounds")
    windows = stored(
        classes.drop("low", "high").join(small(bounds, bounds.count(), 40), key)
        .select("seed", "c", "a", "z", "right", "left", "low", "high", "mask", "mine")
        .mapInArrow(_windows(least_words, gram), "seed long, j int, h long, c long, a long, z long, asks boolean"), "windows")
    run = ["seed", "j", "h"]
    twice = stored(
        windows.groupBy(*run).agg(F.min("a").alias("a"), F.max("z").alias("z"), F.bool_or("asks").alias("asks"))
        .where("asks and a <> z").select(*run), "twice")
    refined = windows.where("asks").join(twice, run, "left_semi").groupBy(*key).agg(
        F.max("j").alias("more_l"), F.max(least_words - F.col("j")).alias("more_r"))
    spans = stored(
        reached.join(refined, key, "left").select(
            *key, F.greatest("r", F.coalesce("more_r", F.lit(0))).alias("r"), F.greatest("l", F.coalesce("more_l", F.lit(0))).alias("l")).where("r > 0"), "spans")
    placed = spread_join(contexts.select("text_key", "pos", *key), spans, key, spans.count(), 24)
    each = placed.select("text_key", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("end")).distinct()
    order = Window.partitionBy("text_key").orderBy("start", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(upto < F.col("start"), F.lit(True)), 1).otherwise(0)
    run_ = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        each.withColumn("new", new).withColumn("run", run_).groupBy("text_key", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
    )


def repeats(docs: DataFrame, least_words: int = 50, gram: int = 8) -> DataFrame:
    """``(doc_id, start, end, whole boolean)``: the repeated passages of each row, in words from 0.

    A text that several rows have is one passage (``whole``) if it has ``least_words`` words.
    Clean rows have none.  Null and short texts have none; repeated rows each have theirs; other
    columns aren't read; very long texts are read whole, in parts; an empty table gives no rows.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n"))
    keyed = stored(keyed.where(F.col("n") >= least_words), "rows")
    copied = keyed.groupBy("text_key").agg(F.count("*").alias("copies")).where("copies > 1").select("text_key")
    whole = keyed.join(copied, "text_key", "left_semi").select(
        "doc_id", F.lit(0).alias("start"), F.col("n").cast("int").alias("end"), F.lit(True).alias("whole"))
    parts = repeated_spans(docs, least_words, gram)
    part = keyed.join(copied, "text_key", "left_anti").join(parts, "text_key").select(
        "doc_id", "start", "end", F.lit(False).alias("whole"))
    return whole.union(part)
