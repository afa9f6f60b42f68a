"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 22
_CACHE_TOKENS = 300_000
_EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


class Featurizer:
    """Distinct hashed features of a whole text: its words and their stems, and how much of it looks like what."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.cache: dict[bytes, tuple[tuple[int, ...], int]] = {}
        # a share switches on all levels up to its own, so that weights add up along it
        self.levels = [[self._index(f"share:{i}:{k}") for k in range(1, 13)] for i in range(8)]

    def _index(self, name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "replace")) % self.dimensions

    def _token(self, tok: bytes) -> tuple[tuple[int, ...], int]:
        text = tok.decode("utf-8", "replace")
        core = text.strip(_EDGE)
        tail = len(text) - len(text.rstrip(_EDGE))
        kind = (
            (len(core) > 1 and core.isupper()) | (tail > 1) << 1 | any(c.isdigit() for c in core) << 2
            | (not core) << 3 | (len(core) > 18) << 4)
        if len(self.cache) >= _CACHE_TOKENS:
            self.cache.clear()
        low = core.lower()
        names = [f"word:{low}", *(f"stem:{low[:k]}" for k in (5, 7) if len(low) >= k)]
        found = self.cache[tok] = (tuple(map(self._index, names)), int(kind))
        return found

    def __call__(self, text: bytes | None) -> np.ndarray:
        row = (text or b"").split()
        n = len(row)
        if not n:
            return np.zeros(0, np.int64)
        counts, cache, ids, kinds = Counter(row), self.cache, set(), [0] * 32
        for tok, c in counts.items():
            index, kind = cache.get(tok) or self._token(tok)
            ids.update(index)
            if kind:
                kinds[kind] += c
        shares = [sum(c for k, c in enumerate(kinds) if k >> bit & 1) / n for bit in range(5)]
        shares += [sum(map(operator.eq, row, row[1:])) / n, max(counts.values()) / n, len(counts) / n]
        for level, share in zip(self.levels, shares):
            ids.update(level[: round(12 * math.sqrt(share))])
        ids.add(self._index(f"length:{n.bit_length()}"))
        return np.fromiter(ids, np.int64, len(ids))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . x): one weight vector, ordered thresholds."""

    ids: np.ndarray  # features with a weight, sorted
    weights: np.ndarray
    thresholds: np.ndarray
    dimensions: int = DIMENSIONS

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, least_docs: int = 8, rounds: int = 150,
        rate: float = 0.1, ridge: float = 1e-3, dimensions: int = DIMENSIONS) -> OrdinalModel:
    """Maximum likelihood of the cumulative logits with an L2 penalty, by Adam with falling steps.

    Features in fewer than ``least_docs`` rows get no weight.  Without rows every score is
    above every threshold: nothing is known against any text.
    """
    if not rows:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.full(n_grades - 1, -500.0), dimensions)
    flat = np.concatenate(rows)
    seen, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    keep = counts >= least_docs
    col = (np.cumsum(keep) - 1)[inverse]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ok = keep[inverse]
    col, row, n, m = col[ok], row[ok], len(rows), int(keep.sum())
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    # theta_0, then log gaps: the thresholds stay ordered
    p = np.concatenate([np.zeros(m), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    bounds = lambda p: np.cumsum(np.r_[p[m], np.exp(p[m + 1 :])])
    for t in range(1, rounds + 1):
        w, theta = p[:m], bounds(p)
        s = np.bincount(row, w[col], n)
        edges = np.concatenate([np.full((n, 1), -np.inf), theta[None, :] - s[:, None], np.full((n, 1), np.inf)], 1)
        cdf = 1 / (1 + np.exp(-np.clip(edges, -500, 500)))
        high, low = cdf[np.arange(n), grades + 1], cdf[np.arange(n), grades]
        mass = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high) / mass, low * (1 - low) / mass  # d log mass / d edge
        ds = (dh - dl) / n  # minus d log-likelihood / d edge, turned to the score's sign
        g = np.zeros_like(p)
        g[:m] = np.bincount(col, ds[row], m) + ridge * w
        g_theta = np.array([dl[grades == k + 1].sum() - dh[grades == k].sum() for k in range(n_grades - 1)]) / n
        back = np.cumsum(g_theta[::-1])[::-1]  # threshold k moves all that follow
        g[m] = back[0]
        g[m + 1 :] = back[1:] * np.exp(p[m + 1 :])
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        p -= rate * (1 - (t - 1) / rounds) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(seen[keep], p[:m].copy(), bounds(p), dimensions)


def _rows(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(dimensions)
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([features(x.as_py()).astype(np.int32) for x in texts], pa.list_(pa.int32()))],
                names=["grade", "ids"])

    return run


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, max_train: int = 8_000, seed: int = 3,
          **how) -> OrdinalModel:
    """Fits on at most ``max_train`` rated documents, chosen by a seeded hash of doc_id.

    ``ratings(doc_id, grade int 0..n_grades-1)``; rows with a null are not used.  A doc_id counts once: with its
    lowest grade, and of several texts with the one of least hash, so at most ``max_train`` rows of
    hashed features reach the driver.  Without ratings or texts nothing is known against any text; other
    columns aren't read.
    """
    sample = (
        ratings.select("doc_id", "grade").where("doc_id is not null and grade is not null")
        .groupBy("doc_id").agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_train)
    )
    rated = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null")
        .groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
        .select("grade", F.col("t.text").alias("text"))
    )
    got = rated.select("grade", "text").mapInArrow(_rows(DIMENSIONS), "grade int, ids array<int>").toArrow().combine_chunks()
    grades = got["grade"].to_numpy().astype(np.int64)
    if not len(grades):
        return fit([], grades, n_grades, **how)
    lists = got["ids"].combine_chunks()
    ends = np.cumsum(np.asarray(pa.compute.list_value_length(lists)))
    rows = np.split(lists.flatten().to_numpy().astype(np.int64), ends[:-1])
    order = np.lexsort([[int(r.sum()) for r in rows], [len(r) for r in rows], grades])  # reruns agree
    return fit([np.sort(rows[i]) for i in order], grades[order], n_grades, **how)


def _scores(ids: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, dimensions: int):
    model = OrdinalModel(ids, weights, thresholds, dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, dense = Featurizer(dimensions), np.zeros(dimensions, np.float32)
        dense[model.ids] = model.weights
        for b in batches:
            at = b.schema.get_field_index("text")
            rows = [features(x.as_py()) for x in b.column(at).cast(pa.binary())]
            scores = np.array([float(dense[r].sum(dtype=np.float64)) for r in rows], np.float64)
            tails = model.tails(scores)
            known = np.array([len(r) > 0 for r in rows], bool)
            tails[~known] = 0.0
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(tails.sum(axis=1)), pa.array(tails.tolist(), pa.list_(pa.float64()))],
                names=[*b.schema.names, "expected_grade", "tail"])

    return run


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` (with ``text``) and ``expected_grade double``, ``tail array<double>`` (P(grade > k)).

    A map over whole texts: no shuffle, no state but the model.  Null texts and texts without
    words have expected grade 0 and tails 0.  Columns of those names are replaced.
    """
    kept = docs.drop("expected_grade", "tail")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema.fields)}"
    return kept.mapInArrow(
        _scores(model.ids, model.weights.astype(np.float32), model.thresholds, model.dimensions),
        f"{schema}, expected_grade double, tail array<double>")


def grade_of(quality: Column, toxic: Column) -> Column:
    """Graded rating of the label table: 0 toxic, 1 poor, 2 good; null where it can't be told."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (F.coalesce(toxic, F.lit(0)) == 0), 2)
