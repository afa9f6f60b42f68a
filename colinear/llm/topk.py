"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

NONE = np.iinfo(np.int64).min
#: Columns of a block and what their bytes hold.
_BLOCK = {"ids": np.int64, "own": np.int64, "terms": np.int32, "rows": np.int32, "weights": np.int64}


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(embedding: Column) -> Column:
    """True where the vector and all its components are there and finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _pack(rows_a_block: int):
    """Rows ``(id, vector, row)`` -> blocks: ids, rows and their non-zero components as postings by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows_a_block):
                part = b.slice(at, rows_a_block)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                vectors = part.column(1)
                weights = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.asarray(pa.compute.list_value_length(vectors))
                begin = np.cumsum(sizes) - sizes
                row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
                term = (np.arange(len(weights)) - np.repeat(begin, sizes)).astype(np.int32)
                there = weights != 0
                order = np.lexsort([row[there], term[there]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (
                        ids, part.column(2).to_numpy(zero_copy_only=False).astype(np.int64),
                        term[there][order], row[there][order], weights[there][order])],
                    names=list(_BLOCK))

    return run


def _lists(terms: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    cut = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1], True]) if len(terms) else np.zeros(1, int)
    return {int(terms[a]): (rows[a:z], weights[a:z]) for a, z in zip(cut[:-1], cut[1:])}


def accumulate(n_queries: int, n_rows: int, queries: dict, postings: dict) -> np.ndarray:
    """Scores of all queries against all rows: term by term, weighted postings are scattered.

    Where a bound on the sums passes 64 bits they are exact in wider numbers (an array of objects).
    """
    most = lambda lists: max((max(abs(int(w.min())), abs(int(w.max()))) for _, w in lists.values() if len(w)), default=0)
    wide = most(queries) * most(postings) * len(queries) >= 1 << 63
    scores = np.zeros((n_queries, n_rows), object if wide else np.int64)
    for term, (q, q_weight) in queries.items():
        if term in postings:
            r, r_weight = postings[term]
            if wide:
                q_weight, r_weight = q_weight.astype(object), r_weight.astype(object)
            part = q_weight[:, None] * r_weight[None, :]
            if len(r) == n_rows and len(q) == n_queries:
                scores += part
            elif len(r) == n_rows:
                scores[q] += part
            else:
                scores[np.ix_(q, r)] += part
    return scores


def without(scores: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Scores as 64-bit numbers, NONE where ``skip`` is true."""
    if scores.dtype == object:
        scores[skip] = 0
        if scores.size and max(int(scores.max()), -int(scores.min())) >= 1 << 63:
            raise OverflowError("an inner product passes 64 bits")
        scores = scores.astype(np.int64)
    scores[skip] = NONE
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest ``scores`` (NONE: not a candidate), ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero((scores >= least) & (scores > NONE))
    else:
        at = np.flatnonzero(scores > NONE)
    return at[np.lexsort([ids[at], -scores[at]])[:k]]


def _score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = {c: np.frombuffer(b.column(f"q_{c}")[i].as_py(), t) for c, t in _BLOCK.items()}
                y = {c: np.frombuffer(b.column(f"c_{c}")[i].as_py(), t) for c, t in _BLOCK.items()}
                scores = accumulate(len(x["ids"]), len(y["ids"]), _lists(x["terms"], x["rows"], x["weights"]),
                                    _lists(y["terms"], y["rows"], y["weights"]))
                scores = without(scores, (x["own"][:, None] == y["own"][None, :]) & (x["own"] >= 0)[:, None])
                found = [best(s, y["ids"], k) for s in scores]
                at = np.concatenate(found) if found else np.zeros(0, int)
                q = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["ids"][q]), pa.array(x["own"][q]), pa.array(y["ids"][at]), pa.array(scores[q, at])],
                    names=["query_id", "own", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, rows_a_block: int = 1024,
           queries_a_block: int = 256) -> DataFrame:
    """Exact ``k`` best of ``vectors(id, v array<bigint>[, row])`` for each row of ``queries(id, v[, row])``.

    Both sides are packed into blocks of bounded size.  Candidate blocks are dealt over groups, as many as there are
    blocks to deal but no more than shuffle partitions; query blocks are copied to each group,
    and an equi-join on the group brings every query block to every candidate block once.  Each
    pair of blocks keeps its ``k`` best; those merge by a rank that is cut off before the shuffle.

    ``row`` (0 or more) names a row: a query meets every row but its own, also others of its id; without it nothing is
    left out.  Ties go to the smaller id.  Null ids take no part; each query row has its ranks, also of repeated
    ids; missing components are zeros.  A score beyond 64 bits raises.  Empty tables give no rows; other columns
    aren't read.  Returns ``query_id, rank, vec_id, score``.
    """
    form = ", ".join(f"{c} binary" for c in _BLOCK)
    own = lambda df: df.where("id is not null").select(
        "id", "v", (F.coalesce("row", F.lit(-1)) if "row" in df.columns else F.lit(-1)).cast("long").alias("row"))
    groups = max(1, min(partitions(vectors.sparkSession), -(-vectors.count() // rows_a_block)))
    q = own(queries).coalesce(max(1, groups // 8)).mapInArrow(_pack(queries_a_block), form)
    c = own(vectors).mapInArrow(_pack(rows_a_block), form)
    q = q.select(*[F.col(n).alias(f"q_{n}") for n in _BLOCK], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    c = c.select(*[F.col(n).alias(f"c_{n}") for n in _BLOCK], F.pmod(F.xxhash64("ids", "own"), F.lit(groups)).cast("int").alias("g"))
    met = c.repartition(groups, "g").join(q.repartition(groups, "g"), "g").drop("g")
    top = met.mapInArrow(_score(k), "query_id bigint, own bigint, vec_id bigint, score bigint")
    by = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    return top.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
