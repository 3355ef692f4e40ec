"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists.

Vectors become integers, floor(scale * x), so scores are exact. Each task deals its candidates into
blocks. A block keeps, for each dimension, its candidates sorted by that component. A query walks the
lists of all dimensions in step, from the end that its own component favours, and scores each candidate
it meets in full; no candidate that it hasn't met can score above the sum over dimensions of query
component times the list's value at the depth reached, so it stops once that bound lies below its kth
score (at equality it goes on, as ties go to the smaller id). The k best of each block then meet in one
more top-k for each query. Candidates are never shuffled or copied; each chunk of queries is one pass
over them.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, as query or
as candidate; nor do rows without an id. A query meets only candidates of its own dimension. Rows that
repeat an id are candidates each, but never of a query with that id; of queries that repeat an id the
smallest vector counts. An empty table gives an empty
result. Scores beyond a 64-bit integer stop at its limits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a candidate block and of a chunk of queries; memory of a task is bounded by these.
CANDIDATES, QUERIES = 65_536, 32_768


class Block:
    """Sorted per-dimension lists over a block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(-self.vectors, axis=0, kind="stable")  # depth x dimension, largest first
        self.values = np.take_along_axis(self.vectors, self.lists, axis=0)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, by (score descending, id)."""
        size, dims = self.vectors.shape
        up = query >= 0
        live = np.flatnonzero(query != 0)
        met = np.zeros(size, bool)
        at, scores = np.empty(0, np.int64), np.empty(0, self.vectors.dtype)
        depth, step = 0, 2 * k
        while depth < size:
            end = min(size, depth + step)
            found = np.concatenate([self.lists[depth:end][:, live[up[live]]].ravel(), self.lists[size - end : size - depth][:, live[~up[live]]].ravel()]) if len(live) else np.arange(depth, end)
            found = np.unique(found)
            found = found[~met[found]]
            met[found] = True
            found = found[self.ids[found] != own]
            at = np.concatenate((at, found))
            scores = np.concatenate((scores, self.vectors[found] @ query))
            best = np.lexsort((at, -scores))[:k]  # positions follow ids
            at, scores = at[best], scores[best]
            depth, step = end, 4 * step
            edge = np.where(up, self.values[end - 1], self.values[size - end])
            if len(at) == k and (edge * query).sum() < scores[-1]:
                break
        return self.ids[at], scores


def _integers(x: np.ndarray, scale: int, most: float) -> np.ndarray:
    """floor(scale * x) in a type in which sums of products with components up to ``most`` are exact."""
    x = np.floor(x * scale)
    wide = max(most, float(np.abs(x).max(initial=0))) ** 2 * x.shape[1]
    if wide < 2**53:
        return x  # in floating point
    return x.astype(np.int64) if wide < 2**63 else np.vectorize(int, otypes=[object])(x)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch (vec_id, embedding), for each number of dimensions."""
    ids, vectors = batch.column(0).to_numpy(), batch.column(1)
    sizes, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        yield ids[rows], flat[starts[rows][:, None] + np.arange(dims)]


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, candidates_a_block: int = CANDIDATES, queries_a_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query.

    Both inputs have (vec_id, embedding). Candidates stay where they are read. Queries are broadcast in
    chunks of a bounded size, one pass over the candidates each; a task makes the lists of a block of its
    candidates once in a pass and holds all queries of the chunk against them.
    """

    def usable(df: DataFrame) -> DataFrame:
        x = F.col("embedding")
        odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~odd)

    sc = embeddings.sparkSession.sparkContext
    cand, quer = usable(embeddings), usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-quer.count() // queries_a_block)))).cast("int")
    quer = written(quer.withColumn("chunk", chunk), "queries")
    chunks = [r["chunk"] for r in quer.select("chunk").distinct().orderBy("chunk").collect()]

    def searched(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

            def search(dims: int) -> pa.RecordBatch:
                ids, vectors = (np.concatenate(x) for x in zip(*waiting.pop(dims), strict=True))
                own, wanted = held.value[dims]
                most = float(np.abs(np.floor(wanted * scale)).max(initial=0))
                found = Block(ids, _integers(vectors, scale, most))
                wanted = np.floor(wanted * scale).astype(found.vectors.dtype) if found.vectors.dtype != object else np.vectorize(int, otypes=[object])(np.floor(wanted * scale))
                out = [(o, *found.search(o, q, k)) for o, q in zip(own.tolist(), wanted, strict=True)]
                scores = [max(-(2**63), min(2**63 - 1, int(s))) for *_, x in out for s in x.tolist()]
                query = np.repeat(own, [len(x) for *_, x in out])
                return pa.record_batch([pa.array(query, pa.int64()), pa.array(np.concatenate([x for _, x, _ in out]), pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

            for b in batches:
                for ids, vectors in _by_size(b):
                    dims = vectors.shape[1]
                    if dims not in held.value:
                        continue
                    waiting.setdefault(dims, []).append((ids, vectors))
                    if sum(len(x) for x, _ in waiting[dims]) >= candidates_a_block:
                        yield search(dims)
            for dims in list(waiting):
                yield search(dims)

        return cand.mapInArrow(run, "query_id long, vec_id long, score long")

    parts = []
    for c in chunks:
        rows = quer.where(F.col("chunk") == c).select("vec_id", "embedding").toArrow()  # some queries_a_block rows
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in rows.to_batches():
            for ids, vectors in _by_size(b):
                by_size.setdefault(vectors.shape[1], []).append((ids, vectors))
        held = sc.broadcast({dims: tuple(np.concatenate(x) for x in zip(*found, strict=True)) for dims, found in by_size.items()})
        best = _best(searched(held), k)
        parts.append(best if len(chunks) == 1 else written(best, "best"))
    if not parts:
        return _best(cand.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")), k)
    return reduce(DataFrame.union, parts)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
