"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network whose
probabilities are calibrated by temperature.

Word vectors come from all documents: each word has a sparse random index vector, a pure function of its
hash, and its context vector is the sum of the index vectors of its neighbours over the whole corpus.
Words share a fixed number of rows by hash, so the table's size doesn't depend on the corpus; tasks sum
their part of it, and the parts are summed by row. A document is the mean and spread of its words'
context vectors, the mean of its index vectors, how far neighbours differ, and its length. The network
is trained on a bounded sample of labelled rows (``most_rows``, those of the smallest id hashes), from
the training fold only; a part of that sample sets the temperature.

Words are runs of letters and digits or runs of other visible characters, case kept.

Edge cases: a null or empty text pools to zeros and gets the score of that input; null or repeated
doc_ids are scored like any other rows; labels that are null, or that have no document, are not used;
without labels of both kinds the score is their share (1 where there are none); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Memo, lean, mix, written

ROWS, DIMS, ONES = 1 << 14, 48, 4
THRESHOLD = 0.7
MOST_ROWS = 20_000
_UNIT = re.compile(r"\w+|[^\w\s]+")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(folds)) == fold, F.lit(False))


def index_vectors() -> np.ndarray:
    """A sparse vector of a few ones and minus ones for each row, from its number alone."""
    out = np.zeros((ROWS, DIMS), np.float32)
    rows = np.arange(ROWS)
    for k in range(ONES):
        h = mix(rows.astype(np.uint64) * np.uint64(ONES) + np.uint64(k + 1))
        np.add.at(out, (rows, ((h >> np.uint64(8)) % np.uint64(DIMS)).astype(np.int64)), np.where(h & np.uint64(1), 1, -1).astype(np.float32))
    return out


class Words:
    """Row numbers of the words of a text."""

    def __init__(self):
        self.rows = Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % ROWS)

    def __call__(self, text: str | None) -> np.ndarray:
        words = _UNIT.findall(text or "")
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))


def context_vectors(documents: DataFrame) -> np.ndarray:
    """The context vector of each row, over all documents, scaled to unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, index = Words(), index_vectors()
        total = np.zeros((ROWS, DIMS), np.float64)
        at = np.argsort(index == 0, axis=1, kind="stable")[:, :ONES]  # of the ones; where two fell together a zero follows
        sign = np.take_along_axis(index, at, axis=1)
        gap = np.array([-1, -1], np.int64)  # keeps windows within a document
        for b in batches:
            held: list[np.ndarray] = []
            for t in b.column(0):
                held += (words(t.as_py()), gap)
                if len(held) > 4096 or len(held[-2]) > 1_000_000:
                    _add_contexts(total, np.concatenate(held), at, sign)
                    held = []
            if held:
                _add_contexts(total, np.concatenate(held), at, sign)
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        for lo in range(0, len(some), 2048):
            rows = some[lo : lo + 2048]
            yield pa.record_batch([pa.array(rows), pa.array([x.tobytes() for x in total[rows]], pa.binary())], names=["row", "vector"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for row, v in zip(b["row"].tolist(), b["vector"], strict=True):
                v = np.frombuffer(v)
                total[row] = total[row] + v if row in total else v
        if total:
            yield pd.DataFrame({"row": list(total), "vector": [v.tobytes() for v in total.values()]})

    schema = "row long, vector binary"
    parts = documents.select("text").mapInArrow(lean(run), schema)
    out = np.zeros((ROWS, DIMS), np.float64)
    for r in parts.repartition("row").mapInPandas(lean(add), schema).toLocalIterator():  # ROWS rows at most
        out[r["row"]] = np.frombuffer(r["vector"])
    return (out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32)


def _add_contexts(total: np.ndarray, words: np.ndarray, at: np.ndarray, sign: np.ndarray) -> None:
    """Add to each word's row the index vectors of the words up to two places off."""
    flat = total.reshape(-1)
    for k in (1, 2):
        left, right = words[:-k], words[k:]
        both = (left >= 0) & (right >= 0)
        left, right = left[both], right[both]
        for word, other in ((left, right), (right, left)):
            rows = word * DIMS
            for j in range(ONES):
                flat += np.bincount(rows + at[other, j], weights=sign[other, j], minlength=len(flat))


class Pooling:
    """Features of a document from its words' vectors."""

    def __init__(self, context: np.ndarray):
        self.words, self.index, self.context = Words(), index_vectors() / np.float32(np.sqrt(ONES)), context
        self.size = 3 * DIMS + 6

    def __call__(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.size, np.float32)
        w = self.words(text)
        if not len(w):
            return out
        rows, n = np.unique(w, return_counts=True)
        share = (n / len(w)).astype(np.float32)
        c, i = self.context[rows], self.index[rows]
        mean = share @ c
        out[:DIMS] = mean
        out[DIMS : 2 * DIMS] = np.sqrt(np.maximum(share @ (c * c) - mean * mean, 0))
        out[2 * DIMS : 3 * DIMS] = share @ i
        out[-6] = np.log1p(len(w)) / 10
        out[-5] = len(rows) / len(w)
        out[-4] = np.sqrt((share * share).sum())
        if len(w) > 1:
            out[-3] = (w[1:] == w[:-1]).mean()
            pairs = np.sort(w[1:] * ROWS + w[:-1])
            out[-2] = (1 + np.count_nonzero(pairs[1:] != pairs[:-1])) / len(pairs)
            vectors = self.context[w]
            out[-1] = np.vdot(vectors[1:], vectors[:-1]) / len(pairs)
        return out


class Network:
    """Two layers, tanh then logistic, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.prior = float(y.mean()) if len(y) else 1.0
        self.trained = len(y) >= 20 and 0 < self.prior < 1
        if not self.trained:
            return
        order = rng.permutation(len(y))
        kept = order[: max(8, len(y) // 6)]
        train = order[len(kept) :]
        self.mean, self.spread = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
        z, t = (x - self.mean) / self.spread, y.astype(np.float64)
        w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log(self.prior / (1 - self.prior)))]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        best, left, step = (np.inf, w), 10, 0
        for _ in range(epochs):
            mixed = rng.permutation(train)
            for lo in range(0, len(mixed), 64):
                at = mixed[lo : lo + 64]
                h = np.tanh(z[at] @ w[0] + w[1])
                g = (_logistic(h @ w[2] + w[3]) - t[at]) / len(at)
                dh = np.outer(g, w[2]) * (1 - h * h)
                grads = [z[at].T @ dh + 1e-3 * w[0], dh.sum(axis=0), h.T @ g + 1e-3 * w[2], np.array(g.sum())]
                step += 1
                for k, d in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                    w[k] = w[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            loss = _loss(np.tanh(z[kept] @ w[0] + w[1]) @ w[2] + w[3], t[kept])
            if loss < best[0] - 1e-4:
                best, left = (loss, [p.copy() for p in w]), 10
            elif not (left := left - 1):
                break
        self.weights = best[1]
        logits = self._logits(x[kept])
        self.temperature = min(np.exp(np.linspace(0, 2, 41)), key=lambda q: _loss(logits / q, t[kept]))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh((x - self.mean) / self.spread @ w[0] + w[1]) @ w[2] + w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self._logits(x) / self.temperature) if self.trained else np.full(len(x), self.prior)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most_rows: int) -> DataFrame:
    """(doc_id, label, text) of a bounded sample of labelled rows of the training fold, as a table. Of rows
    that repeat an id the smallest text counts, so the sample has ``most_rows`` rows at most."""
    some = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    sample = written(some.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "sample")
    # at most most_rows pairs of integers, so this side can always be broadcast
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return written(rows.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "training")


def with_scores(documents: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, most_rows: int = MOST_ROWS) -> DataFrame:
    """``documents`` with a column ``score``, the probability of label 1 from the text alone."""
    spark = documents.sparkSession
    training = training_rows(documents, labels, "quality", folds, fold, most_rows)
    context = spark.sparkContext.broadcast(context_vectors(documents))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooling = Pooling(context.value)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([pooling(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["label", "x"])

    pooled = training.select("label", "text").mapInArrow(lean(pool), "label int, x binary").collect()  # most_rows rows at most
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in pooled]) if pooled else np.zeros((0, 3 * DIMS + 6), np.float32)
    order = np.lexsort(x.T) if len(x) else np.arange(0)  # rows come in any order; training shouldn't depend on it
    network = spark.sparkContext.broadcast(Network(x[order], np.array([r["label"] for r in pooled], np.int64)[order]))

    names = documents.columns
    at = names.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooling = Pooling(context.value)
        for b in batches:
            x = np.stack([pooling(t.as_py()) for t in b.column(at)]) if b.num_rows else np.zeros((0, pooling.size), np.float32)
            yield pa.record_batch([*b.columns, pa.array(network.value(x).astype(np.float64))], names=[*names, "score"])

    return documents.mapInArrow(lean(score), StructType([*documents.schema.fields, StructField("score", DoubleType())]))


def score_quality(documents: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``documents`` (doc_id, text)."""
    scored = with_scores(documents.select("doc_id", "text"), labels, folds, fold, most_rows).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
