"""N-gram Jaccard join: an exact metric-space join of documents by their distinct word shingles.

Jaccard distance is a metric, so pivots, Voronoi cells and triangle windows apply (``regions``). Texts
without a common shingle all lie at distance 1 from each other, where no window prunes; so the first
regions are seeded by an exact filter. It cuts the universe of shingles into so many parts that two sets
that link agree on a whole, non-empty part (the pigeonhole principle: each differing shingle spoils one
part). A set meets only those sets that agree with it on a part.

Sizes fall into classes; a set has keys in the space of its class and, if a larger partner can lie in
the next class, in that space too. Class 0 uses deletion keys, as its sets differ by one shingle at most.
A part that is empty, or that holds common shingles only (those of lines and passages that many
documents share), says little, and its key would bring unrelated texts together; it is left out, and a
set with more such parts than the slack allows adds prefix-filter keys, rare shingles first. Which
shingles are common is counted over all documents, by hash; the result doesn't depend on it.

Edge cases: a null or blank text has no shingles, is linked with nothing and is its own component;
fewer words than n give one shingle, the whole sequence; rows with a null doc_id have a null component
and link nothing; rows that repeat a doc_id form one document (one of its texts, the same on each run, is
measured); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, Memo, lean, mix, release, written
from .components import components
from .regions import Parity, links_in_regions, pivot_pairs, shared

#: Byte table: A-Z to a-z, all else as it is.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: Sets up to this size form class 0, each further class reaches GROWTH times as far as the one before.
SMALL, GROWTH, CLASSES = 12, 1.3, 120
#: Shingles are counted by so many leading bits; those in this share of the documents are common.
COUNT_BITS, COMMON, COMMON_LEAST = 22, 1e-3, 50


class Shingles:
    """Sorted distinct 64-bit hashes of the word n-grams of a text."""

    def __init__(self, n: int):
        self.n = n
        self.words = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()  # of bytes: 0x20, 0x09-0x0D
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        n = min(self.n, len(h))
        s = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            s = mix(s + h[k : len(h) - n + 1 + k] * _STEPS[0] + _STEPS[1]) if self.n > 4 else s + h[k : len(h) - n + 1 + k] * _STEPS[k]
        if n < self.n:
            s += _STEPS[4:] * np.uint64(n)
        return np.unique(mix(s))


class Keys:
    """Bucket keys of a set, such that any two sets that link share at least one."""

    def __init__(self, percent: int, common: np.ndarray | None = None):
        self.percent = percent
        self.common = np.zeros(1 << COUNT_BITS, bool)
        if common is not None:
            self.common[common] = True
        top = [SMALL]
        while len(top) < CLASSES:
            top.append(max(top[-1] + 1, int(top[-1] * max(GROWTH, 100 / percent + 0.01))))
        self.top = top

    def differ(self, size: int) -> int:
        """The most that two linked sets of at most this size differ by."""
        return 2 * size * (100 - self.percent) // (100 + self.percent)

    def __call__(self, s: np.ndarray) -> list[np.ndarray]:
        n = len(s)
        c = bisect_left(self.top, n)
        out = [self.space(s, c)]
        if n * 100 // self.percent > self.top[c]:
            out.append(self.space(s, c + 1))
        return out

    def space(self, s: np.ndarray, c: int) -> np.ndarray:
        tag = _STEPS[2:3] * np.uint64(c + 1)
        if c == 0 and self.differ(self.top[0]) <= 1:
            h = mix(s + _STEPS[3])
            whole = h.sum(dtype=np.uint64)
            return mix(np.append(whole - h, whole) + tag)
        differ = self.differ(self.top[c])
        slack = 2 + differ // 16
        parts = differ + 1 + slack
        at = (mix(s ^ tag) % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, at, mix(s + _STEPS[3]))
        rare = ~self.common[_slot(s)]
        full = np.flatnonzero(np.bincount(at[rare], minlength=parts))
        keys = mix(sums[full] + mix(full.astype(np.uint64) + tag))
        if parts - len(full) > slack:  # two sets may agree only on parts without a key
            prefix = np.concatenate((s[rare], s[~rare]))[: len(s) - -(-len(s) * self.percent // 100) + 1]
            keys = np.append(keys, mix((prefix ^ _STEPS[4]) + tag))
        return keys


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _sets(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, and a 128-bit hash of the set. Rows with n_shingles -1 are counts instead: h1
    is a slot of shingles, h2 the different sets of a task that have one there, if they are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts, seen = Shingles(n), np.zeros(1 << COUNT_BITS, np.int32), set()
        names = ["doc_id", "n_shingles", "h1", "h2"]
        for b in batches:
            sizes, both = [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                if h not in seen:
                    seen.add(h)
                    counts[np.unique(_slot(s))] += 1
                sizes.append(len(s))
                both.append(divmod(h, 1 << 64))
            hi, lo = (pa.array(np.array([x[k] for x in both], np.uint64).view(np.int64)) for k in (0, 1))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), hi, lo], names=names)
        slots = np.flatnonzero(counts >= max(3, COMMON * len(seen)))
        yield pa.record_batch([pa.nulls(len(slots), pa.int64()), pa.array(np.full(len(slots), -1)), pa.array(slots), pa.array(counts[slots].astype(np.int64))], names=names)

    return documents.mapInArrow(lean(run), "doc_id long, n_shingles long, h1 long, h2 long")


def _buckets(documents: DataFrame, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """(key, node, size) of each distinct set of each task; its first document stands for the set."""
    held_common = documents.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, keys, seen = Shingles(n), Keys(percent, held_common.value), set()
        for b in batches:
            found, nodes, held = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(text.as_py())
                if doc is None or not len(s) or (h := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                    continue
                seen.add(h)
                for k in keys(s):
                    found.append(k)
                    nodes.append((doc, len(s), len(k)))
                    held += len(k)
                if held > 500_000:
                    yield _rows(found, nodes)
                    found, nodes, held = [], [], 0
            if found:
                yield _rows(found, nodes)

    return documents.mapInArrow(lean(run), "key long, node long, size int")


def _rows(found: list[np.ndarray], nodes: list[tuple[int, int, int]]) -> pa.RecordBatch:
    ids, sizes, counts = np.array(nodes, np.int64).T
    return pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(ids, counts)), pa.array(np.repeat(sizes, counts).astype(np.int32))], names=["key", "node", "size"])


def _payloads(documents: DataFrame, n: int, wanted: IdFilter) -> DataFrame:
    """node, the size and weight of its set, its sketch and the set, of the documents that ``wanted`` lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            b = b.filter(pa.array(wanted(b.column(0).to_numpy()), pa.bool_()))
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                sets = [shingles(t.as_py()) for t in part.column(1)]
                part = part.filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))
                sets = [s for s in sets if len(s)]
                sizes = np.array([len(s) for s in sets], np.int32)
                columns = [pa.array(sizes), pa.array(9 * sizes), pa.array([Parity.sketch(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.record_batch([part.column(0), *columns], names=["node", "size", "weight", "sketch", "payload"])

    return documents.mapInArrow(lean(run), "node long, size int, weight int, sketch binary, payload binary")


def ngram_links(documents: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(sets, links): doc_id, n_shingles, h1, h2 for each row, and (a, b) links of doc_ids that connect
    all documents that a chain of pairs at ``percent`` or more connects."""
    docs = documents.select("doc_id", "text")
    counted = written(_sets(docs, n), "sets")
    sets = counted.where("n_shingles >= 0")
    least = max(COMMON_LEAST, COMMON * sets.count())
    common = counted.where("n_shingles < 0").groupBy("h1").agg(F.sum("h2").alias("n")).where(F.col("n") >= least)
    # slots, not shingles: 2^COUNT_BITS at most
    slots = np.array(sorted(r["h1"] for r in common.select("h1").collect()), np.int64)
    some = sets.where("n_shingles > 0 and doc_id is not null")
    copies = some.join(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("b")), ["h1", "h2"]).where("doc_id != b").select(F.col("doc_id").alias("a"), "b")
    buckets = written(shared(_buckets(docs, n, percent, slots), F.ceil(F.col("size") * percent / 100)), "buckets")
    nodes = written(buckets.select("node").distinct(), "nodes")
    payloads = _payloads(docs, n, IdFilter(nodes))
    if not some.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # one text for each id, the same on each run
        payloads = payloads.groupBy("node").agg(F.max(F.struct("payload", "sketch", "size", "weight")).alias("m")).select("node", "m.size", "m.weight", "m.sketch", "m.payload")
    payloads = written(payloads, "payloads")
    pairs = written(pivot_pairs(buckets), "pairs")
    release(buckets, nodes)
    return sets, copies.union(links_in_regions(pairs, payloads.drop("payload"), Parity(percent), lambda _ids: payloads.select("node", "payload")))


def ngram_components(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``documents`` (doc_id, text)."""
    sets, links = ngram_links(documents, n, percent)
    found = components(links)
    return sets.join(found, sets["doc_id"] == found["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stand for their group, the smallest doc_id of each component; of rows that
    repeat a doc_id and its text one stays. Rows with a null doc_id stay as they are."""
    links = ngram_links(documents, n, percent)[1]
    gone = components(links).where("node != component").select(F.col("node").alias("doc_id"))
    kept = documents.join(gone, "doc_id", "left_anti")
    twice = written(documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, "doc_id", "left_anti").unionByName(once)
