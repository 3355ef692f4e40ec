"""Concatenate and cut: documents become one long run of tokens, cut into windows of fixed length.

Two passes. The first tokenises each partition and notes every document's offset within it; the
partitions' totals, one number a task, give each partition its global base. The second cuts the
documents at the window borders. Each window is full but the last one, so padding is below one window.

Edge cases: a null text counts as empty and an empty text is the end token alone; an empty table gives
no pieces; null and repeated doc_ids are packed like any others; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written
from .tokens import ByteBpe

END = 1
LENGTH = 2048


def tokenised(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, part, start (offset within the part), n, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = ByteBpe(tokenizer).encode, np.array([END], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, len(texts), 512):
                ids = [encode(t or "") + end for t in texts.slice(lo, 512).to_pylist()]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                starts = at + np.concatenate(([0], np.cumsum(n)[:-1]))
                at += int(n.sum())
                yield pa.record_batch([batch.column(0).slice(lo, 512), pa.array(np.full(len(ids), part, np.int64)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "start", "n", "ids"])

    return documents.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, part long, start long, n long, ids binary")


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in windows of ``length`` tokens.

    One row a piece: doc_id, start and length within the document, doc_tokens, sequence_id, offset,
    ids_crc32, ``cut`` (a boundary record: the document goes on in the next window), sequence_length and
    padded_length of its window (a full power of two needs no padding), and the piece's ids if wanted.
    """
    spark = documents.sparkSession
    tokens = written(tokenised(documents, tokenizer), "tokens")
    # one number for each task of the first pass, not for each document
    totals = sorted(tuple(r) for r in tokens.groupBy("part").agg(F.max(F.col("start") + F.col("n"))).collect())
    bases = np.concatenate(([0], np.cumsum([n for _, n in totals], dtype=np.int64)))
    total = int(bases[-1])
    known = spark.sparkContext.broadcast((np.array([p for p, _ in totals], np.int64), bases))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut", "sequence_length", "padded_length"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, base = known.value
        for batch in batches:
            first = base[np.searchsorted(parts, batch.column(1).to_numpy())] + batch.column(2).to_numpy()
            counts = batch.column(3).to_numpy()
            windows = (first + counts - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(counts)), windows)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            sequence = first[row] // length + nth
            lo = np.maximum(sequence * length, first[row])
            hi = np.minimum((sequence + 1) * length, first[row] + counts[row])
            start = lo - first[row]
            ids = batch.column(4)
            held, pieces, sums = -1, [], np.empty(len(row), np.int64)
            for k, (r, a, b) in enumerate(zip(row.tolist(), (start * 4).tolist(), ((hi - first[row]) * 4).tolist(), strict=True)):
                if r != held:
                    held, data = r, memoryview(ids[r].as_buffer())
                sums[k] = zlib.crc32(data[a:b])
                if with_ids:
                    pieces.append(bytes(data[a:b]))
            filled = np.minimum(length, total - sequence * length)
            power = (filled & (filled - 1)) == 0
            columns = [batch.column(0).take(pa.array(row)), start, hi - lo, sums, counts[row], sequence, lo - sequence * length, hi < first[row] + counts[row], filled, np.where(power, filled, length)]
            columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns] + [pa.array(pieces, pa.binary())] * with_ids
            yield pa.record_batch(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut boolean, sequence_length long, padded_length long" + ", ids binary" * with_ids
    return tokens.mapInArrow(lean(run), schema)
