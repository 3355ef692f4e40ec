"""What the operators of this subpackage share: tables, scratch space and stable hashes."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition used throughout: 0x20 and 0x09-0x0D, nothing else.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Intermediate tables by path.
_SCRATCH: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by its Parquet path; any file system that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or a folder of our own where
    that is unset (single-machine runs and tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/quern-scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's setting that frees the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    A lost executor costs nothing then but the tasks that it ran. The job's shuffle files go when it has
    ended, as nothing reads them again; the table goes with ``release``, ``drop_scratch`` or the end of
    the session's process.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quern-{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    _SCRATCH[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def as_table(view: DataFrame, table: DataFrame) -> DataFrame:
    """``view``, a plain reading of ``table``, such that ``release`` of the one deletes the other."""
    view._quern_path = table._quern_path
    return view


def _delete(path: str | None) -> None:
    if path and (spark := _SCRATCH.pop(path, None)):
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session is gone, and its cluster cleans up
            return


def release(*tables: DataFrame | None) -> None:
    """Delete intermediate tables that nothing reads any more; other DataFrames are left alone."""
    for t in tables:
        _delete(getattr(t, "_quern_path", None))


def scratch_mark() -> set[str]:
    """The intermediate tables there are now, for ``drop_scratch``."""
    return set(_SCRATCH)


def drop_scratch(since: set[str] | None = None, but: DataFrame | None = None) -> None:
    """Delete the intermediate tables that ``written`` has left (since ``scratch_mark``), except ``but``."""
    for path in set(_SCRATCH) - (since or set()) - {getattr(but, "_quern_path", None)}:
        _delete(path)


atexit.register(drop_scratch)


#: Bytes of memory beyond which a Python worker gives back, after a task, what it has freed.
LEAN = 160 << 20


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for a task, so that its worker keeps nothing of what the task has freed. Workers live on
    between stages, and what the allocators of each hold back adds up beside the executor's heap."""

    def bounded(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return bounded


def give_back() -> None:
    """Return freed memory to the system where there is much."""
    try:
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") < LEAN:
                return
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, ValueError):  # not Linux, or another C library: there it stays as it is
        return


#: Bits of an IdFilter at most: 16 MB.
MOST_BITS = 1 << 27


class IdFilter:
    """A bitmap of 64-bit ids, so that rows which surely aren't wanted stay out of a shuffle. It may let
    others pass, ever more beyond some ten million ids, so an exact join has to follow."""

    def __init__(self, ids: DataFrame):
        """``ids`` has one long column."""
        (name,) = ids.columns
        n = ids.count()
        self.bits = max(1 << 15, min(MOST_BITS, 1 << (16 * n).bit_length()))
        at = F.col(name).bitwiseAND(F.lit(self.bits - 1)) + 1
        parts = ids.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
        found = np.zeros(self.bits // 8, np.uint8)
        for r in parts.collect():  # 4 KB a bucket, MOST_BITS in all
            lo = (r["bucket"] - 1) * 4096
            found[lo : lo + 4096] = np.frombuffer(r["bitmap"], np.uint8)[: len(found) - lo]
        self.held = ids.sparkSession.sparkContext.broadcast(found)

    def __getstate__(self):
        return {"bits": self.bits, "held": self.held}

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        at = ids & np.int64(self.bits - 1)
        return (self.held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers: every input bit moves about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Memo(dict):
    """A dict that computes what it lacks; it starts afresh once it holds ``most`` entries, so that its
    memory is bounded. Only speed depends on it."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
