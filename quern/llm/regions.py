"""Exact links between items of a metric space that meet in buckets, by pivot regions.

Buckets come from an exact filter: two items that link meet in at least one. A bucket's pivot is the
member that shares most buckets with others, so the middle of a group of near copies rather than one of
its members; all buckets with the same pivot form its region. Each item has a sketch, and the distance of
two sketches is a metric that is never above the number of differences of the items themselves. So the
triangle inequality over sketches gives exact windows, while whole items move only to be verified.

First each item is verified against the nearest pivot that it may link with. Members with the pivot's
label are settled among each other then; the others are open, and a region in which all labels agree is
done. What an open item can reach lies in a window of distances to the pivot; the rest of the region goes.
A region small enough for one task is joined there, first by sketches alone: items without a partner whose
size and sketch allow a link go, which are most, before whole items are fetched. Then such pairs are taken
by increasing distance, and those that known links don't connect by then are compared as they are. A
larger region is divided: new pivots among its open items make Voronoi cells, an open item moves into the
cell of its nearest pivot, and members that an open item of another cell may reach are copied across the
border. Cells are regions like any other; where division no longer helps, a region is dealt out as a grid
of blocks of open items and of members.

The links that come out have the same connected components as all links there are: a pair is left out
only where known links connect both sides, or where sketches rule it out. No group is expanded into all
its pairs: a region gives fewer links than it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, release, written
from .components import components

#: A region is joined in one task up to so many pairs of an open item and a member, and bytes of sketches.
AREA, BYTES = 1 << 24, 1 << 26
#: New pivots of a larger region, and how often regions are divided by pivots before they become grids.
PIVOTS, DEPTH = 16, 4
#: Pairs whose sketches are looked at together; the fewest and the most pairs that are verified together.
PAIRS, LOOK = 1 << 16, (64, 4096)

#: Payloads (node, payload) of some nodes.
Payloads = Callable[[DataFrame], DataFrame]


class Metric:
    """Distances between sketches (bytes), the largest that two items which link can have, and the link
    itself, between payloads."""

    def matrix(self, sketches: list[bytes]) -> np.ndarray:
        """The sketches as rows of one array."""
        raise NotImplementedError

    def row(self, matrix: np.ndarray, one: np.ndarray) -> np.ndarray:
        """The distance of each row to ``one``."""
        raise NotImplementedError

    def apart(self, a: list[bytes], b: list[bytes]) -> np.ndarray:
        """The distance of each sketch to the one beside it."""
        return np.fromiter((self.row(m[1:], m[0])[0] for m in map(self.matrix, zip(a, b, strict=True))), np.int32, len(a))

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By the sizes of two items."""
        raise NotImplementedError

    def partners(self, size: int) -> tuple[int, int]:
        """The least and the greatest size of an item that may link with one of this size."""
        raise NotImplementedError

    def linked(self, a, b) -> bool:
        raise NotImplementedError

    def linked_each(self, a: list, b: list) -> list[bool]:
        """``linked`` of each payload and the one beside it."""
        return [self.linked(x, y) for x, y in zip(a, b, strict=True)]

    #: Regions are looked at together up to so many rows (1: each alone).
    together = 1


class Parity(Metric):
    """Sets as sorted arrays of 64-bit hashes, linked by Jaccard similarity. A sketch has a bit for each slot
    of a power-of-two number of slots, the parity of its elements. An element in which two sets differ flips
    one bit, so they differ in at least as many elements as bits. The half of a sketch added to its other
    half is the sketch for half as many slots."""

    def __init__(self, percent: int):
        self.percent = percent

    @staticmethod
    def sketch(hashes: np.ndarray) -> bytes:
        slots = max(64, 1 << (4 * len(hashes) - 1).bit_length())
        odd = np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()

    def matrix(self, sketches: list[bytes]) -> np.ndarray:
        words = min(map(len, sketches)) // 8
        rows = []
        for s in sketches:
            x = np.frombuffer(s, np.uint64)
            while len(x) > words:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            rows.append(x)
        return np.stack(rows)

    def row(self, matrix: np.ndarray, one: np.ndarray) -> np.ndarray:
        return np.bitwise_count(matrix ^ one).sum(axis=1, dtype=np.int32)

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def partners(self, size: int) -> tuple[int, int]:
        return -(-size * self.percent // 100), size * 100 // self.percent

    def linked(self, a: bytes, b: bytes) -> bool:
        both = np.concatenate((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
        both.sort(kind="stable")
        same = int((both[1:] == both[:-1]).sum())
        return 100 * same >= self.percent * (len(both) - same)


def shared(buckets: DataFrame, least: Column) -> DataFrame:
    """The buckets (key, node, size, ...) cut where sizes are too far apart, without rows that are alone.

    ``least`` is the size of the smallest partner that a row may link with. Rows of a bucket by size form
    runs in which each has the one before within reach; partners are always in one run. The window looks
    one row ahead and one back, so its memory doesn't depend on a bucket's size.
    """
    by = Window.partitionBy("key").orderBy("size", "node")
    rows = buckets.withColumn("_least", least)
    near = F.coalesce(F.lag("size").over(by) >= F.col("_least"), F.lit(False))
    rows = rows.withColumn("_run", F.sum(F.when(near, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    same = lambda f: F.coalesce((f("node").over(by) != F.col("node")), F.lit(False))
    ahead = F.coalesce(F.col("size") >= F.lead("_least").over(by), F.lit(False))
    rows = rows.withColumn("_beside", (near & same(F.lag)) | (ahead & same(F.lead)))
    return rows.where("_beside").withColumn("key", F.when(F.col("_run") == 1, F.col("key")).otherwise(F.xxhash64("key", "_run"))).drop("_least", "_run", "_beside", "size")


def split_by_size(buckets: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) pairs of the buckets with ``most`` rows at most, each once and with an own row in it; and the
    rows of the larger buckets. ``buckets`` has (key, node, own)."""
    sizes = buckets.groupBy("key").agg(F.count("*").alias("_n"))
    sized = written(buckets.join(sizes, "key"), "sized")
    few = sized.where(F.col("_n") <= most).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "own"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), (x["own"] | y["own"]).alias("own")))))
    direct = few.select(F.explode(pairs).alias("p")).select("p.*").where("own and a != b").select("a", "b").distinct()
    return direct, sized.where(F.col("_n") > most).drop("_n")


def pivot_pairs(buckets: DataFrame, seed: str | None = None) -> DataFrame:
    """(pivot, node) of all buckets (key, node), each once. ``seed`` names a boolean column; only rows that
    have it may be pivots, and a bucket without them has no pairs.

    The pivot is the row of the node with the most buckets, a maximum that is combined before the shuffle.
    """
    votes = buckets.groupBy("node").agg(F.count("*").alias("votes"))
    led = buckets.where(seed) if seed else buckets
    lead = led.join(votes, "node").groupBy("key").agg(F.max(F.struct("votes", "node")).alias("m")).select("key", F.col("m.node").alias("pivot"))
    return buckets.select("key", "node").join(lead, "key").where(F.col("pivot") != F.col("node")).select("pivot", "node").distinct()


def links_in_regions(pairs: DataFrame, items: DataFrame, metric: Metric, payloads: Payloads, direct: DataFrame | None = None, by: str = "node") -> DataFrame:
    """(a, b) links that connect what all links connect.

    ``pairs`` has (pivot, node), ``items`` (node, size, weight, sketch) of each of them; weight is about the
    bytes of sketch and payload. ``payloads`` gives (node, payload) of the nodes asked for, and may give more.
    ``direct`` has pairs (a, b) of buckets that need no region; all of them are looked at. Both name items by
    the column ``by``, which several nodes may share; a pair then stands for all theirs.
    """
    kind = items.schema["node"].dataType.simpleString()
    asked = pairs.select("pivot", "node", F.lit(False).alias("direct"))
    if direct is not None:
        asked = asked.union(direct.select("a", "b", F.lit(True)))
    looked = written(_star(asked, items, metric, kind, by), "star")
    star = looked.where("not direct").drop("direct")
    near = star.where("may").groupBy("node").agg(F.min(F.struct("d", "pivot")).alias("m")).select(F.col("m.pivot").alias("a"), F.col("node").alias("b"))
    if direct is not None:
        near = near.union(looked.where("direct and may").select("pivot", "node"))
    near = written(near, "near")
    ids = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    links = [written(_verified(near, payloads(ids), metric, kind), "links")]
    # a few rounds: nodes with the same label are connected, and that is all that labels are for here
    labels = components(links[0], rounds=2)
    lead = labels.select(F.col("node").alias("pivot"), F.col("component").alias("lead"))
    named = _labelled(star, labels).join(lead, "pivot", "left").withColumn("lead", F.coalesce("lead", "pivot"))
    fresh = named.select(F.hex("pivot").alias("region"), F.lit(0).alias("depth"), "node", "d", "reach", "weight", (F.col("label") != F.col("lead")).alias("open"))
    # the pivot is a member too
    fresh = fresh.union(star.groupBy("pivot").agg(F.max("reach").alias("reach"), F.max("lead_weight").alias("weight")).select(F.hex("pivot"), F.lit(0), "pivot", F.lit(0), "reach", "weight", F.lit(False)))
    fresh = held = _labelled_once(fresh, labels)
    release(looked)
    while fresh is not None:
        ready = written(_pruned(fresh), "regions")
        release(held, near)
        met = written(_partnered(ready.where("small"), items, metric, kind), "partnered")
        whole = payloads(met.select("node").distinct())
        links.append(written(_joined(met, items, whole, metric, kind), "links"))
        release(met)
        large = ready.where("not small")
        fresh = held = None if large.isEmpty() else _labelled_once(_divided(large, items, metric, kind), labels)
        release(ready)
    release(labels)
    return reduce(DataFrame.union, links)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _labelled_once(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """With labels, as a table: pruning reads it twice."""
    return written(_labelled(rows, labels), "cells")


def _star(pairs: DataFrame, items: DataFrame, metric: Metric, kind: str, by: str) -> DataFrame:
    """pivot, node, direct (as in ``pairs``), the distance d of their sketches, may (they may link), reach
    (the most that members which link can be apart) and the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = metric.apart(b.column(5).to_pylist(), b.column(6).to_pylist())
            x, y = (b.column(i).to_numpy().astype(np.int64) for i in (3, 4))
            top = np.maximum(x, y)
            columns = [pa.array(d), pa.array(d <= metric.most(x, y)), pa.array(metric.most(top, top).astype(np.int32)), b.column(7), b.column(8)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), *columns], names=["pivot", "node", "direct", "d", "may", "reach", "lead_weight", "weight"])

    side = lambda name: items.select(F.col(by).alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("node", "size", "weight", "sketch")])
    both = pairs.join(side("node"), "node").join(side("pivot"), "pivot")
    both = both.select("pivot_node", "node_node", "direct", *[f"{name}_{c}" for c in ("size", "sketch", "weight") for name in ("pivot", "node")])
    return both.mapInArrow(lean(run), f"pivot {kind}, node {kind}, direct boolean, d int, may boolean, reach int, lead_weight int, weight int")


def _verified(pairs: DataFrame, payloads: DataFrame, metric: Metric, kind: str) -> DataFrame:
    """The pairs (a, b) that link, by their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = metric.linked_each(b.column(2).to_pylist(), b.column(3).to_pylist())
            yield b.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    a, b = (payloads.select(F.col("node").alias(x), F.col("payload").alias(y)) for x, y in (("a", "px"), ("b", "py")))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "px", "py").mapInArrow(lean(run), f"a {kind}, b {kind}")


def _pruned(named: DataFrame) -> DataFrame:
    """The rows of regions that are not done: open items, and the members that one of them may reach. small
    tells whether a task can join the region."""
    differ = named.groupBy("region").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.min(F.when(F.col("open"), F.col("d"))).alias("lo"), F.max(F.when(F.col("open"), F.col("d"))).alias("hi"), F.max("reach").alias("most"))
    differ = differ.where((F.col("first") != F.col("last")) & F.col("lo").isNotNull()).select("region", "lo", "hi", "most")
    near = named.join(differ, "region").where(F.col("open") | ((F.col("d") >= F.col("lo") - F.col("most")) & (F.col("d") <= F.col("hi") + F.col("most"))))
    near = written(near.select("region", "depth", "node", "d", "reach", "weight", "open", "most", "label"), "near")
    sums = near.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.col("open").cast("long")).alias("n_open"), F.sum("weight").alias("total"))
    small = (F.col("depth") > DEPTH) | ((F.col("n") * F.col("n_open") <= AREA) & (F.col("total") <= BYTES))
    return near.join(sums, "region").where("n > 1").withColumn("small", small)


def _divided(regions: DataFrame, items: DataFrame, metric: Metric, kind: str) -> DataFrame:
    """The rows of the cells of regions that no task can join alone."""
    by = Window.partitionBy("region").orderBy(F.xxhash64("node", "depth"), "node")
    chosen = regions.where((F.col("depth") < DEPTH) & F.col("open")).withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= PIVOTS)
    # PIVOTS sketches a region, each bounded by a document
    pivots = chosen.join(items, "node").groupBy("region").agg(F.sort_array(F.collect_list(F.struct("nth", "node", "sketch"))).alias("pivots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for sketch, pivots in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                m = metric.matrix([sketch, *(p["sketch"] for p in pivots)])
                out.append(metric.row(m[1:], m[0]).tolist())
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["row", "far"])

    members = regions.where(F.col("depth") < DEPTH).join(items.select("node", "sketch"), "node").join(pivots, "region")
    row = F.struct("region", "depth", "node", "reach", "weight", "open", "most", F.transform("pivots", lambda p: p["node"]).alias("at"))
    kept = f"struct<region:string,depth:int,node:{kind},reach:int,weight:int,open:boolean,most:int,at:array<{kind}>>"
    far = written(members.select(row.alias("row"), "sketch", "pivots").mapInArrow(lean(run), f"row {kept}, far array<int>").select("row.*", "far"), "far")
    far = far.withColumn("low", F.array_min("far")).withColumn("home", F.array_position("far", F.array_min("far")) - 1)
    # how far the open items of a cell reach from its pivot
    wide = far.where("open").groupBy("region", "home").agg(F.max("low").alias("hi")).groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("home", "hi"))).alias("wide"))
    cells = F.filter(
        F.transform("far", lambda d, i: F.struct(F.element_at("at", i + 1).alias("pivot"), d.alias("d"), (F.col("open") & (F.col("home") == i)).alias("open"), F.element_at("wide", i.cast("long")).alias("hi"))),
        lambda c: c["open"] | ((c["d"] <= F.col("low") + 2 * F.col("most")) & (c["d"] <= c["hi"] + F.col("most"))),
    )
    split = far.join(wide, "region").select("region", "depth", "node", "reach", "weight", F.explode(cells).alias("c"))
    split = split.select(F.concat_ws(".", "region", F.hex("c.pivot")).alias("region"), (F.col("depth") + 1).alias("depth"), "node", F.col("c.d").alias("d"), "reach", "weight", F.col("c.open").alias("open"))
    # the grid: blocks of open items by blocks of members
    side = int(AREA**0.5)
    last = regions.where(F.col("depth") >= DEPTH)
    parts = lambda n: F.greatest(F.ceil(F.col(n) / side), F.ceil(F.col("total") / (BYTES // 4))).cast("int")
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), parts(n)).cast("int")
    name = lambda i, j: F.concat(F.col("region"), F.lit("#"), i, F.lit(","), j)
    columns = lambda is_open: [F.lit(DEPTH + 1).alias("depth"), "node", F.lit(0).alias("d"), "reach", "weight", F.lit(is_open).alias("open")]
    across = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    rows = last.where("open").select("*", across("n").alias("j")).select(name(part(1, "n_open"), F.col("j")).alias("region"), *columns(True))
    cols = last.select("*", across("n_open").alias("i")).select(name(F.col("i"), part(2, "n")).alias("region"), *columns(False))
    grid = rows.union(cols).groupBy("region", "depth", "node").agg(F.max("d").alias("d"), F.max("reach").alias("reach"), F.max("weight").alias("weight"), F.max("open").alias("open"))
    return split.union(grid)


def _by_region(rows: DataFrame, *parts: int) -> DataFrame:
    """Regions one after the other, sorted; a task holds one at a time, whose size ``small`` has bounded."""
    return rows.repartition(*parts, "region").sortWithinPartitions("region", "size", "node")


def _each_region(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[list]]]:
    """The rows of each region of sorted batches, whose first column names it."""
    now, rows = None, []
    for b in batches:
        for region, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if region != now:
                if rows:
                    yield now, rows
                now, rows = region, []
            rows.append(row)
    if rows:
        yield now, rows


def _in_lots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[str], list[int], list[list]]]:
    """Whole regions, until there are ``most`` rows: their names, the number of each row's region, and the rows."""
    names, number, held = [], [], []
    for region, rows in _each_region(batches):
        number += [len(names)] * len(rows)
        names.append(region)
        held += rows
        if len(held) >= most:
            yield names, number, held
            names, number, held = [], [], []
    if held:
        yield names, number, held


def _partnered(regions: DataFrame, items: DataFrame, metric: Metric, kind: str) -> DataFrame:
    """The rows (region, node, open, label) that sizes and sketches allow a link with another one of their
    region, with another label; no other row can give a link there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.int64() if kind == "bigint" else pa.binary()
        for names, number, rows in _in_lots(batches, metric.together):
            left, right, _ = candidates(rows, metric, number)
            at = np.unique(np.concatenate((left, right))).tolist()
            kept = [rows[i] for i in at]
            if kept:
                yield pa.record_batch([pa.array([names[number[i]] for i in at], pa.string()), *(pa.array([r[k] for r in kept], t) for k, t in ((1, of), (2, pa.bool_()), (3, of)))], names=["region", "node", "open", "label"])

    rows = regions.select("region", "node", "open", "label").join(items.select("node", "size", "sketch"), "node")
    return _by_region(rows.select("region", "size", "node", "open", "label", "sketch")).mapInArrow(lean(run), f"region string, node {kind}, open boolean, label {kind}")


def _joined(regions: DataFrame, items: DataFrame, payloads: DataFrame, metric: Metric, kind: str) -> DataFrame:
    """(a, b): links that connect what all links within each region connect, given the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.int64() if kind == "bigint" else pa.binary()
        for _, number, rows in _in_lots(batches, metric.together):
            if found := region_links(rows, metric, number):
                yield pa.record_batch([pa.array([x for x, _ in found], of), pa.array([y for _, y in found], of)], names=["a", "b"])

    rows = regions.join(items.drop("weight"), "node").join(payloads, "node")
    # few bytes may mean many pairs, so tasks are not put together by their bytes
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _by_region(rows.select("region", "size", "node", "open", "label", "sketch", "payload"), parts).mapInArrow(lean(run), f"a {kind}, b {kind}")


def candidates(rows: list[list], metric: Metric, number: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, distance) of the pairs of a region's rows (size, node, open, label, sketch, ...), which
    come by size, that have different labels, one open item at least, and sizes and sketches that allow a link.
    Of several regions, one after the other, ``number`` tells each row's."""
    size, _, is_open, names, sketches, *_ = zip(*rows, strict=True)
    size, is_open, codes = np.array(size, np.int64), np.array(is_open, bool), {}
    label = np.array([codes.setdefault(x, len(codes)) for x in names])
    left, right, dist = [], [], []
    opened = np.flatnonzero(is_open)
    if len(codes) > 1 and len(opened):
        matrix = metric.matrix(list(sketches))
        region = np.array(number, np.int64) << 32 if number else np.zeros(len(rows), np.int64)
        place = region + size
        sizes, of = np.unique(size[opened], return_inverse=True)
        low, high = np.array([metric.partners(x) for x in sizes.tolist()], np.int64).T
        lo = np.searchsorted(place, region[opened] + np.maximum(low[of], 0))
        n = np.searchsorted(place, region[opened] + np.minimum(high[of], (1 << 32) - 1), "right") - lo
        ends = np.cumsum(n)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + PAIRS, PAIRS), "right"))
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(opened)], strict=True):
            count = n[first:last]
            i = np.repeat(opened[first:last], count)
            j = np.arange(len(i)) + np.repeat(lo[first:last] - (np.cumsum(count) - count), count)
            # a pair of open items counts once
            apart = np.flatnonzero((label[i] != label[j]) & ((j > i) | ~is_open[j]))
            i, j = i[apart], j[apart]
            d = metric.row(matrix[i], matrix[j])
            ok = d <= metric.most(size[i], size[j])
            left.append(i[ok].astype(np.int32))
            right.append(j[ok].astype(np.int32))
            dist.append(d[ok])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int32) for x in (left, right, dist))


def region_links(rows: list[list], metric: Metric, number: list[int] | None = None) -> list[tuple]:
    """Links of one region (or several, as in ``candidates``), whose rows (size, node, open, label, sketch,
    payload) come by size."""
    left, right, dist = candidates(rows, metric, number)
    node, names, payload = ([r[k] for r in rows] for k in (1, 3, 5))
    codes: dict = {}
    label = np.array([codes.setdefault(x, len(codes)) for x in names], np.int64)
    order = np.argsort(dist, kind="stable")
    left, right = left[order], right[order]
    parent, out = np.arange(label.max(initial=-1) + 1), []
    lo, step = 0, LOOK[0]
    while lo < len(left):
        i, j = left[lo : lo + step], right[lo : lo + step]
        lo += step
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        apart = parent[label[i]] != parent[label[j]]
        i, j = i[apart].tolist(), j[apart].tolist()
        linked = metric.linked_each([payload[x] for x in i], [payload[y] for y in j])
        for x, y, ok in zip(i, j, linked, strict=True):
            a, b = label[x], label[y]
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if ok and a != b:
                parent[max(a, b)] = min(a, b)
                out.append((node[x], node[y]))
        # where many pairs link, the links found spare comparing the next ones
        step = LOOK[0] if 4 * sum(linked) > len(linked) else min(2 * step, LOOK[1])
    return out
