"""Mix sources to target weights: hash-random keys, range sort within each source, distributed prefix
sums of word counts, and a cut at each source's exact budget, with repeated epochs where needed.

Native operators only. Edge cases: a null text has size 0 and takes nothing; an empty table gives an
empty result; a null source is a source of its own and sorts last; null and repeated doc_ids are rows
like any other (equal rows share what falls to them in either order); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, written
from .prefix import running_totals

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more often than this.
MOST_EPOCHS = 3
#: Boundaries of so many sources at most are broadcast (some 20 MB); more are joined.
MOST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row for each source: its rank, size, weight and target.

    All sizes are shared out by weight; a target above ``most`` times its source's size stops there and
    the excess goes to the others by weight. The fixed point is a water level, found by sorting the
    sources by cap / weight: those whose cap lies below the level fill up first. The input has one row
    a source, so its one-partition windows stay small.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(everything) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier, later = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(later))
    # the level of the first source that does not fill up holds for all after it
    s = s.withColumn("level", F.min(F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(whole)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(F.col("level"), F.lit(0.0)))
    return s.select("rank", "source", "source_size", "weight", target.alias("target"))


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _cut(documents: DataFrame, weights: tuple[int, ...], most: int, seed: str, carry: dict[str, Column]) -> DataFrame:
    """Ids and sizes, no texts: doc_id, key, size, before (the words of the source's rows that sort
    earlier), rank, source, source_size, target, epochs, rest and ``carry``."""
    sized = written(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), *[c.alias(n) for n, c in carry.items()]), "sized")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)))
    goals = goals.withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
    keyed = sized.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "weight").withColumn("key", _key(seed))
    return running_totals(keyed, "rank", ["key", "doc_id", "size", *carry], "size", "before")


def mix_to_weights(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix-1") -> DataFrame:
    """For each row of ``documents`` (doc_id, text, source): its size in words, its source's size and
    target, and the words taken of it.

    Each source is taken whole as often as its target holds it, then once more in random order up to
    the exact remainder; the document at the cut gives only the words still wanted. The order is that of
    md5(seed:doc_id), so reruns agree on any cluster.
    """
    cut = _cut(documents, weights, most, seed, {})
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("before")))
    return cut.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix-1") -> DataFrame:
    """The mix itself: each document as often as it is taken whole, and once more up to its last word
    taken if it is cut. Columns are those of ``documents``; n_chars follows the text.

    Only ids, sizes and a hash of the text go through the prefix sums. They give one boundary for each
    source: the place in its order where the last epoch ends. Texts stay where they are, and each row is
    held against its source's boundary. Rows that are equal in id, source and text are told apart only
    where the boundary falls among them.
    """
    columns = documents.columns
    cut = _cut(documents, weights, most, seed, {"hash": F.xxhash64("text")})
    place = ["key", "doc_id", "size", "hash"]
    equal = cut.groupBy("rank", "source", "epochs", "rest", *place).agg(F.min("before").alias("first"), F.count("*").alias("n"))
    last = F.min(F.when(F.col("first") + F.col("size") * F.col("n") > F.col("rest"), F.struct(*place, (F.col("rest") - F.col("first")).alias("left"), "n"))).alias("_last")
    bounds = written(equal.groupBy("rank", F.col("source").alias("_source"), F.col("epochs").alias("_epochs")).agg(last).drop("rank"), "bounds")
    wide = bounds.count() > MOST_SOURCES
    rows = documents.withColumn("_row", F.struct(_key(seed).alias("key"), "doc_id", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash")))
    rows = rows.join(bounds if wide else F.broadcast(bounds), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    edge = F.col("_last").isNotNull() & (F.col("_row") == F.struct(*[F.col("_last")[c].alias(c) for c in place]))
    rows = rows.withColumn("_edge", F.coalesce(edge, F.lit(False))).withColumn("_nth", F.lit(0))
    if not bounds.where("_last.n > 1").isEmpty():
        # only rows at a boundary that falls among equal rows are numbered
        many = F.col("_edge") & (F.col("_last.n") > 1)
        number = F.row_number().over(Window.partitionBy("_row").orderBy(F.xxhash64(*[c for c, kind in documents.dtypes if not kind.startswith("map")]))) - 1
        rows = rows.where(~many).unionByName(rows.where(many).withColumn("_nth", number))
    size = F.col("_row.size")
    left = F.greatest(F.lit(0).cast("long"), F.least(size, F.col("_last.left") - F.col("_nth") * size))
    before = F.col("_last").isNull() | (F.col("_row") < F.struct(*[F.col("_last")[c].alias(c) for c in place]))
    extra = F.when(F.col("_edge"), left).when(before, size).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("_rest", F.when(extra < size, extra).otherwise(0).cast("int")).withColumn("_whole", (F.col("_epochs") + F.when((extra == size) & (size > 0), 1).otherwise(0)).cast("int"))
    rows = rows.where((size > 0) & (F.col("_whole") + F.col("_rest") > 0))
    each = rows.withColumn("_copy", F.explode(F.expr("sequence(1, _whole + if(_rest > 0, 1, 0))")))
    words = F.regexp_extract_all("text", F.lit(rf"[{SPACE}]*{WORD}"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("_rest")), "")
    each = each.withColumn("text", F.when(F.col("_copy") > F.col("_whole"), part).otherwise(F.col("text")))
    return each.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])
