"""Document fingerprints by winnowing, with native operators only.

A text is cut into units, runs of at most UNIT characters without white space; characters of scripts that
are written without spaces between words (Chinese, Japanese, Korean) are units each. Each K consecutive units
give one hash of a rolling polynomial over the units' hashes; of each W consecutive hashes the smallest
is kept, the rightmost of equal ones, with its position. Any passage of K + W - 1 units that two texts
share therefore gives them a common hash (the match guarantee), and no common hash stems from less than
K units, but for hash collisions.

The fingerprint is text: ``position:hash`` in order of position, hashes in hexadecimal, joined by
commas. The likeness of two fingerprints is the Dice coefficient of their hash sets.

Edge cases: a null text counts as empty; an empty or blank text has the empty fingerprint, which is
like another empty one (1) and unlike any other (0); fewer units than K give one hash, of all of them;
rows with a null doc_id sort last in the descending order; rows that repeat a doc_id follow each other
in order of their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, written

K, W, UNIT = 3, 8, 16
#: Ideographs, kana and hangul, as a set of a pattern.
ALONE = r"\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF"
#: All other characters but white space, by ranges; the first one holds nearly all characters of most texts.
OTHER = r"\x21-\u303F\x00-\x08\x0E-\x1F\u3100-\u33FF\u4DC0-\u4DFF\uA000-\uABFF\uD7B0-\uF8FF\uFB00-\x{10FFFF}"
#: Of the rolling polynomial: a prime below 2^31, so that products stay below 2^63, and a base.
PRIME, BASE = 2147483629, 1000003


def winnow(text: Column) -> Column:
    """Array of kept entries, hash * 2^32 + (2^32 - 1 - position), in order of position.

    The packing makes the plain minimum of a window its smallest hash and, of equal ones, the rightmost.
    """
    units = F.regexp_extract_all(text, F.lit(rf"[{OTHER}]{{1,{UNIT}}}+|[{ALONE}]"), F.lit(0))
    hashes = F.transform(units, lambda u: F.pmod(F.xxhash64(u), F.lit(PRIME)))

    def grams(h: Column) -> Column:
        # the rolling value of K units, in K - 1 passes over the shifted array; a short text rolls over all it has
        rolled = h
        for k in range(1, K):
            rolled = F.when(F.size(h) > k, F.zip_with(F.slice(rolled, F.lit(1), F.size(rolled) - 1), F.slice(h, F.lit(k + 1), F.size(h) - k), lambda a, b: (a * BASE + b) % PRIME)).otherwise(rolled)
        packed = lambda x, i: x * (1 << 32) + ((1 << 32) - 1) - i

        def gram(x: Column, i: Column) -> Column:
            for k in range(1, K):
                x = (x * BASE + F.get(h, i + k)) % PRIME
            return packed(x, i)

        # K units or more take a single pass
        return F.when(F.size(h) >= K, F.transform(F.slice(h, F.lit(1), F.size(h) - (K - 1)), gram)).otherwise(F.transform(rolled, packed))

    # each step is bound to a name by a one-element array, so that it is computed once
    bound = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)

    def minima(out: Column, width: int = 1) -> Column:
        # window minima by doubling: after each pass an entry covers twice as many hashes. A pass reads the one
        # before several times, so that one is bound as well
        step = min(width, W - width)
        wider = F.when(F.size(out) > step, F.zip_with(F.slice(out, F.lit(1), F.size(out) - step), F.slice(out, F.lit(step + 1), F.size(out) - step), lambda a, b: F.least(a, b))).otherwise(F.when(F.size(out) > 0, F.array(F.array_min(out))).otherwise(out))
        return wider if width + step == W else bound(wider, lambda x: minima(x, width + step))

    return bound(hashes, lambda h: bound(grams(h), lambda g: F.array_distinct(minima(g))))


def hashes_of(kept: Column) -> Column:
    return F.transform(kept, lambda x: F.shiftright(x, 32))


def fingerprint(kept: Column) -> Column:
    """The entries as text."""
    return F.array_join(F.transform(kept, lambda x: F.concat((F.lit((1 << 32) - 1) - x.bitwiseAND(F.lit((1 << 32) - 1))).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftright(x, 32))))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the hash sets of two arrays of entries."""
    x, y = F.array_distinct(hashes_of(a)), F.array_distinct(hashes_of(b))
    pair = F.struct(x.alias("x"), y.alias("y"))
    dice = lambda p: F.when(F.size(p["x"]) + F.size(p["y"]) == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(p["x"], p["y"])) / (F.size(p["x"]) + F.size(p["y"])))
    return F.element_at(F.transform(F.array(pair), dice), 1)


def _cuts(docs: DataFrame) -> list[int]:
    """Quantiles of the ids, descending: as many numbers as buckets, however many documents."""
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20_000).alias("q")).first()["q"] or []
    return sorted({int(c) for c in found}, reverse=True)


def _bucket(cuts: list[int]) -> Column:
    """How many cuts lie above the id, by a search in two steps: the coarse cut, then its neighbours."""
    if not cuts:
        return F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    wide = max(1, int(len(cuts) ** 0.5))
    heads, whole = F.array(*[F.lit(c).cast("long") for c in cuts[::wide]]), F.array(*[F.lit(c).cast("long") for c in cuts])
    low = F.greatest(F.size(F.filter(heads, lambda c: c > F.col("doc_id"))) - 1, F.lit(0)) * wide
    place = low + F.size(F.filter(F.slice(whole, low + 1, F.lit(wide)), lambda c: c > F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(place)


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text, a (the kept entries of the text) of ``documents`` (doc_id, text), with the text and
    entries of the next document as ``next``: descending doc_id, the first after the last.

    Rows move once, to buckets of the id range; a window gives the next row within a bucket. What a
    bucket starts with, one row a bucket, joins the end of the bucket before it by that bucket's number,
    so the rows stay where they are.
    """
    placed = documents.withColumn("bucket", _bucket(_cuts(documents)))
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    # the first window moves the rows; entries are made after it, and the second one finds them in place
    rows = placed.withColumn("nth", F.row_number().over(w)).withColumn("a", winnow(F.col("text"))).withColumn("next", F.lead(F.struct("text", "a")).over(w))
    # a row for each bucket, from ids alone; of equal ids the smallest text comes first, as in the window
    top = written(placed.groupBy("bucket").agg(F.max("doc_id").alias("top")), "top")
    first = documents.join(F.broadcast(top), F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.min("text").alias("text"))
    numbers = Window.orderBy("bucket")
    before = top.select("bucket", F.lag("bucket").over(numbers).alias("before"), F.max("bucket").over(numbers.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    ends = first.join(before, "bucket").select(F.coalesce("before", "last").alias("bucket"), F.struct("text", winnow(F.col("text")).alias("a")).alias("start"))
    return rows.join(ends, "bucket", "left").select("doc_id", "text", "a", F.coalesce("next", "start").alias("next"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, n_kept for each row of ``documents`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    kept = documents.select("doc_id", F.length(text).cast("long").alias("n_chars"), winnow(text).alias("kept"))
    return kept.select("doc_id", "n_chars", fingerprint(F.col("kept")).alias("fingerprint"), F.size("kept").alias("n_kept"))


def compare_with_edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text (its last half replaced by the start of the next
    document) and how like the text's are the edited text's and the next document's."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    entries = both.select("doc_id", n.cast("long").alias("n_chars"), "a", F.col("next.a").alias("c"), edited.alias("edited"))
    entries = entries.withColumn("b", winnow(F.col("edited")))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return entries.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"))
