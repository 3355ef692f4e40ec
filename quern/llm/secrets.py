"""Secret scans with native operators only: known forms by pattern, others by a randomness test battery.

Known forms ("base" spans) are assignments, access keys and hexadecimal runs. Other candidates are runs
of encoding characters. For each its encoding is inferred from the characters it uses (hexadecimal,
base 32, base 36, base 62 or base 64), and three tests ask whether it looks like random symbols of that alphabet:
a chi-squared test of uniformity, a runs test (above and below the middle of the alphabet) and the serial
correlation of neighbours. Words, paths and names fail them; keys pass. The three p-values give one for
each candidate (three times the smallest, at most 1). Candidates whose randomness is rejected are
dropped, and the rejections are controlled for false discovery within each class of length, over the whole
corpus, by Benjamini and Hochberg's step-up rule; so a true key of any length is dropped at a rate of
the level at most. P-values are counted in fine steps, one row for each class and step, so the rule needs
no sort of all candidates.

Spans hold code points, the end exclusive. Edge cases: a null or empty text has no spans; null or
repeated doc_ids are rows like any others; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Fixed patterns of the base spans: (kind, pattern, value group, least length of it).
BASE = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Cheap tests that a text has to meet before its spans of a kind are located.
HINTS = {"assign": BASE[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Other candidates: long runs of encoding characters; one needs a digit and a letter.
CANDIDATE, LEAST = r"[A-Za-z0-9+/_-]+", 20
HINT = rf"[A-Za-z0-9+/_-]{{{LEAST}}}"
KIND = "random"
ORDER = ("assign", "access", "hex", KIND)
LEVEL = 0.01
#: Bounds of the classes of length, and steps of ln p.
CLASSES, STEPS = (28, 40, 64), 64


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(lengths: Column) -> Column:
    """Running sums of an array of one entry or more. Entries are added up in pieces of the root of their
    number and then piece by piece, as an array that grows by one is copied each time."""
    at = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    sums = lambda x: F.aggregate(x, at(), lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"] + v)).alias("out")), lambda a: a["out"])
    size = F.ceil(F.sqrt(F.size(lengths))).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.size(lengths), size), lambda lo: F.slice(lengths, lo, size))
    joined = lambda p: F.flatten(F.zip_with(p, sums(F.transform(p, lambda x: F.element_at(x, -1))), lambda x, end: F.transform(x, lambda v: v + end - F.element_at(x, -1))))
    return _bound(F.transform(pieces, sums), joined)


def _located(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, end, kind, value) of the non-overlapping matches from the left, of which there is one
    at least. The text is cut at the matches; running lengths of what lies between give the positions."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(found: Column) -> Column:
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = _bound(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), _running)
        rows = F.arrays_zip(ends.alias("end"), found.alias("match"), value.alias("value"))
        return F.transform(F.filter(rows, lambda r: F.length(r["value"]) >= least), lambda r: F.struct((r["end"] - F.length(r["match"])).alias("start"), r["end"].alias("end"), F.lit(kind).alias("kind"), r["value"].alias("value")))

    return _bound(whole, spans)


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, hint: str) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    # hexadecimal and candidate runs are short in prose: only those long enough part the text
    bounded = {"hex": rf"[0-9a-f]{{{least},}}", KIND: rf"[A-Za-z0-9+/_-]{{{least},}}"}.get(kind, pattern)
    found = _located(text, kind, bounded, group, least)
    if kind == KIND:
        found = F.filter(found, lambda s: F.regexp_like(s["value"], F.lit("[0-9]")) & F.regexp_like(s["value"], F.lit("[A-Za-z]")))
    return F.when(F.regexp_like(text, F.lit(hint)), found).otherwise(none)


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in ORDER]), kind)


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("r"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _tail(z: Column) -> Column:
    """The upper tail of the normal distribution at z >= 0, by a rational approximation good to 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.lit(1e-300), 0.3989422804014327 * F.exp(-z * z / 2) * poly)


def battery(value: Column) -> Column:
    """The p-value that a string is random in its inferred alphabet; null if it has no encoding: a code
    needs a digit and a letter."""
    has = lambda p: F.regexp_like(value, F.lit(p))
    mixed = has("[0-9]") & has("[A-Za-z]")
    alphabet = (
        F.when(~has("[^0-9a-f]") | ~has("[^0-9A-F]"), F.lit("0123456789abcdef"))
        .when(~has("[^A-Z2-7]"), F.lit("abcdefghijklmnopqrstuvwxyz234567"))
        .when(~has("[^0-9a-z]") | ~has("[^0-9A-Z]"), F.lit("0123456789abcdefghijklmnopqrstuvwxyz"))
        .when(~has("[^0-9A-Za-z]"), F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
        .otherwise(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"))
    )

    def coded(letters: Column) -> Column:
        text = F.when(F.length(letters) <= 36, F.lower(value)).otherwise(value)
        size = F.least(F.length(letters), F.lit(64)).cast("double")  # two spellings of the last two signs
        codes = F.transform(F.split(text, ""), lambda c: F.least(F.instr(letters, c) - 1, F.lit(63)).cast("double"))
        return _bound(F.struct(codes.alias("x"), size.alias("k")), tests)

    # what a loop over the characters uses is bound before it, so that no loop runs within another
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, c: a + c)
    beside = lambda x, f: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), f)

    def tests(p: Column) -> Column:
        x, k = p["x"], p["k"]
        n = F.size(x).cast("double")
        high = F.transform(x, lambda c: F.when(c >= k / 2, 1.0).otherwise(0.0))
        counts = F.transform(F.array_distinct(x), lambda c: F.size(F.filter(x, lambda y: y == c)).cast("double"))
        sums = F.struct(k.alias("k"), n.alias("n"), high.alias("high"), counts.alias("counts"), (total(x) / n).alias("mean"), x.alias("x"))
        return _bound(sums, lambda q: _bound(F.struct(q["k"].alias("k"), q["n"].alias("n"), q["high"].alias("high"), q["counts"].alias("counts"), centred(q["x"], q["mean"]).alias("d")), p_value))

    def centred(x: Column, mean: Column) -> Column:
        return F.transform(x, lambda c: c - mean)

    def p_value(q: Column) -> Column:
        k, n, high, d = q["k"], q["n"], q["high"], q["d"]
        squares = total(F.transform(q["counts"], lambda c: c * c))
        # the statistic's exact mean and variance under uniformity; its cube root is close to normal
        chi, df = k / n * squares - n, k - 1
        chi_z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        ones, changes = total(high), total(beside(high, lambda a, b: F.abs(a - b)))
        expected = 2 * ones * (n - ones) / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        runs_z = F.when((ones == 0) | (ones == n), F.sqrt(n)).otherwise(F.abs(changes + 1 - expected) / spread)
        variance, lagged = total(F.transform(d, lambda c: c * c)), total(beside(d, lambda a, b: a * b))
        serial_z = F.when(variance <= 0, F.sqrt(n)).otherwise(F.abs(lagged / variance + 1 / n) * F.sqrt(n))
        return _bound(F.struct(chi_z.alias("chi"), runs_z.alias("runs"), serial_z.alias("serial")), least)

    def least(z: Column) -> Column:
        chi_p = F.when(z["chi"] >= 0, _tail(F.abs(z["chi"]))).otherwise(1 - _tail(F.abs(z["chi"])))
        return F.least(F.lit(1.0), 3 * F.least(chi_p, 2 * _tail(z["runs"]), 2 * _tail(z["serial"])))

    return F.when(mixed, _bound(alphabet, coded))


def rejected(candidates: DataFrame, level: float = LEVEL) -> DataFrame:
    """class, step: the largest step of -ln p that is not rejected is below ``step``; classes without a
    rejection have no row. ``candidates`` has (class, step); there are as many rows as steps at most."""
    counts = candidates.groupBy("class", "step").agg(F.count("*").alias("n"))
    smallest = Window.partitionBy("class").orderBy(F.col("step").desc())
    all_of = Window.partitionBy("class")
    rows = counts.withColumn("rank", F.sum("n").over(smallest)).withColumn("m", F.sum("n").over(all_of))
    return rows.where(F.exp(-F.col("step") / STEPS) <= level * F.col("rank") / F.col("m")).groupBy("class").agg(F.min("step").alias("cut"))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _pieces(spans: Column) -> Column:
    """Spans by start, in pieces of the root of their number with where each piece starts and ends, so that
    a search looks at few of them."""
    size = F.ceil(F.sqrt(F.size(spans))).cast("int")
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.size(x), size), lambda lo: F.slice(x, lo, size))
    row = lambda p: F.struct(p.alias("spans"), F.element_at(p, 1)["start"].alias("start"), F.array_max(F.transform(p, lambda s: s["end"])).alias("end"))
    return F.transform(_bound(F.array_sort(spans), cut), row)


def scan(documents: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, spans (array of start, end, kind, value) and base, the known ones among them."""
    text = F.coalesce("text", F.lit(""))
    base = F.concat(*[_spans(text, *b, HINTS[b[0]]) for b in BASE])
    other = _spans(text, KIND, CANDIDATE, 0, LEAST, HINT)
    rows = documents.select("doc_id", base.alias("base"), other.alias("other"))
    free = F.when(F.size("base") > 0, _bound(_pieces(F.col("base")), lambda p: F.filter("other", lambda o: ~F.exists(p, lambda q: _overlap(q, o) & F.exists(q["spans"], lambda s: _overlap(s, o)))))).otherwise(F.col("other"))
    rows = rows.withColumn("other", F.when(F.size("other") > 0, free).otherwise(F.col("other")))
    step = lambda p: F.floor(-F.log(p) * STEPS).cast("int")
    place = lambda v: sum((F.when(F.length(v) >= c, 1).otherwise(0) for c in CLASSES), F.lit(0))
    tested = F.filter(F.transform("other", lambda o: F.struct(o.alias("span"), battery(o["value"]).alias("p"))), lambda o: o["p"].isNotNull())
    tested = F.transform(tested, lambda o: F.struct(o["span"].alias("span"), place(o["span"]["value"]).alias("class"), step(o["p"]).alias("step")))
    rows = written(rows.select("doc_id", "base", F.when(F.size("other") > 0, tested).alias("tested")), "spans")
    # one number for each class of length
    cuts = rejected(rows.select(F.explode("tested").alias("t")).select("t.class", "t.step"), level).collect()
    passed = F.filter("tested", lambda t: t["step"] < _cut(t["class"], {r["class"]: r["cut"] for r in cuts}))
    added = F.coalesce(F.transform(passed, lambda t: t["span"]), F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>"))
    return rows.select("doc_id", "base", F.concat("base", added).alias("spans"))


def _cut(place: Column, cuts: dict[int, int]) -> Column:
    out = F.lit(1 << 30)
    for c, cut in cuts.items():
        out = F.when(place == c, cut).otherwise(out)
    return out


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans, base_sha256 and spans (kind:start:end, joined by commas)."""
    found = scan(documents)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind, *_ in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
