"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding makes one alphabet of what readers take for one: styled forms and accents fall away,
look-alike letters of other scripts and digits or signs used as letters become the Latin letters they
stand for, invisible characters go. A text is also read with its accents and signs as they are. The
automaton holds the terms and their exception phrases; a term counts where it is a whole word and no
exception phrase covers it. A document's features are its summed weight and that weight normalised by
length; a logistic of both gives the score.

The lexicon starts from a few plain insults and gains terms and weights from labelled rows of the
training fold: words that are in toxic texts more often than chance can explain, and hardly in others.
Terms are words, with or without digits, and pairs of words neither of which is a term itself. Near copies
of a text vote once, so that the words of a text that was copied don't count as its insults. The rows are
bounded (``most_rows``), and with them the terms; every term that passes is taken.

Edge cases: a null or empty text holds no term and gets the score of a text without terms; null or
repeated doc_ids are scored like any other rows; without labels of both kinds the seed weights stand; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written
from .quality import held_out, training_rows

THRESHOLD = 0.5
MOST_ROWS = 20_000
#: Characters of a word that may become a term.
SHORTEST, LONGEST = 2, 40

#: Plain insults to start from.
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown")
#: Phrases in which a term is not meant as an insult.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "take out the trash", "clown fish", "clown shoes", "circus clown", "rodeo clown",
    "idiot proof", "idiot board", "loser bracket", "sore loser clause", "pond scum", "soap scum", "worthless check", "worthless securities", "oxymoron",
)
#: Look-alikes in Cyrillic and Greek.
LOOKALIKES = dict(zip("авсԁеһіјкӏмнорԛгѕтѵѡхуαβεικνορτυχ", "abcdehijklmhopqrstvwxyabeiknoptux", strict=True))
#: Digits and signs written for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}


class _Fold(dict):
    """For str.translate: what each character becomes, one character at most. Look-alikes and wide or
    styled forms become plain letters, accents stay, invisible characters go, and what is neither letter
    nor digit nor a sign used as one becomes a blank."""

    def __missing__(self, point: int):
        c = chr(point)
        if c in " \t\n\r\x0b\x0c":
            out: str | None = " "
        elif unicodedata.category(c) in ("Cf", "Mn", "Me", "Cc"):
            out = None
        else:
            wide = unicodedata.normalize("NFKC", c).lower()[:1] or " "
            wide = LOOKALIKES.get(wide, wide)
            out = wide if wide.isalnum() or wide in LEET else " "
        self[point] = out
        return out


class _Bare(dict):
    """For str.translate after a fold: letters without their accents."""

    def __missing__(self, point: int):
        out = self[point] = unicodedata.normalize("NFKD", chr(point))[:1]
        return out


_FOLDED, _BARE = _Fold(), _Bare()
_LEET = str.maketrans(LEET)
_EDGES = "".join(c for c in LEET if not c.isalnum())
#: Signs at the end of a word.
_ENDS = re.compile(rf"(?<=[^\s{re.escape(_EDGES)}])[{re.escape(_EDGES)}]+(?=\s|$)")


def fold(text: str) -> list[str]:
    """The different readings of a text: folded; without accents; with digits and signs as letters; and with
    those but the signs that end a word. White space is one blank.

    A sign at the end of a word is mostly punctuation ("stupid!!", "1d10t!") and an accent may tell two
    words apart, so terms may match in any reading.
    """
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    plain = " ".join(text.translate(_FOLDED).split())
    bare = plain if plain.isascii() else plain.translate(_BARE)
    ended = _ENDS.sub(lambda m: " " * len(m[0]), bare)
    return list(dict.fromkeys((plain, bare, bare.translate(_LEET), ended.translate(_LEET))))


class Lexicon:
    """Terms with weights and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        for term, w in weights.items():
            self.automaton.add_word(term, (len(term), w))
        for phrase in exceptions:
            if phrase not in weights:
                self.automaton.add_word(phrase, (len(phrase), None))
        self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms that count, in the folded text with one blank between words."""
        terms: dict[int, tuple[int, float]] = {}
        for read in fold(text):
            covered: list[tuple[int, int]] = []
            here: list[tuple[int, int, float]] = []
            for last, (n, w) in self.automaton.iter(read):
                start, end = last + 1 - n, last + 1
                if (start and read[start - 1].isalnum()) or (end < len(read) and read[end].isalnum()):
                    continue
                if w is None:
                    covered.append((start, end))
                else:
                    here.append((start, end, w))
            for start, end, w in here:
                if not any(a <= start and end <= b for a, b in covered):
                    terms[start] = (end, w)
        return [(a, b, w) for a, (b, w) in sorted(terms.items())]

    def features(self, text: str | None) -> tuple[float, float]:
        total = sum(w for *_, w in self.found(text)) if text else 0.0
        return math.log1p(total), total / math.sqrt(1 + len(text or "") / 100)


def _words(text: str) -> set[str]:
    """Words after folding, as they stand and with digits and signs as letters, and pairs of neighbours."""
    words = [w.strip(_EDGES) for w in fold(text)[0].split()]
    plain = [w.translate(_BARE).translate(_LEET) if not w.isalpha() else w for w in words]
    fits = lambda w: SHORTEST <= len(w) <= LONGEST and not w.isdigit()
    pairs = {f"{a} {b}" for a, b in zip(plain, plain[1:], strict=False) if fits(a) and fits(b)}
    return {w for w in {*words, *plain} if fits(w)} | pairs


def fit_lexicon(training: DataFrame) -> dict[str, float]:
    """Weights of the terms, from (label, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, rows, words = [], [], []
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or ""
                found = sorted(_words(text))
                # near copies mostly share their smallest shingle hash; they vote once
                w = text.split()
                sign = min((xxhash.xxh3_64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0)
                labels += [y] * len(found)
                rows += [sign] * len(found)
                words += found
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(labels, pa.int32()), pa.array(rows, pa.uint64()).view(pa.int64())], names=["word", "label", "row"])

    pairs = training.select("label", "text").mapInArrow(run, "word string, label int, row long").distinct()
    n1 = training.where("label = 1").count()
    n0 = training.count() - n1
    out = dict.fromkeys(SEEDS, 3.0)
    if not n0 or not n1:
        return out
    counts = written(pairs.groupBy("word").agg(F.sum("label").alias("d1"), F.sum(1 - F.col("label")).alias("d0")).where("d1 + d0 >= 3"), "counts")
    # of so many words, less than one comes by chance into d1 toxic texts and none else
    least = math.log(2 * max(1, counts.count())) / math.log((n0 + n1) / n1)
    found = counts.where((F.col("d1") >= least) & (F.col("d0") * 10 <= F.col("d1"))).collect()  # of the words of most_rows texts
    release(counts)
    alone = {r["word"] for r in found if " " not in r["word"]}
    for r in found:
        if r["word"] in alone or not alone & set(r["word"].split()):
            out[r["word"]] = math.log((r["d1"] + 0.5) / (n1 + 1)) - math.log((r["d0"] + 0.5) / (n0 + 1))
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a slight pull to zero."""
    z = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(z.shape[1]), np.array([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_terms for each row of ``documents`` (doc_id, text)."""
    training = training_rows(documents, labels, "toxic", folds, fold, most_rows)
    lexicon = fit_lexicon(training)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(lexicon)
        for b in batches:
            x = np.array([known.features(t.as_py()) for t in b.column(1)]).reshape(-1, 2)
            yield pa.record_batch([b.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["label", "a", "b"])

    rows = np.array(sorted(training.select("label", "text").mapInArrow(measure, "label int, a double, b double").collect())).reshape(-1, 3)
    w = _fit(rows[:, 1:], rows[:, 0]) if 0 < rows[:, 0].sum() < len(rows) else np.array([-3.0, 3.0, 0.5])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(lexicon)
        for b in batches:
            out, n = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                found = known.found(text)
                total = sum(x for *_, x in found)
                z = w[0] + w[1] * math.log1p(total) + w[2] * total / math.sqrt(1 + len(text) / 100)
                out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
                n.append(len(found))
            yield pa.record_batch([b.column(0), pa.array(out, pa.float64()), pa.array(n, pa.int32())], names=["doc_id", "score", "n_terms"])

    scored = documents.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, n_terms int")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_terms")
