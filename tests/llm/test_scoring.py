from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality, toxicity

from .conftest import words


def labelled(spark, column, n=240):
    """Documents of which every third is bad: an insult or shouting, by label."""
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        text, bad = words(rng, rng.randint(15, 60)), i % 3 == 0
        if bad and column == "toxic":
            parts = text.split(" ")
            parts.insert(len(parts) // 2, rng.choice(["idiot", "m0ron!!", "groblin", "groblin", "Groblin,"]))
            text = " ".join(parts)
        elif bad:
            text = text.upper().replace(" ", "!! ")
        docs.append((i, text))
        labels.append((i, int(bad == (column == "toxic")), int(bad == (column == "toxic"))))
    labels += [(9999, 1, 1), (0, None, None), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int").where("doc_id is null or doc_id != 0 or toxic is not null")


def held_out_accuracy(scored, labels, column):
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", column).collect()
    return np.mean([a == b for a, b in rows]), len(rows)


def test_quality_learns_and_holds_out(spark):
    docs, labels = labelled(spark, "quality")
    scored = quality.score_quality(docs, labels).cache()
    for r in scored.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    accuracy, n = held_out_accuracy(scored, labels, "quality")
    assert n > 30 and accuracy > 0.9
    # labels of the held-out fold change nothing
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id"), 4, 2), 0).otherwise(F.col("quality")))
    assert sorted(quality.score_quality(docs, other).collect()) == sorted(scored.collect())


def test_toxicity_learns_terms_and_holds_out(spark):
    docs, labels = labelled(spark, "toxic")
    scored = toxicity.score_toxicity(docs, labels).cache()
    accuracy, n = held_out_accuracy(scored, labels, "toxic")
    assert n > 30 and accuracy > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in scored.collect())


def test_scores_of_odd_cases(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for f in (quality.score_quality, toxicity.score_toxicity):
        assert f(no_documents, labels).count() == 0
        rows = f(odd_documents, labels).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)


@pytest.mark.parametrize(
    ("text", "hit"),
    [("you idiot", True), ("IDIOT!!", True), ("1d10t", True), ("іdіоt", True), ("i​diot", True), ("ｉｄｉｏｔ", True), ("ídïot.", True), ("idiotic", False), ("an idiot proof lid", False), ("an idiot", True), ("idiot proof idiot", True), ("", False), ("scum", True), ("pond scum", False), ("oxymoron", False), ("1d10t!", True), ("what a $cum!!", True), ("pond\n scum", False)],
)
def test_folding_and_exceptions(text, hit):
    assert bool(toxicity.Lexicon(dict.fromkeys(toxicity.SEEDS, 3.0)).found(text)) == hit


def test_toxicity_is_normalised_by_length():
    known = toxicity.Lexicon({"idiot": 3.0})
    short, long = known.features("idiot"), known.features("idiot " + "fine " * 2000)
    assert short[0] == long[0] and short[1] > long[1] > 0


def test_contexts_equal_a_plain_sum():
    index = quality.index_vectors()
    at = np.argsort(index == 0, axis=1, kind="stable")[:, : quality.ONES]
    total, want = np.zeros((quality.ROWS, quality.DIMS)), np.zeros((quality.ROWS, quality.DIMS))
    w = np.array([5, 7, 5, 9, -1, -1, 7, 7, 3])
    quality._add_contexts(total, w, at, np.take_along_axis(index, at, axis=1))
    for i, a in enumerate(w):
        for k in (-2, -1, 1, 2):
            if 0 <= i + k < len(w) and a >= 0 and w[i + k] >= 0:
                want[a] += index[w[i + k]]
    assert np.allclose(total, want)


def test_lexicon_takes_terms_of_any_kind(spark):
    """Words with digits and pairs of words, and more of them than any cap."""
    rng = random.Random(3)
    terms = [f"grob{a}{b}lin" for a in "abcdefghijklmnopqrstuvwxyz" for b in "aeioumnprst"] + ["qwz2", "zorv blim"]
    rows = []
    for i, t in enumerate(terms * 16):
        rows += [(1, f"{words(rng, 12)} {t} {words(rng, 3)}"), (0, words(rng, 15) + (" zorv" if i % 2 else " blim"))]
    found = toxicity.fit_lexicon(spark.createDataFrame(rows, "label int, text string"))
    assert set(terms) <= set(found) and len(terms) > 280 and not {"zorv", "blim"} & set(found)
    known = toxicity.Lexicon(found)
    assert known.found("so  Zorv\tBLIM it is") and known.found("QWZ2!") and not known.found("zorv, then blimp")


def test_automaton_equals_plain_search():
    rng = random.Random(4)
    weights = {w: 1.0 + i for i, w in enumerate(["ab", "abc", "b a", "cab", "bc ab"])}
    known = toxicity.Lexicon(weights, ("abc ab",))
    for _ in range(300):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))
        read = " ".join(text.split())
        whole = lambda t: [i for i in range(len(read) - len(t) + 1) if read.startswith(t, i) and (i == 0 or read[i - 1] == " ") and (i + len(t) == len(read) or read[i + len(t)] == " ")]
        covered = [(i, i + 6) for i in whole("abc ab")]
        want = {}
        for t, w in sorted(weights.items(), key=lambda x: len(x[0])):
            for i in whole(t):
                if not any(a <= i and i + len(t) <= b for a, b in covered):
                    want[i] = (i, i + len(t), w)
        assert known.found(text) == sorted(want.values())


def test_training_rows_stay_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in range(5)], "doc_id long, toxic int, quality int")
    rows = quality.training_rows(docs, labels, "toxic", 5, 4, 4).collect()
    assert len(rows) <= 4 and all(r.text == min(f"text {i}" for i in range(r.doc_id, 200, 5)) for r in rows)


def test_network_equals_plain_layers():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(np.int64)
    network = quality.Network(x, y)
    want = []
    for row in x:
        z = [(float(a) - float(m)) / float(s) for a, m, s in zip(row, network.mean, network.spread, strict=True)]
        hidden = [np.tanh(sum(z[i] * network.weights[0][i, j] for i in range(6)) + network.weights[1][j]) for j in range(len(network.weights[1]))]
        logit = sum(h * w for h, w in zip(hidden, network.weights[2], strict=True)) + float(network.weights[3])
        want.append(1 / (1 + np.exp(-logit / network.temperature)))
    assert np.allclose(network(x), want, atol=1e-6) and ((network(x) > 0.5) == y).mean() > 0.9
