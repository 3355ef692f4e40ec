from __future__ import annotations

import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import chat, fingerprint, mixing, packing, secrets, tokens, topk_search
from quern.llm.registry import tokenizer_path

from . import brute

CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff"
UNIT = re.compile(rf"[^\x20\x09-\x0D{CJK}]{{1,16}}|[{CJK}]")


def winnowed(text):
    """(position, hash) of the entries that winnowing keeps, window by window."""
    h = [xxhash.xxh64_intdigest(u.encode(), seed=42) for u in UNIT.findall(text)]
    h = [(x - (1 << 64) if x >> 63 else x) % fingerprint.PRIME for x in h]
    grams = []
    for i in range(max(1, len(h) - fingerprint.K + 1) if h else 0):
        value = 0
        for x in h[i : i + fingerprint.K]:
            value = (value * fingerprint.BASE + x) % fingerprint.PRIME
        grams.append(value)
    kept = []
    for i in range(max(1, len(grams) - fingerprint.W + 1) if grams else 0):
        least = min((g, -(i + j)) for j, g in enumerate(grams[i : i + fingerprint.W]))
        if (-least[1], least[0]) not in kept[-1:]:
            kept.append((-least[1], least[0]))
    return kept


def entries(fp):
    return [(int(p), int(h, 16)) for p, h in (e.split(":") for e in fp.split(","))] if fp else []


def dice(x, y):
    a, b = {h for _, h in x}, {h for _, h in y}
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprints(spark, corpus, documents):
    got = {r.doc_id: r for r in fingerprint.compare_with_edits(documents).collect()}
    texts = {r[0]: r[1] or "" for r in corpus}
    order = sorted(texts, reverse=True)
    by_text = {}
    for i, d in enumerate(order):
        text, after = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        a, b, c = winnowed(text), winnowed(edited), winnowed(after)
        assert entries(r.fingerprint) == a and entries(r.edited_fingerprint) == b
        assert r.near_edited == pytest.approx(dice(a, b)) and r.near_next == pytest.approx(dice(a, c))
    assert got[82].fingerprint == "" and got[80].fingerprint == ""


def test_each_winnowing_pass_is_computed_once(spark):
    """A pass that names the one before it several times repeats it, and so on down to the first."""
    assert str(fingerprint.winnow(F.col("text"))).count("zip_with") <= 8


def test_fingerprints_of_odd_cases(odd_documents, no_documents):
    assert fingerprint.compare_with_edits(no_documents).count() == 0
    rows = fingerprint.compare_with_edits(odd_documents.withColumn("a", F.lit(1)).withColumn("next", F.lit(2)).withColumn("bucket", F.lit(3))).collect()
    assert len(rows) == 5 and sorted(r.n_chars for r in rows) == [0, 5, 12, 28, 28]
    ids = sorted((r for r in rows if r.doc_id == 1), key=str)
    assert ids[0].fingerprint == ids[1].fingerprint and {r.near_next for r in ids} >= {1.0}


def test_shifted_passages_without_spaces_share_hashes(spark):
    import random

    rng = random.Random(3)
    passage = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60))
    rows = fingerprint.fingerprints(spark.createDataFrame([(1, passage), (2, "漢" + passage)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert dice(*(entries(r.fingerprint) for r in rows)) > 0.8


def test_shared_passages_share_a_hash(spark):
    passage = " ".join(f"w{i}" for i in range(fingerprint.K + fingerprint.W - 1))
    texts = [f"{'x ' * i}{passage} {'y ' * (7 - i)}" for i in range(8)]
    rows = fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [{h for _, h in entries(r.fingerprint)} for r in rows]
    assert all(a & b for a in sets for b in sets)


def test_rightmost_ties(spark):
    (r,) = fingerprint.fingerprints(spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")).collect()
    assert [p for p, _ in entries(r.fingerprint)] == list(range(fingerprint.W - 1, 28))


def test_packing_is_an_exact_round_trip(spark, corpus, documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    want = {r[0]: [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in corpus}
    rows = packing.pack(documents, tokenizer_path(), length=512).collect()
    for d, ids in want.items():
        pieces = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist() == ids
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(ids) and r.cut == (r is not pieces[-1]) for r in pieces)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    total = sum(map(len, want.values()))
    assert sorted(sequences) == list(range(-(-total // 512))) and all(n == 512 for s, n in sequences.items() if s < len(sequences) - 1)


def test_packing_odd_cases(odd_documents, no_documents):
    assert packing.pack(no_documents, tokenizer_path()).count() == 0
    assert packing.pack(odd_documents, tokenizer_path(), with_ids=False).count() == 5


@pytest.mark.parametrize("text", ["", " ", "a  b", " a", "a ", "a\n b", "don't 'll x", "tab\t c", "<|endoftext|> x", "é   ü z", "1 22\n\n3", "\x1c a"])
def test_tokens_equal_the_library(text):
    from tokenizers import Tokenizer

    assert np.frombuffer(tokens.ByteBpe(tokenizer_path()).encode(text), "<u4").tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_tokens_equal_the_library_on_whole_documents():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    fast, whole = tokens.ByteBpe(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert len(texts) == 1000
    for t in texts:
        assert np.frombuffer(fast.encode(t or ""), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_mixing(spark, corpus, documents):
    rows = mixing.mix_to_weights(documents).collect()
    size = {r[0]: len(brute.WORD.findall(r[1] or "")) for r in corpus}
    by_source = {}
    for r in corpus:
        by_source[r[3]] = by_source.get(r[3], 0) + size[r[0]]
    target = brute.targets(by_source)
    source = {r[0]: r[3] for r in corpus}
    taken = {}
    for r in rows:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == by_source[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert taken == {s: int(target[s] + 1e-6) for s in by_source}
    assert sorted(mixing.mix_to_weights(documents.repartition(7)).collect()) == sorted(rows)
    words = {}
    for r in mixing.mixed(documents).collect():
        words[r.source] = words.get(r.source, 0) + len(brute.WORD.findall(r.text))
    assert words == {s: n for s, n in taken.items() if n}
    got = {}
    for r in mixing.mixed(documents).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
    assert got == {r.doc_id: r.taken for r in rows if r.taken}


@pytest.mark.parametrize("sources", [100_000, 0])
def test_mixing_cuts_among_equal_rows(spark, monkeypatch, sources):
    """Boundaries that fall among rows without ids, and rows that repeat; broadcast and joined."""
    monkeypatch.setattr(mixing, "MOST_SOURCES", sources)
    rows = [(None, "one two three", "a", 1)] * 40 + [(7, "four five", "b", 2)] * 30 + [(7, "six seven", "b", 3)] * 25 + [(None, None, None, 4), (3, " ", "c", 5)] + [(4, "x y z w", "c", 6)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, last long").withColumn("n_chars", F.length("text").cast("long")).repartition(5)
    taken, target = {}, {}
    for r in mixing.mix_to_weights(docs).collect():
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        target[r.source_size] = int(r.target + 1e-6)
    assert taken == target
    words = {}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(brute.WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == {s: target[n] for s, n in (("a", 120), ("b", 110), ("c", 20)) if target[n]}


def test_mixing_odd_cases(odd_documents, no_documents):
    assert mixing.mix_to_weights(no_documents).count() == 0 and mixing.mixed(no_documents).count() == 0
    rows = mixing.mix_to_weights(odd_documents).collect()
    assert len(rows) == 5 and {r.source_size for r in rows} == {14, 4, 3}
    assert mixing.mixed(odd_documents).columns == odd_documents.columns


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(x):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_secrets(spark, corpus):
    import random

    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(10)]
    odd = [
        "é😀 password = 'abc123' SECRET:x token=\"token=abcdef\"", "secret: 'token' : abcdefgh", "api_key=api-key apikey='a.b=c+d/'", "ſecret=abcdefgh passKword=abcdefgh",
        "AKIAAKIA" + "A" * 16, "AKIA" + "B" * 15, "xAKIA" + "7" * 20, "0" * 24 + " " + "a" * 23, "f" * 30 + "g" + "0" * 24, "password=" + "ab" * 20, "",
        *[f"the key {k} is here" for k in keys], "aaaaaaaaaaaaaaaaaaaaaaaa1a1a1a1a1a1a1a1a1a1a1a1", "some/long/path/with/a/number/12345/in_it",
    ]
    texts = [(i, t) for i, t in enumerate(odd)] + [(1000 + r[0], r[1]) for r in corpus]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(filter(None, got[i].spans.split(",")))
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
    at = odd.index(f"the key {keys[0]} is here")
    assert sum(got[at + i].spans == "random:8:48" for i in range(10)) >= 9
    assert "random" not in got[len(odd) - 2].spans


def battery(value):
    """The p-value by the plain formulas, and the alphabet inferred."""
    if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
        return None
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
        value, alphabet = value.lower(), digits + "abcdef"
    elif re.fullmatch("[A-Z2-7]+", value):
        value, alphabet = value.lower(), lower + "234567"
    elif re.fullmatch("[0-9a-z]+|[0-9A-Z]+", value):
        value, alphabet = value.lower(), digits + lower
    else:
        alphabet = digits + upper + lower if value.isalnum() else upper + lower + digits + "+/-_"
    k = min(len(alphabet), 64)
    x = np.array([min(alphabet.index(c), 63) for c in value], float)
    n = len(x)
    tail = lambda z: max(1e-300, 0.5 * math.erfc(z / math.sqrt(2)))
    counts = np.bincount(x.astype(int), minlength=k)
    chi, df = float(((counts - n / k) ** 2 / (n / k)).sum()), k - 1
    z = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    chi_p = tail(z) if z >= 0 else 1 - tail(-z)
    high = x >= k / 2
    ones, runs = int(high.sum()), 1 + int((high[1:] != high[:-1]).sum())
    expected = 2 * ones * (n - ones) / n + 1
    runs_z = math.sqrt(n) if ones in (0, n) else abs(runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    d = x - x.mean()
    serial_z = math.sqrt(n) if not d.any() else abs((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n)
    return min(1.0, 3 * min(chi_p, 2 * tail(runs_z), 2 * tail(serial_z)))


def planted(rng, n):
    """Random keys in five encodings, and long names, paths and numbers that are none."""
    digits, upper = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = upper.lower()
    alphabets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", digits + lower, digits + upper + lower, digits + upper + lower + "+/", digits + upper + lower + "-_")
    keys = []
    while len(keys) < n:
        k = "".join(rng.choice(alphabets[len(keys) % 5]) for _ in range(rng.choice((24, 32, 40, 64, 88))))
        if re.search("[0-9]", k) and re.search("[A-Za-z]", k) and not k.startswith("AKIA"):
            keys.append(k)
    words = ["data", "input", "server", "config", "index", "table", "result", "user", "account", "session", "value", "report", "module", "test", "main"]
    makers = (
        lambda: "_".join(rng.choice(words) for _ in range(5)) + f"_{rng.randrange(100)}",
        lambda: "/".join(rng.choice(words) for _ in range(6)) + f"/{rng.randrange(2000, 2030)}",
        lambda: "".join(rng.choice(words).capitalize() for _ in range(6)) + str(rng.randrange(10)),
        lambda: "-".join(rng.choice(words) for _ in range(6)) + f"-v{rng.randrange(10)}",
        lambda: rng.choice("xyz") + str(rng.randrange(10)) + "0" * 24,
    )
    return keys, [makers[i % len(makers)]() for i in range(n)]


def test_battery_equals_the_plain_formulas(spark):
    import random

    rng = random.Random(12)
    keys, names = planted(rng, 60)
    values = [*keys, *names, "0" * 24, "a" * 30, "deadbeef" * 4, "a1" * 12]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.battery(F.col("v")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(battery(r.v), rel=1e-3, abs=1e-6) if battery(r.v) is not None else r.p is None


def test_battery_tells_keys_from_names(spark):
    """Planted keys that no pattern knows, in prose: how many are found, and how many of what is found."""
    import random

    rng = random.Random(13)
    keys, names = planted(rng, 300)
    texts = [(i, f"see the line {x} for more") for i, x in enumerate(keys + names)]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    found = {i for i, spans in got.items() if "random:13:" in spans}
    hits = len(found & set(range(len(keys))))
    assert hits / len(keys) >= 0.9 and hits / len(found) >= 0.9, (hits, len(found))


def test_secrets_in_very_long_texts(spark):
    """Time and stack don't grow with the square of a run, nor of the number of spans."""
    import time

    key = "0123456789abcdef01234567"
    texts = [(1, "k" * 1_000_000), (2, f"{key} " * 20_000), (3, "a1" * 300_000), (4, "password=abcdef1 " * 30_000), (5, "/" * 500_000 + "1a")]
    began = time.perf_counter()
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 60
    assert got[2].n_hex == 20_000 and got[2].spans.endswith(f"hex:{25 * 19_999}:{25 * 19_999 + 24}") and got[4].n_assign == 30_000 and got[1].spans == ""


def test_secrets_odd_cases(odd_documents, no_documents):
    assert secrets.find_secrets(no_documents).count() == 0 and secrets.find_secrets(odd_documents).count() == 5


def test_top_k(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 0.2, (300, 12))
    v[50:120] = v[7]  # one very common vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (400, [float("nan")] * 12), (500, [None] * 12), (None, [0.0] * 12), (600, []), (700, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("label", F.lit(2))
    got = topk_search.top_k(table, table.where("vec_id % 100 = 0"), candidates_a_block=64, queries_a_block=2)
    x = np.floor(v.astype(np.float32).astype(np.float64) * 1024).astype(np.int64)
    want = []
    for q in (0, 100, 200):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == want
    assert topk_search.top_k(table.where("vec_id < 0"), table.where("vec_id < 0")).count() == 0


def test_top_k_stops_early_and_is_exact():
    v = np.zeros((5000, 4))
    v[:, 0] = np.arange(5000)
    block = topk_search.Block(np.arange(5000), v)
    ids, scores = block.search(-1, np.array([1.0, 0, 0, 0]), 3)
    assert ids.tolist() == [4999, 4998, 4997] and scores.tolist() == [4999, 4998, 4997]


def test_chat(spark):
    said = {1: "abc", 2: "ab", 3: "abcd", 4: "abcd", 5: "abx", 6: "a", 7: "z", 8: "bc"}
    rows = [(c, k, ["user", "assistant"][k % 2], t) for c, x in said.items() for k, t in enumerate(x)] + [(9, 0, None, None), (None, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(0))
    got = {r.conv_id: r for r in chat.collapse_and_render(table).collect()}
    assert {c: (r.n_turns, r.copies) for c, r in got.items()} == {3: (4, 2), 5: (3, 1), 7: (1, 1), 8: (2, 1), 9: (1, 1)}
    assert got[7].rendered == "<|user|>\nz\n<|end|>\n"
    assert got[8].rendered == "<|user|>\nb\n<|end|>\n<|assistant|>\nc\n<|end|>\n"
    assert chat.collapse_and_render(table.where("conv_id > 100")).count() == 0


def test_chat_keeps_conversations_of_many_turns(spark):
    from pyspark.sql import functions as F

    n = 300_000
    turns = lambda conv, n: spark.range(n).select(F.lit(conv).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    log = turns(1, n).union(turns(2, n - 1)).union(turns(3, n))
    got = chat.collapse_and_render(log).select("conv_id", "n_turns", "copies", F.length("rendered").alias("size")).collect()
    size = sum(len(chat.TEMPLATE.format(role="user", text=f"t{i}")) for i in range(n))
    assert [tuple(r) for r in got] == [(1, n, 2, size)]


def test_units_are_of_all_characters_but_white_space():
    import re

    from quern.llm import fingerprint

    other = re.compile("[" + fingerprint.OTHER.replace(r"\x{10FFFF}", r"\U0010FFFF") + "]")
    rest = re.compile(f"[^{fingerprint.SPACE}{fingerprint.ALONE}]")
    assert all(bool(other.match(chr(c))) == bool(rest.match(chr(c))) for c in range(0x110000))
