"""Plain single-machine versions to hold the operators against."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(items, linked):
    """Smallest member that each item reaches."""
    items = sorted(items)
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {x: find(x) for x in items}


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def line_classes(rows, allowed):
    """(doc, line number) -> (doc, line number) of the first line of its class, and the lines; ``rows`` are
    (doc, text)."""
    lines = {(d, i): x for d, t in rows if t for i, x in enumerate(t.split("\n"))}
    full = {k: x for k, x in lines.items() if x.strip()}
    counts = {x: Counter(x) for x in full.values()}

    def linked(a, b):
        x, y = full[a], full[b]
        k = allowed(min(len(x), len(y)))
        if x == y or not k or abs(len(x) - len(y)) > k:
            return x == y
        differ = counts[x].copy()
        differ.subtract(counts[y])
        return sum(map(abs, differ.values())) <= 2 * k and edit_distance(x, y) <= k

    return groups(full, linked) | {k: k for k in lines.keys() - full.keys()}, lines


def without_repeats(rows, allowed):
    """doc -> its text without the lines that repeat an earlier one; documents without a line left go."""
    first, _ = line_classes(rows, allowed)
    out = {}
    for d, t in rows:
        rest = [x for i, x in enumerate((t or "").split("\n")) if first.get((d, i), (d, i)) == (d, i)]
        if not (t and t.strip()) or "".join(rest).strip():
            out[d] = None if t is None else "\n".join(rest)
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """Source -> its target, from source -> its size."""
    weight = {x: weights[i % len(weights)] for i, x in enumerate(sorted(sizes, key=lambda x: (x is None, x or "")))}
    left, full = sum(sizes.values()), {}
    while True:  # fill up, share what is left
        rest = [x for x in sizes if x not in full]
        target = {x: full.get(x, left * weight[x] / max(1, sum(weight[y] for y in rest))) for x in sizes}
        over = [x for x in rest if target[x] > most * sizes[x]]
        if not over:
            return target
        for x in over:
            full[x] = float(most * sizes[x])
            left -= full[x]
