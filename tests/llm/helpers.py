"""Brute-force versions of the operators, on plain Python values."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, linked):
    """Smallest node reachable from each node; `linked` gives pairs."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def near_duplicates(docs):
    """{id: (n_shingles, component)}"""
    sets = {i: shingles(t) for i, t in docs}
    having = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            having[g].add(i)
    pairs = []
    for i, s in sets.items():
        together = Counter(j for g in s for j in having[g] if j < i)
        pairs += [(i, j) for j, n in together.items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)]
    found = roots(sets, pairs)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def repeated(texts, length=200):
    """(bytes, removed, spans, sha256) of every text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        marks = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                marks[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(d, marks, strict=True) if not m)
        out.append((len(d), sum(marks), len(re.findall(b"\1+", bytes(marks))), hashlib.sha256(kept).hexdigest()))
    return out


def base_rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)
