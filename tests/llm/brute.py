"""Plain versions of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes(texts: dict[int, str | None], threshold: float = 0.8) -> tuple[dict[int, int], dict[int, int]]:
    """Class id and number of linked other shingle sets, by comparing all documents that share a shingle."""
    sets = {d: shingles(t) for d, t in texts.items()}
    having = defaultdict(set)
    for d, s in sets.items():
        for g in s or [None]:
            having[g].add(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = {}
    for d, s in sets.items():
        common = Counter()
        for g in s or [None]:
            common.update(having[g])
        near = {e for e, n in common.items() if not s or n >= threshold * (len(s) + len(sets[e]) - n) - 1e-9}
        for e in near:
            a, b = find(d), find(e)
            parent[max(a, b)] = min(a, b)
        links[d] = len({sets[e] for e in near} - {s})
    return {d: find(d) for d in sets}, links


def without_known_strings(texts: dict[int, str], length: int = 50) -> dict[int, bytes]:
    """Each text's bytes that no string of a smaller id covers."""
    first, out = {}, {}
    for d in sorted(texts):
        data = texts[d].encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first.setdefault(data[i : i + length], d) < d:
                gone[i : i + length] = b"\1" * length
        out[d] = bytes(x for x, y in zip(data, gone, strict=True) if not y)
    return out


def covered_words(texts: dict[int, str], n: int = 50) -> dict[int, set[int]]:
    """Places of words in runs of n that an earlier text has too."""
    first, out = {}, {}
    for d in sorted(texts):
        w = words(texts[d])
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        out[d] = {j for i, g in enumerate(grams) if first.get(g, d) < d for j in range(i, i + n)}
        for g in grams:
            first.setdefault(g, d)
    return out


def contamination(text: str | None, items: dict[int, str], window: int = 10) -> tuple[set[int], set[int]]:
    """Places of hit words, and items found."""
    w = words(text)
    hit, found = set(), set()
    for item, other in items.items():
        o = words(other)
        n = min(window, len(o))
        grams = {tuple(o[i : i + n]) for i in range(len(o) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(item)
    return hit, found
