"""The operators again, in the plainest way, for small tables in memory."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import xxhash


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def substring_dedup(docs: list[tuple], window: int = 35) -> Counter:
    """(doc_id, n_words, n_removed, sha256 of what is kept) of (doc_id, text)."""
    split = [words(t) for _, t in docs]
    starts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = Counter()
    for (doc, _), w in zip(docs, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out[(doc, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    return out


def fingerprint(text: str | None, shingle: int) -> int:
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    n = max(len(w) - shingle + 1, 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def smallest_reachable(ids: list, linked) -> dict:
    """Smallest id reachable from each, for a function that lists the positions linked to a position."""
    label = list(range(len(ids)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in linked(i):
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, one in enumerate(ids):
        least[root(i)] = min(least.get(root(i), one), one)
    return {one: least[root(i)] for i, one in enumerate(ids)}


def simhash(docs: list[tuple], shingle: int = 3, most: int = 3) -> Counter:
    """(doc_id, fingerprint in hexadecimal, component) of (doc_id, text)."""
    prints = np.array([fingerprint(t, shingle) for _, t in docs], np.uint64)
    found = smallest_reachable(
        [d for d, _ in docs], lambda i: np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= most)
    )
    return Counter((d, f"{int(p):016x}", found[d]) for (d, _), p in zip(docs, prints))


def nearest(ids: np.ndarray, vectors: np.ndarray, k: int) -> dict[int, list[tuple[int, float]]]:
    """The ``k`` nearest to each id divisible by 20, by inner product."""
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = np.einsum("d,vd->v", vectors[i], vectors)
        order = [j for j in np.lexsort([ids, -scores]) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def vector_duplicates(rows: list[tuple], threshold: float = 0.98) -> Counter:
    """(vec_id, n_links, component) of (vec_id, vector, label)."""

    def good(v, label) -> bool:
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v) / np.linalg.norm(v) if good(v, label) else None for _, v, label in rows]

    def linked(i: int) -> list[int]:
        return [
            j for j in range(len(rows))
            if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
            and unit[i] @ unit[j] >= threshold
        ]

    found = smallest_reachable([r[0] for r in rows], linked)
    return Counter((r[0], len(linked(i)), found[r[0]]) for i, r in enumerate(rows))


def word_pieces(word: str, starts: set[str], continuations: set[str]) -> int | None:
    """Tokens of a word by greedy longest match; None if it cannot be split."""
    n, at = 0, 0
    while at < len(word):
        known = starts if at == 0 else continuations
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return None
        n, at = n + 1, end
    return n


def mix_targets(sizes: dict, weights: tuple = (1, 2, 3), most: int = 3) -> dict:
    """Targets of sources, by handing out what is above again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    free, rest = set(names), float(sum(sizes.values()))
    while free and rest > 1e-9:
        shares = sum(weight[s] for s in free)
        for s in list(free):
            target[s] += rest * weight[s] / shares
        rest = 0.0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                free.discard(s)
    return target
