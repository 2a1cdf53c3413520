"""Brute-force versions of the window operators, on lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def bytes_removed(rows, size):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(s[k : k + size] for _, s in data for k in range(len(s) - size + 1))
    out = []
    for i, s in data:
        gone = [False] * len(s)
        for k in range(len(s) - size + 1):
            if seen[s[k : k + size]] > 1:
                gone[k : k + size] = [True] * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(s, gone) if not g)
        out.append((i, len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words_removed(rows, size):
    """(doc_id, n_words, n_removed, kept_sha256) for every row; a missing id counts as the last."""
    data = [(i, SPACED.findall(t or "")) for i, t in rows]
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, w in data:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, w in data:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < rank(i):
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
