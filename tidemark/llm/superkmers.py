"""Removal of repeated word sequences by super-k-mer partitioning.

Consecutive windows of WINDOW words that share a minimiser travel as one packed string to the minimiser's bucket (repeats.py). There, the
windows of all distinct strings, each with its string's count, are sorted by a hash; neighbours with equal hashes are compared word for
word, so the counts are exact. Every word of a window that occurs more than once is removed, in all documents that have it.

Defined results: words end at ASCII white space and stay as they are; a null text has none; texts shorter than the window stay whole;
repeated rows count as occurrences of each other; null doc_ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm.repeats import HOT, Kind, remove, rolled

WINDOW, ANCHOR = 35, 8


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


WORDS = Kind(WINDOW, ANCHOR, lambda t: t.encode().split(), _hashes, lambda w, a, b: b" ".join(w[a:b]), lambda p: p.split())


def decide(t: dict) -> list[np.ndarray]:
    """Windows of each distinct string that occur more than once."""
    mini, n, count = t["mini"].to_numpy(), t["n"].to_numpy(), t["count"].to_numpy()
    masks = [np.full(k, c > 1) for k, c in zip(n.tolist(), count.tolist())]
    several = np.bincount(np.unique(mini, return_inverse=True)[1])[np.unique(mini, return_inverse=True)[1]] > 1
    chosen = np.flatnonzero(several | np.array(t["twice"].to_pylist(), bool))
    if not len(chosen):
        return masks
    texts = [t["packed"][int(k)].as_py().split() for k in chosen]
    hashes = [rolled(_hashes(w), WINDOW) for w in texts]
    string = np.repeat(np.arange(len(chosen)), [len(h) for h in hashes])
    offset = np.concatenate([np.arange(len(h)) for h in hashes])
    h = np.concatenate(hashes)
    by = np.argsort(h, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a == 1:
            continue
        same: dict[tuple, list[int]] = {}
        for k in by[a:b].tolist():
            same.setdefault(tuple(texts[string[k]][offset[k] : offset[k] + WINDOW]), []).append(k)
        for places in same.values():
            if len(places) > 1:
                for k in places:
                    masks[chosen[string[k]]][offset[k]] = True
    return masks


def _finish(text, words, removed):
    kept = words if removed is None else [w for w, gone in zip(words, removed.tolist()) if not gone]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs(doc_id, text)."""
    return remove(docs, WORDS, decide, False, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", ["doc_id", "n_words", "n_removed", "kept_sha256"], hot)
