"""Removal of repeated byte strings by a column-wise multi-document suffix array.

The buckets of repeats.py hold the packed strings that share a minimiser. For a handful of buckets at a time, the Burrows-Wheeler transform
of their strings and the common prefixes of their suffixes are built by columns (`columns`): a round inserts one symbol of every string,
from the last to the first, finds its place by counting the equal symbols before its predecessor in the transform, and rewrites transform
and prefixes in one sequential pass. As only matches of `window` bytes count, common prefixes are kept up to that length. Runs of suffixes
whose common prefixes reach it are the classes of equal windows; all but the first occurrence of a class are removed. Matches never cross
documents, since strings are cut from one document each.

Before that, strings are trimmed to the windows whose rolling hash recurs (a window with a hash of its own can't be repeated), and equal
trimmed strings of a bucket count once, as equal strings do everywhere here: all windows but those of the first are repeated.

The sequential files of the construction are, between tasks, the tables of repeats.py in the shared folder; within a task, arrays of at most
some PARTS strings of at most 407 bytes. A transform of the whole collection would take as many passes over everything as the longest text has bytes.

Defined results: a null text counts as empty; texts shorter than the window stay whole; rows with equal doc_id and text are one document
and get equal results; rows with equal doc_id and other texts are ordered by a hash of the text; null doc_ids come last; an empty table
gives no rows; other columns are ignored; texts of one repeated letter are cut into strings of bounded length.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.repeats import HOT, Kind, mixed, remove, rolled

WINDOW, ANCHOR = 100, 24
#: Strings of which one transform is built (more where one bucket has more).
PARTS = 1000

BYTES = Kind(WINDOW, ANCHOR, lambda t: np.frombuffer(t.encode(), np.uint8), lambda u: mixed(u.astype(np.uint64) + np.uint64(1)), lambda u, a, b: u[a:b].tobytes(), lambda p: np.frombuffer(p, np.uint8))


def columns(strings: list[bytes], most: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, offset and common prefix with its predecessor (up to `most`, which is below 256) of every suffix, in their order.

    For fewer than 65,536 strings, each shorter than that. All strings end with their first symbols in the same round, so the shorter ones join later.
    """
    n = len(strings)
    size = np.fromiter(map(len, strings), np.int64, n)
    by = np.argsort(-size, kind="stable")
    size = size[by]
    width = int(size.max(initial=0))
    text = np.zeros((n, width), np.uint8)
    for k, s in enumerate(by.tolist()):
        text[k, : size[k]] = np.frombuffer(strings[s], np.uint8)
    text = np.ascontiguousarray((text + np.uint8(1)).T)  # a byte of UTF-8 is below 248; 0 stands for the end
    live = np.searchsorted(-size, -np.arange(width)).tolist()
    bwt, lcp, name = np.zeros(n, np.uint8), np.zeros(n, np.uint8), (by << 16 | size).astype(np.uint32)  # of the empty suffixes
    place, count, rank = np.arange(n), np.arange(n + int(size.sum())), np.empty(n + int(size.sum()), np.int64)
    for j in range(width - 1, -1, -1):
        m, total = live[j], len(bwt)
        symbol, at = text[j, : live[j]], place[: live[j]]
        bwt[at] = symbol
        order = np.argsort(bwt, kind="stable")  # where each suffix that is one symbol longer comes from
        rank[order] = count[:total]
        r = rank[at]
        before, after = order[r - 1], order[np.minimum(r + 1, total - 1)]
        p, q = np.flatnonzero((bwt[before] == symbol) & (r > 0)), np.flatnonzero((bwt[after] == symbol) & (r + 1 < total))
        common = np.minimum(least(lcp, np.concatenate([before[p], at[q]]), np.concatenate([at[p], after[q]])), most - 1) + np.uint8(1)
        new = n - (total - np.count_nonzero(bwt)) + r
        old = np.ones(total + m, bool)
        old[new] = False
        bwt, lcp, name = (spread(x, old) for x in (bwt, lcp, name))
        bwt[new], lcp[new], name[new] = 0, 0, by[:m] << 16 | j
        lcp[new[p]], lcp[new[q] + 1] = common[: len(p)], common[len(p) :]
        place[:m] = new
    return name >> np.uint32(16), name & np.uint32(0xFFFF), lcp


def spread(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values, in order, where `at` says; the rest is free."""
    out = np.empty(len(at), values.dtype)
    out[at] = values
    return out


def least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a + 1 .. b], where a < b, by minima over 2 ** k neighbours."""
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    by = np.argsort(level.astype(np.uint8), kind="stable")
    top = int(level.max(initial=0))
    cuts = np.searchsorted(level[by], np.arange(top + 2))
    out, low = np.empty(len(a), values.dtype), values
    for k in range(top + 1):
        if k:
            low = np.minimum(low[: -(1 << k - 1)], low[1 << k - 1 :])
        at = by[cuts[k] : cuts[k + 1]]
        out[at] = np.minimum(low[a[at] + 1], low[b[at] + 1 - (1 << k)])
    return out


def recurrent(strings: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings that have windows whose rolling hash recurs, and the first and last of these. n: windows of each string."""
    h = rolled(BYTES.hashes(BYTES.unpack(b"".join(strings))), WINDOW)
    own = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    h = h[np.repeat(np.cumsum(n + WINDOW - 1) - n - WINDOW + 1, n) + offset]
    by = np.argsort(h)
    same = h[by][1:] == h[by][:-1]
    again = np.zeros(len(h), bool)
    again[by[1:][same]] = again[by[:-1][same]] = True
    w = np.flatnonzero(again)
    first = np.flatnonzero(np.diff(own[w], prepend=-1))
    return own[w[first]], offset[w[first]], offset[w[np.append(first[1:], len(w)) - 1]] if len(w) else offset[:0]


def decide(t: dict) -> list[np.ndarray]:
    """Windows of each distinct string that also start earlier."""
    n, bucket = t["n"].to_numpy().astype(np.int64), np.unique(t["mini"].to_numpy(), return_inverse=True)[1]
    did, rid, start = (t[c].to_numpy() for c in ("fdid", "frid", "fstart"))
    twice = np.array(t["twice"].to_pylist(), bool)
    strings = t["packed"].to_pylist()
    begin = np.cumsum(n) - n
    again = np.zeros(int(n.sum()), bool)  # the windows of all strings
    found, first, last = recurrent(strings, n)
    # Equal parts of a bucket: the earliest of them stands for all.
    earliest: dict[tuple[int, bytes], int] = {}
    for k in np.lexsort((start[found] + first, rid[found], did[found])).tolist():
        s, a, b = int(found[k]), int(first[k]), int(last[k]) + 1
        if earliest.setdefault((int(bucket[s]), strings[s][a : b + WINDOW - 1]), k) != k:
            again[begin[s] + a : begin[s] + b] = True
    parts = np.array(sorted(earliest.values()), np.int64)
    several = np.bincount(bucket[found[parts]], minlength=len(n))[bucket[found[parts]]] > 1
    parts = parts[several | twice[found[parts]]]
    parts = parts[np.argsort(bucket[found[parts]], kind="stable")]
    edges = np.append(np.flatnonzero(np.diff(bucket[found[parts]], prepend=-1)), len(parts))
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + PARTS, "right")) - 1)
        part = parts[edges[a] : edges[b]]
        string, offset, lcp = columns([strings[found[k]][first[k] : last[k] + WINDOW] for k in part.tolist()])
        k, group = part[string], np.cumsum(lcp < WINDOW)
        at = first[k] + offset.astype(np.int64)
        window = at <= last[k]
        k, at, group = k[window], at[window], group[window]
        s = found[k]
        by = np.lexsort((start[s] + at, rid[s], did[s], group))
        later = by[1:][group[by][1:] == group[by][:-1]]
        again[begin[s[later]] + at[later]] = True
        a = b
    return np.split(again, begin[1:])


def _finish(text, units, removed):
    if removed is None or not removed.any():
        return len(units), 0, 0, hashlib.sha256(units.tobytes()).hexdigest()
    edges = np.count_nonzero(np.diff(np.concatenate([[0], removed.astype(np.int8)])) == 1)
    return len(units), int(removed.sum()), int(edges), hashlib.sha256(units[~removed].tobytes()).hexdigest()


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs(doc_id, text)."""
    return remove(docs, BYTES, decide, True, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], hot)
