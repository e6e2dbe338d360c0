import hashlib
import random
import zlib

import pytest

from tidemark.llm import prefixes


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {c: convs.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + ts[zlib.crc32(str(c).encode()) % 6 :] for c, ts in convs.items()}
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in own if len(rebuilt[c]) == len(path))
        out.append((
            min(own), len(path), min(members[path[:-1]]) if path else None, len(own), sum(len(p) == len(path) + 1 for p in below),
            sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [4096, 2])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefixes, "BLOCK", block)
    monkeypatch.setattr(prefixes, "CHUNK", 3)
    rng = random.Random(block)
    rows = []
    for c in [*range(40), *range(100, 130), *range(205, 230), 1_000_000_007]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "é😀", "", None, "yes", "x" * 5000])))
    rows += rows[:20] + [(None, 1, "user", "lost"), (7, 3, "user", "hi"), (7, 3, "user", "ho")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 string")
    want = sorted(brute(rows), key=str)
    assert nodes(prefixes.prefix_trie(df)) == want
    assert nodes(prefixes.prefix_trie(df.repartition(7))) == want
    assert prefixes.prefix_trie(df.limit(0)).count() == 0


def test_a_long_conversation(spark, monkeypatch):
    """One conversation holds most rows: its running sums are taken block by block."""
    monkeypatch.setattr(prefixes, "BLOCK", 64)
    rows = [(300, k, "user", f"turn {k % 7}") for k in range(500)] + [(301, k, "user", f"turn {k % 7}") for k in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes(prefixes.prefix_trie(df)) == sorted(brute(rows), key=str)
