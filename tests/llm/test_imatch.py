import collections
import hashlib
import math
import random

import pytest
import regex
import xxhash

from tidemark.llm import imatch


def edited(rows):
    rows = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (d, t) in enumerate(rows):
        half = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()))
    return out


def corpus(n, rng):
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(2, 7))) for _ in range(800)]
    return [(3 * k + 1, " ".join(rng.choice(words) for _ in range(rng.randint(0, 120))), "x") for k in range(n)]


def plain_fingerprints(rows, band):
    """The same by its definition: words, document frequencies, subsets and hashes in plain Python."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    eight = lambda x: (x % (1 << 64)).to_bytes(8, "little")
    words = lambda t: {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())}
    df = collections.Counter(w for _, t, *_ in rows for w in words(t))
    known = {w for w, c in df.items() if c >= 2 and band[0] <= math.log(len(rows) / c) <= band[1]}

    def fingerprint(text):
        out = [0] * imatch.SUBSETS
        for w in sorted(words(text) & known):
            k = (w >> 58) + imatch.SUBSETS // 2
            out[k] = xxhash.xxh64_intdigest(eight(w), xxhash.xxh64_intdigest(eight(out[k]), 42))
        return [x and signed(x) % 65535 + 1 for x in out]

    def like(a, b):
        used = sum(x > 0 or y > 0 for x, y in zip(a, b))
        return sum(x == y > 0 for x, y in zip(a, b)) / used if used else 1.0

    ordered = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = {}
    for k, (d, t) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(t) // 2
        a, e, n = fingerprint(t), fingerprint(t[: len(t) - half] + after[:half]), fingerprint(after)
        text = lambda f: "".join(f"{x:04x}" for x in f)
        out[d] = text(a), text(e), pytest.approx(like(a, e)), pytest.approx(like(a, n))
    return out


@pytest.mark.parametrize("ranges", [(1, 2000), (8, 30)])
def test_fingerprints_match_plain_python(spark, monkeypatch, ranges):
    monkeypatch.setattr(imatch.with_next, "__defaults__", ranges)
    rows = corpus(250, random.Random(5)) + [(None, "null id", "x"), (5000, None, "x"), (5001, "", "x"), (5002, "Ünïcode 12 ÉÉ " * 30, "x"), (5003, "Ünïcode 12 ÉÉ", "x")]
    band = (0.5, 6.0)
    want = plain_fingerprints(rows, band)
    got = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, range string").repartition(3), band).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got} == want
    assert sum(set(w[0]) != {"0"} for w in want.values()) > 200


def test_edited_texts_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(imatch.with_next, "__defaults__", (8, 30))
    rows = corpus(300, random.Random(1))
    rows += [(10_000 + k, rows[k][1], "x") for k in range(40)] + [(None, "null id text ü", "x"), (20_000, None, "x"), (4, rows[1][1], "x"), (-5, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = imatch.fingerprints(df).collect()
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(str, edited(rows)))
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[10_000 + k].fingerprint == by_id[rows[k][0]].fingerprint for k in range(40))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 4 * imatch.SUBSETS for r in got)
    assert sum(r.near_edited for r in got) > 3 * sum(r.near_next for r in got)


def test_lexicon_band_and_hashes(spark):
    df = spark.createDataFrame([(k, "common " + ("rare" if k == 0 else "middling" if k < 4 else "") + f" only{k}") for k in range(100)], "doc_id long, text string")
    bits = imatch.lexicon(df)
    got = {r.doc_id: [x for x in r.fp if x] for r in df.select("doc_id", imatch.fingerprint(imatch.F.col("text"), bits).alias("fp")).collect()}
    assert len(got[1]) == 1 and got[1] == got[2] == got[3] and not got[0] and not got[50]


def test_few_rows(spark):
    one = imatch.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1
    assert imatch.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_very_long_text_is_taken_whole(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    df = spark.createDataFrame([*enumerate(texts), (100, long), (101, long + " tail")], "doc_id long, text string")
    got = {r.doc_id: r for r in imatch.fingerprints(df, (0.0, 9.0)).collect()}
    assert got[100].n_chars == len(long) and got[100].near_next > 0.9
    half = len(long) // 2
    assert got[100].edited_sha256 == hashlib.sha256((long[: len(long) - half] + (long + " tail")[:half]).encode()).hexdigest()


def test_ranges_come_from_a_sample(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "'t' as text").union(spark.range(3000).selectExpr("7L", "'hot'"))
    cuts = imatch.range_cuts(df, 8000, 10)
    assert 7 <= len(cuts) <= 9 and all(200 < b - a < 1200 for a, b in zip(cuts, cuts[1:]))
    assert imatch.range_cuts(df.limit(0), 1, 4) == []
