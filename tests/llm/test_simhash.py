import collections
import random
import re

import numpy as np
import xxhash

from tidemark.llm import simhash


def brute_fingerprint(text, size=3):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius):
    root = {i: i for i in range(len(fps))}
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = root[i], root[j]
                root = {k: b if v == a else v for k, v in root.items()}
    least = collections.defaultdict(list)
    for k, v in root.items():
        least[v].append(ids[k])
    return [min(least[root[k]]) for k in range(len(fps))]


def test_fingerprints():
    rng = random.Random(1)
    for text in [None, "", " \t", "One", "a B", "Ä Ö a b", "x " * 500] + [" ".join(rng.choices("abc dE f é".split(), k=rng.randint(1, 40))) for _ in range(50)]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1]
    fps = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(7 * k % 1009, f) for k, f in enumerate(signed)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components(df).collect()}
    ids = [7 * k % 1009 for k in range(len(fps))]
    assert got == dict(zip(ids, brute_components(ids, fps, 2)))


def test_hot_groups_are_dealt_out(spark):
    rng = random.Random(3)
    b = rng.getrandbits(64)
    fps = list({b ^ sum(1 << k for k in rng.sample(range(20), rng.randint(0, 6))) for _ in range(600)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for hot in (20, 100_000):
        pairs = simhash.connected_components(simhash.links(df, 2, hot).distinct())
        got = {r.node: r.root for r in pairs.collect()}
        want = brute_components(signed, fps, 2)
        assert [got.get(f, f) for f in signed] == want


def test_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text, "x"), (3, text.upper(), "x"), (None, text, "x"), (9, None, "x"), (8, " ", "x"), (8, " ", "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert sorted((r.doc_id or -1, r.component_id) for r in got.collect()) == [(-1, 3), (3, 3), (5, 3), (8, 8), (8, 8), (9, 8)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    rows, keep = [], []
    for k in range(60):
        words = say(rng.randint(150, 300))
        keep.append(10 * k)
        rows.append((10 * k, " ".join(words), "en"))
        for copy in range(1, 1 + k % 4):
            other = list(words)
            if copy > 1:
                other[rng.randrange(len(other))] = "changed"
            rows.append((10 * k + copy, " ".join(other).upper() if copy == 3 else " ".join(other), "en"))
    rows += [(1000, None, "en"), (1001, "", "en"), (None, "alone here", "en"), (2000, "short", "en"), (2000, "short", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got.collect()) == sorted([*keep, 1000, -1, 2000])
    assert simhash.one_of_each(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 AS kept_id", "'a' AS kept_hash", "2 AS node", "doc_id % 7 AS text_hash", "map('a', 1) AS root", "3 AS _own")
    again = simhash.one_of_each(clash)
    assert again.columns == clash.columns and sorted(str(r.doc_id) for r in again.collect()) == sorted(str(r.doc_id) for r in got.collect())


def test_wide_groups_are_sliced(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(300)]
    texts = []
    for _ in range(80):
        other = list(words)
        other[rng.randrange(300)] = f"c{rng.random()}"
        texts.append(" ".join(other))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = simhash.wide_fingerprints(df, 5).drop("doc_id")
    for hot in (7, 1000):
        roots = simhash.connected_components(simhash.wide_links(df, nodes, 5, 0.8, hot).distinct()).collect()
        assert len(roots) == 80 and len({r.root for r in roots}) == 1


def test_links_have_the_similarity(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randint(60, 200))]
        texts.append(words)
        for changes in (1, 2, 3, 5, 8):
            other = list(words)
            for k in rng.sample(range(len(other)), changes):
                other[k] = f"c{rng.random()}"
            texts.append(other)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(" ".join(t), 5).tolist()) for t in texts]
    close = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    nodes = simhash.wide_fingerprints(df, 5)
    of = {r.node: r.doc_id for r in nodes.collect()}
    links = [(of[r.a], of[r.b]) for r in simhash.wide_links(df, nodes.drop("doc_id"), 5, 0.8).distinct().collect()]
    assert all(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in links)
    root = list(range(len(sets)))
    for i, j in links:
        a, b = root[i], root[j]
        root = [b if x == a else x for x in root]
    assert sum(root[i] == root[j] for i, j in close) >= 0.97 * len(close) and len(close) > 60


def test_near_copies_that_differ_in_repeats_are_found(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(8):
        words, line = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (600, 9))
        texts += [" ".join(words), " ".join(words + line * 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == list(range(0, 16, 2))
    assert simhash.wide_radius(0.8) == 62


def test_texts_that_share_a_repeated_line_stay(spark):
    rng = random.Random(8)
    line = [f"w{rng.randrange(10**6)}" for _ in range(9)]
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(120)] + line * 40) for _ in range(12)]
    texts += [" ".join([f"w{rng.randrange(10**6)}" for _ in range(60)] + ["word"] * 80) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == list(range(24))


def test_rows_with_a_partner_match_brute_force():
    rng = np.random.default_rng(5)
    for n in (1, 40, 700):
        u = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
        u[n // 2 :] = u[: n - n // 2] ^ (np.uint64(1) << rng.integers(0, 63, (n - n // 2, 2)).astype(np.uint64))
        u = u[np.argsort(np.bitwise_count(u).sum(axis=1), kind="stable")]
        for side in (np.full(n, 2), rng.integers(0, 2, n)):
            near = np.bitwise_count(u[:, None] ^ u[None, :]).sum(axis=2) <= 2
            np.fill_diagonal(near, False)
            near &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
            assert (simhash._partnered(u, side, 2) == near.any(axis=1)).all()
