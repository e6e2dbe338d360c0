import collections
import random
import time

import numpy as np

from tidemark.llm import packing


def brute(lengths, sources, clusters, capacity, per_source):
    bins = []
    out = [0] * len(lengths)
    order = {x: k for k, x in enumerate(sorted(set(sources)))}, {x: k for k, x in enumerate(sorted(set(clusters)))}
    many = [[x for x, n in collections.Counter(y for y, m in zip(names, lengths) if m).items() if n > most] for names, most in ((sources, per_source), (clusters, 1))]
    rank = lambda k: tuple(order[j][x] if x in many[j] and lengths[k] else -1 for j, x in enumerate((sources[k], clusters[k])))
    for at in sorted(range(len(lengths)), key=lambda k: (-lengths[k], *rank(k), k)):
        n, s, c = lengths[at], sources[at], clusters[at]
        fit = [
            (capacity - sum(x[0] for x in b), k)
            for k, b in enumerate(bins)
            if capacity - sum(x[0] for x in b) >= n and (sum(x[0] for x in b) < capacity or b == [])
            and (n == 0 or all(x[0] == 0 or x[2] != c for x in b) and sum(x[1] == s for x in b if x[0]) < per_source)
        ]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append([])
        out[at] = k
        bins[k].append((n, s, c))
    return out


def test_matches_plain_best_fit():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(0, 80)
        most = rng.choice([3, 12, 50])
        lengths, sources, clusters = [rng.randint(0, most) for _ in range(n)], [rng.randint(0, 4) for _ in range(n)], [rng.randint(0, rng.choice([2, 30])) for _ in range(n)]
        got, _ = packing.pack(np.array(lengths, np.int64), np.array(sources, np.int64), np.array(clusters, np.int64), 50, 2)
        assert got.tolist() == brute(lengths, sources, clusters, 50, 2)


def test_many_copies_and_a_hot_source_take_linear_time():
    n = 40_000
    for sources, clusters, lengths in ((np.arange(n), np.zeros(n, np.int64), np.full(n, 60)), (np.zeros(n, np.int64), np.arange(n), np.full(n, 10)), (np.arange(n) % 3, np.arange(n) // 3 % 5, np.full(n, 0))):
        began = time.process_time()
        bins, _ = packing.pack(lengths, sources, clusters, 4096, 8)
        assert time.process_time() - began < 5
        assert len(set(bins.tolist())) == (n if (clusters == 0).all() and lengths[0] else n // 8 if lengths[0] else 1)


def test_packing_holds_its_constraints(spark):
    rng = random.Random(2)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(400)]
    rows = [(k, t, rng.choice(["a", "a", "b", None]), "x") for k, t in enumerate(texts)] + [(None, None, None, "x"), (3, texts[3], "a", "x"), (3, texts[3], "a", "x"), (1000, "v " * 1000, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id string")
    got = packing.best_fit(df, capacity=100, per_source=3, shard=2000).collect()
    assert sorted(map(str, got)) == sorted(map(str, packing.best_fit(df.repartition(3), capacity=100, per_source=3, shard=2000).collect()))
    assert sum(r.n_units for r in got) == sum(len((t or "").split()) for _, t, _, _ in rows)
    assert collections.Counter(r.piece for r in got if r.doc_id == 1000) == collections.Counter(range(10))
    by_bin = collections.defaultdict(list)
    for r in got:
        by_bin[r.bin_id].append(r)
    for rs in by_bin.values():
        assert sum(r.n_units for r in rs) <= 100
        at = 0
        for r in sorted((r for r in rs if r.n_units), key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_units
        same = [texts[r.doc_id] for r in rs if r.doc_id is not None and r.doc_id < 400 and texts[r.doc_id]]
        assert len(same) == len(set(same))
    assert packing.best_fit(df.limit(0)).count() == 0


def test_equal_rows_are_dealt_to_all_shards(spark):
    rows = [(7, "same words here", "a")] * 4000 + [(k, "other", "b") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.best_fit(df, capacity=100, per_source=3, shard=640).collect()
    by_shard = collections.Counter(r.bin_id >> 32 for r in got if r.doc_id == 7)
    assert len(got) == 4010 and len(by_shard) > 300 and max(by_shard.values()) < 40
    again = packing.best_fit(df.repartition(5), capacity=100, per_source=3, shard=640).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    blocks = packing.numbered_rows(df.selectExpr("doc_id", "xxhash64(text) as t"), block=7).groupBy("doc_id", "t").agg({"copy": "max", "*": "count"}).collect()
    assert all(r["max(copy)"] == r["count(1)"] - 1 for r in blocks)
