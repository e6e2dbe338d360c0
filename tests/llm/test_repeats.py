import collections
import hashlib
import random
import time

import numpy as np

from tidemark.llm import suffixes, superkmers


def test_columns_sort_all_suffixes():
    rng = random.Random(1)
    for _ in range(60):
        strings = ["".join(rng.choices("ab" if rng.random() < 0.5 else "abcd", k=rng.randint(1, 30))).encode() for _ in range(rng.randint(1, 12))]
        string, offset, lcp = suffixes.columns(strings, 7)
        got = [strings[s][o:] for s, o in zip(string.tolist(), offset.tolist())]
        assert got == sorted(got) and len(got) == sum(len(s) + 1 for s in strings)
        for k in range(1, len(got)):
            common = next((i for i, (a, b) in enumerate(zip(got[k - 1], got[k])) if a != b), min(len(got[k - 1]), len(got[k])))
            assert lcp[k] == min(common, 7)


def brute_bytes(rows, w=100):
    seen, out = set(), []
    for d, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - w + 1):
            if b[k : k + w] in seen:
                gone[k : k + w] = True
            seen.add(b[k : k + w])
        u = np.frombuffer(b, np.uint8)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(u[~gone].tobytes()).hexdigest()))
    return out


def brute_words(rows, w=35):
    count = collections.Counter()
    split = [(t or "").encode().split() for _, t in rows]
    for ws in split:
        count.update(tuple(ws[k : k + w]) for k in range(len(ws) - w + 1))
    out = []
    for (d, _), ws in zip(rows, split):
        gone = set()
        for k in range(len(ws) - w + 1):
            if count[tuple(ws[k : k + w])] > 1:
                gone.update(range(k, k + w))
        kept = [x for k, x in enumerate(ws) if k not in gone]
        out.append((d, len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus(rng):
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [say(rng.choice([20, 34, 35, 36, 60, 150])) for _ in range(12)]
    rows = []
    for k in range(150):
        parts = [say(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), say(rng.randint(0, 40))]
        rows.append((k, rng.choice([" ", "  ", "\n"]).join(parts)))
    rows += [(200 + k, rows[k][1]) for k in range(10)]
    rows += [(300, None), (301, ""), (302, "x" * 700), (303, "xy " * 400), (304, "ab " * 30 + "x" * 250), (305, passages[0] + " " + passages[0]), (306, say(3000))]
    return rows


def test_bytes_match_brute_force(spark):
    rows = corpus(random.Random(2))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, mask string").repartition(5)
    got = sorted(tuple(r) for r in suffixes.remove_repeats(df).collect())
    assert got == brute_bytes(rows)
    assert sorted(tuple(r) for r in suffixes.remove_repeats(df, hot=2).collect()) == got
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_words_match_brute_force(spark):
    rows = corpus(random.Random(3))
    rows += [(5, rows[5][1]), (5, rows[6][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows] + [(None, None, "x")], "doc_id long, text string, mini string").repartition(5)
    got = sorted((tuple(r) for r in superkmers.remove_repeats(df).where("doc_id is not null").collect()), key=str)
    assert got == sorted(brute_words(rows), key=str)
    assert sorted((tuple(r) for r in superkmers.remove_repeats(df, hot=2).where("doc_id is not null").collect()), key=str) == got
    assert superkmers.remove_repeats(df.limit(0)).count() == 0


def test_equal_rows_are_one_document(spark):
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefgh ", k=300))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 9, r.n_removed) for r in suffixes.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, 300), (9, 300)]


def test_many_equal_rows_cost_what_others_do(spark):
    """Equal rows stand as one: their strings are decided and handed out once, and all rows are answered."""
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    text = say(900)
    rows = [(1, text)] * 2000 + [(2, text + " " + say(10)), (3, say(50)), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    began = time.time()
    got = collections.Counter(tuple(r)[:3] for r in superkmers.remove_repeats(df).collect())
    assert got == {(1, 900, 900): 2000, (2, 910, 900): 1, (3, 50, 0): 1, (3, 0, 0): 2}
    got = collections.Counter(tuple(r)[:3] for r in suffixes.remove_repeats(df).collect())
    n = len(text)
    assert got[(1, n, 0)] == 2000 and got[(3, 0, 0)] == 2 and next(k for k in got if k[0] == 2)[2] == n
    assert time.time() - began < 150


def periodic(rng, sizes, words):
    """A passage for each (period, size), as a text of its own and within other words: nothing else repeats."""
    out = []
    for k, (period, size) in enumerate(sizes):
        say = lambda n, name: [name + "".join(rng.choices("abcdefghij", k=rng.randint(1, 6))) + str(k) for _ in range(n)]
        for name in "xy":
            unit = say(period, name) if words else "".join(rng.choices("abcdefghijklmnop ", k=period))
            passage = (unit * size)[:size]
            passage = " ".join(passage) if words else passage
            out.append(passage if name == "x" else " ".join([*say(60, "p"), passage, *say(60, "q")]))
    return out


def test_short_periods_in_one_document(spark):
    rng = random.Random(5)
    texts = periodic(rng, [(1, 40), (2, 60), (7, 44), (10, 100), (20, 56), (28, 63), (28, 64), (28, 90), (30, 95)], True)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_words(list(enumerate(texts)))
    assert sum(w[2] > 0 for w in want) >= 16
    assert sorted(tuple(r) for r in superkmers.remove_repeats(df).collect()) == want
    texts = periodic(rng, [(1, 120), (3, 130), (20, 121), (50, 250), (77, 177), (77, 178), (77, 300), (80, 200)], False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_bytes(list(enumerate(texts)))
    assert sum(w[2] > 0 for w in want) >= 12
    for hot in (20_000, 1):
        assert sorted(tuple(r) for r in suffixes.remove_repeats(df, hot=hot).collect()) == want


def test_long_texts(spark):
    """Periodic and copied texts of some 100 kB, in one document and across documents."""
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh ", k=120_000))
    texts = ["xy " * 40_000, long, long[:60_000] + "é" + long[60_000:], "z" * 100_000, long[1000:50_000] + " tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in suffixes.remove_repeats(df).collect()) == brute_bytes(list(enumerate(texts)))
    assert sorted(tuple(r) for r in superkmers.remove_repeats(df).collect()) == brute_words(list(enumerate(texts)))
