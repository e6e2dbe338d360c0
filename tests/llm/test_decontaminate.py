import random

import numpy as np

from tidemark.llm import decontaminate


def shingles(text, n):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, items, least=0.8):
    out = {}
    for d, text, *_ in docs:
        for i, item, *_ in items:
            n = min(5, len((item or "").split()))
            if n and len(s := shingles(item, n)):
                c = len(s & shingles(text, n)) / len(s)
                if c >= least:
                    out[d, i] = max(c, out.get((d, i), 0))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(300)]
    say = lambda n: rng.choices(vocabulary, k=n)
    items = [(k, " ".join(say(rng.choice([1, 3, 5, 6, 9, 14, 30, 57, 200]))), "x") for k in range(60)] + [(100, None, "x"), (101, "", "x"), (None, "alpha beta gamma delta epsilon zeta eta", "x")]
    docs = []
    for k in range(150):
        words = say(rng.choice([0, 1, 4, 40, 400, 3000]))
        for _ in range(rng.randint(0, 3)):
            item = (rng.choice(items)[1] or "").split()
            if item and rng.random() < 0.5:  # a word differs, which costs up to five shingles
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if rng.random() < 0.2 else w for w in item]
        docs.append((k, "  ".join(words), "x"))
    docs += [(None, items[-1][1] + " tail", "x"), (500, None, "x"), (7, docs[7][1], "x"), (7, "other text", "x")]
    want = brute(docs, items)
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, class string")).collect()
    assert {(r.doc_id, r.item_id): r.containment for r in got} == want and len(got) == len(want) > 50


def test_scattered_items_are_found(spark):
    """An item's sentences, far from each other in a long document: recall against brute force."""
    rng = random.Random(2)
    say = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([60, 120, 200]))), "x") for k in range(60)]
    docs = []
    for k in range(120):
        words, item = say(3000), items[k % 60][1].split()
        cuts = [0, *sorted(rng.sample(range(20, len(item) - 19), 1 if len(item) < 120 else 2)), len(item)]
        for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
            at = 900 * part + rng.randrange(300)
            words[at:at] = item[a:b]
        docs.append((k, " ".join(words), "x"))
    want = brute(docs, items)
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, class string")).collect()
    found = {(r.doc_id, r.item_id): r.containment for r in got}
    assert all(want[p] == c for p, c in found.items()) and len(found) >= 0.98 * len(want) and len(want) > 100


def test_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven y", "en"), (2, "clean", "en"), (None, None, None)], "doc_id long, text string, lang string")
    kept = decontaminate.remove_leaks(docs, items)
    clash = docs.selectExpr("*", "'a' AS leaked", "1 AS b", "2 AS item_id", "3 AS row", "4 AS d")
    again = decontaminate.remove_leaks(clash, items)
    assert again.columns == clash.columns and again.count() == 2
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2]
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_a_very_long_document_and_tables_of_bits(spark):
    rng = random.Random(12)
    say = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    items = [(k, say(rng.randint(5, 40))) for k in range(30)]
    long = " ".join([say(40_000), items[3][1], say(20_000), items[4][1].upper(), say(10)])
    docs = spark.createDataFrame([(1, long), (2, say(70_000)), (3, None)], "doc_id long, text string")
    got = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.containment) for r in got) == [(1, 3, 1.0), (1, 4, 1.0)]
    values = spark.createDataFrame([(list(range(k, k + 100)),) for k in range(0, 9000, 50)], "x array<long>")
    table = decontaminate.bit_table(values, "x")
    assert 64 * len(table) >= decontaminate.ROOM * 9050 and decontaminate.has_bit(table, np.arange(9050, dtype=np.uint64)).all()
    assert decontaminate.has_bit(table, np.arange(10_000, 200_000, dtype=np.uint64)).mean() < 0.05
