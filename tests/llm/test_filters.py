import itertools
import random

from tidemark.llm import filters


def brute(docs, labels):
    """Every part, order and step, document by document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    last = 1 << 63
    masks = {}
    for at, (doc_id, text, lang) in enumerate(docs):
        text = text or ""
        words = [w for w in text.translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if w]
        m = set()
        if len(words) < 200:
            m.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            m.add("B")
        if 100 * sum("A" <= x <= "Z" for x in text) > 3 * len(text):
            m.add("C")
        if set(text) & set("#$%&*|"):
            m.add("D")
        own = last if doc_id is None else doc_id
        if any((t or "") == text and (last if d is None else d) < own for d, t, _ in docs):
            m.add("E")
        masks.setdefault(lang or "", []).append((m, doc_id in good, doc_id in toxic))
    out = []
    for part, rows in masks.items():
        shapley = dict.fromkeys("ABCDE", 0)
        made = []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                removed = [r for r in rows if f in r[0] and not r[0] & before]
                shapley[f] += len(removed)
                made.append((part, "".join(order), k + 1, sum(f not in r[0] and not r[0] & before for r in rows), len(removed), sum(f in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {f} for r in rows), sum(r[1] for r in removed), sum(r[2] for r in removed), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in made]
    return out


def text(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "x", "é", "😀", "\x85", "50%", "a b"]) if rng.random() < 0.2 else f"w{rng.randrange(900)}" for _ in range(n))


def test_matches_brute_force(spark):
    rng = random.Random(4)
    texts = [text(rng, rng.choice([0, 3, 150, 199, 200, 201, 400])) for _ in range(60)] + ["", None, " \t\n", "A" * 300, "same " * 300]
    long = text(rng, 30_000)
    texts += [long, long, long[:-1] + "!", "#" + long[1:], long[:300] + "?" + long[301:]]
    docs = [(k, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    docs += [(rng.randrange(-5, 400), rng.choice(texts), rng.choice(["en", "fr"])) for _ in range(80)] + [(None, texts[3], "en"), (None, texts[3], "en"), (None, "only here", "fr"), (7, texts[7], "en"), (7, texts[8], "en")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(-5, 90)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, lang string, mask string, n string")
    got = filters.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = sorted(brute(docs, labels))
    assert sorted(tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got.collect()) == want
    assert filters.audit(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_equal_hashes_are_decided_by_the_texts(spark, monkeypatch):
    """With hashes that are all equal, comparison of full texts alone tells copies from others of the same length."""
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(["abc", "abd", "abc", "abe", "abd", "abc", "xy", "xz"])], "doc_id long, text string, lang string")
    known = filters.facts(docs).withColumn("h", filters.F.lit(1).cast("long"))
    assert sorted(r.did for r in filters.duplicates(docs, known).collect()) == [2, 4, 5]
