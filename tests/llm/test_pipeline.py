"""corpus_pipeline.run against a brute-force version of its five stages."""

import math
import random
import re

import pytest
import xxhash
import zstandard
from test_decontaminate import brute as leaks
from test_packing import brute as packed

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tidemark.llm import quality  # noqa: E402

GOOD = [f"word{k}" for k in range(3000)]
BAD = "$$$ buy now ### click *** free %%% win cash &&& offer !!!".split()


def corpus(rng):
    rows, labels = [], []
    items = [(k, " ".join(rng.choices(GOOD, k=rng.choice([12, 30])))) for k in range(8)]
    for k in range(240):
        good = k % 4 > 0
        text = " ".join(rng.choices(GOOD if good else BAD, k=rng.randint(60, 160)))
        if k % 10 == 3:
            text += f" write to name{k}@mail.org or 10.0.0.{k}"
        if k % 20 == 7:
            text += " " + rng.choice(items)[1]
        rows.append((k, text, rng.choice(["web", "web", "book", None]), rng.choice(["en", "de"])))
        labels.append((k, int(good), 0))
    for k in range(40):
        words = rows[4 * k + 1][1].split()
        if k % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + k, " ".join(words), "web", "en"))
    rows += [(2000, None, "web", "en"), (2001, "", None, "en"), (None, " ".join(rng.choices(GOOD, k=50)), "web", None), (2002, " ".join(rng.choices(GOOD, k=9000)), "book", "en")]
    return rows, labels, items


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows, model, items):
    compressors = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]

    def score(text):
        raw = (text or "").encode()
        a, b = (len(c.compress(raw)) for c in compressors)
        w = model.weights
        return 1 / (1 + math.exp(-(w[0] * (b - a) / (a + b) + w[1] * math.log((a + b) / (2 * len(raw) + 32)) + w[2])))

    rows = [r for r in rows if score(r[1]) >= 0.3]
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    rows = [rows[min((k for k in range(len(rows)) if root[k] == x), key=order)] for x in set(root)]
    bad = {d for d, _ in leaks(rows, items)}
    rows = [r for r in rows if r[0] not in bad]
    hide = lambda t: t and re.sub(r"10\.0\.0\.[0-9]+", "<ip>", re.sub(r"name[0-9]+@mail\.org", "<email>", t))
    rows = [(r[0], hide(r[1]), *r[2:]) for r in rows]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    digest = lambda t: 42 if t is None else signed(xxhash.xxh64_intdigest(t.encode(), 42))
    pieces = []
    for d, t, source, _ in rows:
        n, c = len((t or "").split()), digest(re.sub(r"\s+", " ", (t or "").strip()).lower())
        pieces += [(-min(4096, n - 4096 * p), d is not None, d or 0, c, p, digest(source)) for p in range(max(1, -(-n // 4096)))]
    pieces.sort()
    bins = packed([-p[0] for p in pieces], [p[5] for p in pieces], [p[3] for p in pieces], 4096, 8)
    return sorted((str(p[2] if p[1] else None), p[4], -p[0], b) for p, b in zip(pieces, bins))


def test_run_matches_brute_force(spark, tmp_path):
    rows, labels, items = corpus(random.Random(1))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    got = sorted((str(r.doc_id), r.piece, r.n_units, r.bin_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute(rows, model, items)
    assert got == want and 100 < len(got) < 230


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows, labels, items = corpus(random.Random(2))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x", 1) for r in rows[:60]], "doc_id long, text string, source string, lang string, n_chars long, leaked string, kept_id int")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
