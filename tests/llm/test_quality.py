import math
import random
import zlib

import zstandard

from tidemark.llm import quality


def corpus(n, rng):
    good = "the river runs past an old stone mill where people come to trade grain and talk about weather".split()
    bad = "$$$ buy now ### click *** free %%% win cash &&& offer !!!".split()
    return [(k, " ".join(rng.choices(good if k % 3 else bad, k=rng.randint(20, 120))), int(k % 3 > 0)) for k in range(n)]


def frames(spark, rows):
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t, _ in rows], "doc_id long, text string, score string, quality string")
    return docs, spark.createDataFrame([(k, q, 0) for k, _, q in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows = corpus(600, random.Random(1))
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for k, r in got.items())
    held = [(got[k].predicted, q) for k, _, q in rows if got[k].held_out]
    assert sum(a == b for a, b in held) > 0.95 * len(held)


def test_held_out_labels_are_not_learnt(spark):
    rows = corpus(300, random.Random(2))
    docs, labels = frames(spark, rows)
    turned = [(k, t, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q) for k, t, q in rows]
    assert quality.fit(docs, labels) == quality.fit(docs, frames(spark, turned)[1])


def test_rows(spark):
    rows = corpus(200, random.Random(3)) + [(None, None, 1), (1000, "", 0), (1001, "a " * 200_000, 1), (5, "again", 1)]
    docs, labels = frames(spark, rows)
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == len(rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(docs.limit(0), labels).good == b""
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_scores_match_their_definition(spark):
    rows = corpus(200, random.Random(4)) + [(900, "", 1), (901, None, 0), (902, "x " * 50_000, 1)]
    docs, labels = frames(spark, rows)
    model = quality.fit(docs, labels)
    sides = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for k, text, _ in rows:
        raw = (text or "").encode()
        a, b = (len(c.compress(raw)) for c in sides)
        z = model.weights[0] * (b - a) / (b + a) + model.weights[1] * math.log((a + b) / (2 * len(raw) + 32)) + model.weights[2]
        assert abs(got[k].score - 1 / (1 + math.exp(-z))) < 1e-9 and got[k].predicted == int(got[k].score >= 0.3)


def test_the_sample_is_bounded(spark, monkeypatch):
    rows = corpus(300, random.Random(5))
    docs, labels = frames(spark, rows)
    many = docs.unionByName(docs.withColumn("text", quality.F.concat(quality.F.lit("zz "), "text")))
    assert quality.fit(many, labels) == quality.fit(many.repartition(5), labels)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 20_000)
    assert 0 < len(quality.fit(docs, labels).good) <= quality.DICT
