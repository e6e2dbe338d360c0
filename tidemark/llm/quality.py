"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is compressed with either; the difference of
the two sizes over their sum says which it resembles. A logistic curve, fitted on labelled texts that the dictionaries have not seen,
turns it into a score between 0 and 1. The curve also knows how far the text compresses at all, as text that repeats itself
compresses well with any dictionary.

Bound: the model is fitted on at most SAMPLE labelled documents of each class, those with the smallest hash of doc_id, while their texts
together stay within SAMPLE_BYTES (documented parameters); scoring reads every text whole. Where a labelled doc_id has several texts, the
first in order is learnt from. The model that goes to the executors is two dictionaries of at most DICT bytes.

Defined results: a null text counts as empty; an empty text scores the curve at what an empty frame gives; a null doc_id is not held out
and is scored; labels with a null doc_id or quality are not used; without labels of both classes every score is the share of label 1
(0.5 without labels); repeated rows and other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 1500
SAMPLE_BYTES = 64_000_000
DICT = 65_536
LEVEL = 3
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@dataclasses.dataclass(frozen=True)
class Model:
    """good and bad: dictionaries' bytes, empty where there was no text of both classes; weights: of the features, the constant last."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def features(self):
        good, bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad))

        def of(text: str | None) -> tuple[float, float]:
            raw = (text or "").encode()
            a, b = len(good.compress(raw)), len(bad.compress(raw))
            return (b - a) / (b + a), math.log((a + b) / (2 * len(raw) + 32))  # above zero where the good dictionary compresses better

        return of

    def scorer(self):
        of = self.features() if self.good else lambda text: ()

        def score(text: str | None) -> float:
            z = sum(w * x for w, x in zip(self.weights, (*of(text), 1.0)))
            return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

        return score


def _dict(data: bytes) -> zstandard.ZstdCompressionDict:
    out = zstandard.ZstdCompressionDict(data)
    out.precompute_compress(level=LEVEL)
    return out


def build_dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; where the texts are too few to train one, their own last bytes."""
    raw = [t.encode() for t in texts if t]
    try:
        return zstandard.train_dictionary(DICT, raw).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(raw)[-DICT:]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-5) -> tuple[float, ...]:
    """Weights by Newton's method, the constant last, lightly regularised so that separable classes end too."""
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * len(x) * np.eye(len(w)), a.T @ (y - p) - ridge * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / scale
    return (*slopes.tolist(), float(w[-1] - slopes @ mean))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From labelled rows that are not held out; nothing but text and label is used."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    rows = known.withColumn("rank", F.xxhash64("doc_id"))
    bounded = [rows.where(F.col("quality") == q).orderBy("rank", "doc_id").limit(sample) for q in (0, 1)]
    chosen = bounded[0].unionByName(bounded[1])
    share = known.agg(F.avg("quality")).first()[0]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("rank", "doc_id", "quality").agg(F.min("text").alias("text"))
    together = F.sum(F.octet_length("text")).over(Window.partitionBy("quality").orderBy("rank", "doc_id"))
    got = sorted(tuple(r) for r in texts.withColumn("bytes", together).where(F.col("bytes") <= SAMPLE_BYTES).select("rank", "doc_id", "quality", "text").collect())
    # Every other text builds a dictionary; the rest calibrate.
    split = {(q, k): [t for _, _, quality, t in got if quality == q][k::2] for q in (0, 1) for k in (0, 1)}
    if not all(any(x) for x in split.values()):
        share = 0.5 if share is None else min(max(share, 1e-6), 1 - 1e-6)
        return Model(b"", b"", (math.log(share / (1 - share)),))
    draft = Model(build_dictionary(split[1, 0]), build_dictionary(split[0, 0]), ())
    of = draft.features()
    x = [(of(t), q) for q in (0, 1) for t in split[q, 1]]
    return dataclasses.replace(draft, weights=logistic(np.array([f for f, _ in x]), np.array([float(q) for _, q in x])))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text)."""

    def rows(batches):
        scorer = model.scorer()
        for batch in batches:
            s = [scorer(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score the threshold or more."""

    def rows(batches):
        scorer = model.scorer()
        for batch in batches:
            k = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([scorer(t.as_py()) >= threshold for t in batch.column(k)], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
