"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by their number of word shingles: class j holds those of at most ceil(sqrt(2) ** j). For each class that
occurs, a document is cut into overlapping windows hardly longer than the class's items, so an item that a long document quotes makes
up a good part of some window and their MinHash values agree, however long the document is. A document becomes a candidate of an item if one
of PERMUTATIONS minima agrees; then the share of the item's distinct shingles that occur anywhere in the whole document is counted exactly.

One more window holds those shingles of the document that are any item's, wherever they stand, for items that a document scatters.

Recall of the candidate search: an item of which the share `least` = 0.8 lies in one window has a Jaccard similarity of 0.41 or more with
it, so all of 16 minima miss it with a probability of about 2e-4; a verbatim quotation is missed with less than 1e-5, and one of a
single shingle never. A scattered item is found with the same odds where the document quotes few other items; the tests measure it.

Scale: the items' sketch is a bit table that goes to the executors, sized by the number of the items' shingles up to 32 MB; what passes it is joined with the items'
sketches by Spark, which picks the join by the sizes it sees. No text is shuffled. Containment is counted for candidates alone, so a
phrase that many documents and items share makes no rows by itself. Memory: some tens of bytes for each byte of the longest text.

Defined results: letters A-Z count as lower case and words end at ASCII white space; an item of fewer than five words is one shingle
of all its words; an item or document without words has no links; null texts count as empty; repeated rows give one link per doc_id
and item_id (of the text with the highest containment); null ids are kept; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import list_column, parts, stored
from tidemark.llm.simhash import shingle_hashes

WORDS = 5
LEAST = 0.8
PERMUTATIONS = 16
#: Bits for each value that a bit table holds, and the most bits that one has (32 MB to broadcast).
ROOM, MOST_BITS = 1024, 1 << 28
_ODD = np.array([xxhash.xxh64_intdigest(b"multiplier%d" % k) | 1 for k in range(PERMUTATIONS)], np.uint64)[:, None]
_ADD = np.array([xxhash.xxh64_intdigest(b"increment%d" % k) for k in range(PERMUTATIONS)], np.uint64)[:, None]
_SALT = np.array([xxhash.xxh64_intdigest(b"key%d" % k) for k in range(PERMUTATIONS)], np.uint64)[:, None]


def class_size(j: int) -> int:
    return math.ceil(math.sqrt(2) ** j - 1e-9)


def class_of(n: int) -> int:
    j = max(0, math.floor(2 * math.log2(n)))
    while class_size(j) < n:
        j += 1
    return j


def permuted(h: np.ndarray) -> np.ndarray:
    """A row for each permutation. The upper half of a product mixes well."""
    return (h[None, :] * _ODD + _ADD) >> np.uint64(24)


def keys(minima: np.ndarray, words: int, j: int) -> np.ndarray:
    """A 64-bit key of each minimum that tells the permutation, the shingle length and the class apart."""
    x = (minima ^ _SALT) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(words * 1000 + j)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def window_minima(p: np.ndarray, j: int) -> np.ndarray:
    """Minima over windows of five quarter classes, a quarter apart: an item's run of shingles lies within one of them."""
    step = max(1, -(-class_size(j) // 4))
    m = np.minimum.reduceat(p, np.arange(0, p.shape[1], step), axis=1)
    reach = 1 if class_size(j) == 1 else min(5, m.shape[1])
    out = m[:, : m.shape[1] - reach + 1].copy()
    for k in range(1, reach):
        np.minimum(out, m[:, k : m.shape[1] - reach + 1 + k], out=out)
    return out


def item_words(text: str | None) -> int:
    return min(WORDS, len((text or "").encode().split()))


def sketches(items: DataFrame) -> DataFrame:
    """(item_id, words, class, n, shingles, keys) of every item that has words."""

    def rows(batches):
        for batch in batches:
            out = []
            for item_id, text in zip(batch.column(0), batch.column(1)):
                if words := item_words(text := text.as_py()):
                    h = np.unique(shingle_hashes(text, words))
                    j = class_of(len(h))
                    k = keys(permuted(h).min(axis=1, keepdims=True), words, j)
                    out.append((item_id.as_py(), words, j, len(h), h.view(np.int64).tolist(), k[:, 0].view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)], names=names)

    names = ["item_id", "words", "class", "n", "shingles", "keys"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(rows, "item_id long, words int, class int, n long, shingles array<long>, keys array<long>")


def bit_table(df: DataFrame, column: str) -> np.ndarray:
    """Bits set at the values of an array column, modulo their number: ROOM for each distinct value, MOST_BITS at most, so that few others are met by chance."""
    values = df.select(F.explode(column).alias("v")).distinct()
    size = 1 << min(MOST_BITS.bit_length() - 1, max(16, (values.count() * ROOM - 1).bit_length()))
    bit = values.select(F.pmod("v", F.lit(size)).alias("b"))
    words = bit.groupBy((F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    out = np.zeros(size // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint64)


def has_bit(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    v = values & np.uint64(64 * len(table) - 1)
    return (table[v >> np.uint64(6)] >> (v & np.uint64(63)) & np.uint64(1)).astype(bool)


def find_leaks(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found and containment of every pair with a containment of at least `least`."""
    sketch = stored(sketches(items), "item-sketches")
    classes = [(r[0], r[1]) for r in sketch.select("words", "class").distinct().collect()]  # at most 5 x 2 log2(longest item)
    sizes = sorted({w for w, _ in classes})
    in_keys, in_shingles = bit_table(sketch, "keys"), bit_table(sketch, "shingles")

    def rows(batches):
        for batch in parts(batches):
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text, found, hits = text.as_py(), [], []
                for words in sizes:
                    h = shingle_hashes(text, words)
                    near = h[has_bit(in_shingles, h)]
                    if not len(near):
                        continue  # no shingle of this length is an item's
                    hits.append(near)
                    p, scattered = permuted(h), permuted(near).min(axis=1, keepdims=True)
                    for w, j in classes:
                        if w == words:
                            for minima in (window_minima(p, j), scattered):
                                k = keys(minima, words, j)
                                found.append(k[has_bit(in_keys, k)])
                if any(map(len, found)):
                    found, hits = np.unique(np.concatenate(found)), np.unique(np.concatenate(hits))
                    doc_id = doc_id.as_py()
                    out.append((doc_id, f"{doc_id}:{xxhash.xxh3_128_hexdigest((text or '').encode())}", found, hits))
            if out:
                ids, names, found, hits = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), list_column(found), list_column(hits)], names=["doc_id", "row", "keys", "hits"])

    near = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, row string, keys array<long>, hits array<long>")
    near = stored(near, "near-items")
    items_by_key = sketch.select("item_id", F.xxhash64("words", "shingles").alias("item"), F.explode("keys").alias("key"))
    candidates = near.select("row", F.explode("keys").alias("key")).join(items_by_key, "key").select("row", "item_id", "item").distinct()
    whole = sketch.select(F.col("item_id").alias("id"), F.xxhash64("words", "shingles").alias("item"), "n", "shingles").distinct()
    met = candidates.join(whole, (candidates.item == whole.item) & candidates.item_id.eqNullSafe(F.col("id"))).select("row", "item_id", "n", "shingles")
    counted = met.join(near.select("doc_id", "row", "hits"), "row").select("doc_id", "item_id", "n", F.size(F.array_intersect("hits", "shingles")).cast("long").alias("n_found"))
    pairs = counted.where(F.col("n_found") >= F.lit(least) * F.col("n"))
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_found") / F.col("n")).alias("c"), "n", "n_found")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n").alias("n_shingles"), F.col("m.n_found").alias("n_found"), F.col("m.c").alias("containment"))


def remove_leaks(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs whose doc_id holds no item."""
    bad = find_leaks(docs, items, least).select("doc_id").distinct()
    # Aliases keep columns of docs apart that have the same names.
    return docs.alias("d").join(bad.alias("b"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")), "left_anti").select("d.*")
