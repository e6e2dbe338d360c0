"""An audit of how quality filters interact: what each removes, alone and after the others, in every order.

Exact duplicates are found by partition refinement. Documents are split by their length in code points, then by the hashes of successive
blocks of their texts, each FACTOR times as long as the one before; a document alone in its class is dropped after every split. The full
texts of what survives all splits are compared with that of the class's smallest document; a text that differs (equal hashes of different
blocks) starts a class of its own. Documents of a class but the smallest are marked. Then every document is a mask of the filters that it
fails, masks are counted by part, and all figures for all orders follow from the counts.

Scale: one pass over the texts takes all conditions, the length and the first block's hash. The other passes read the texts of survivors
alone, kept apart by a bit table of fixed size, and the join decides. Classes are counted map side first and joined back, so a class of any
size can be split. Masks of five filters by part and label are a few rows; the orders are a fixed list that is multiplied with these.

Defined results: a null text is empty, a null lang is the empty string; a null doc_id is larger than any other and has no labels; rows with one doc_id are
no duplicates of each other but count each; repeated labels of a document count once (quality and toxic if any says so); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, parts, stored
from tidemark.llm.repeats import LAST, bit_table, marked

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
BLOCK, FACTOR = 256, 8
_SIGNS = re.compile(rb"[#$%&*|]")
_UPPER = bytes(range(65, 91))


def fails(text: bytes, n_chars: int) -> int:
    """A: under 200 words; B: under half of the words distinct; C: over 3 % of the characters A-Z; D: any of # $ % & * |."""
    words = text.split()
    upper = len(text) - len(text.translate(None, _UPPER))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 3 * n_chars) << 2 | (_SIGNS.search(text) is not None) << 3


def facts(docs: DataFrame) -> DataFrame:
    """did, rid (a hash of the text), part, mask of all filters but the last, n (code points) and h, the first block's hash."""

    def rows(batches):
        for batch in parts(batches):
            out = []
            for t in batch.column(2):
                text = t.as_py()
                raw = text.encode()
                out.append((xxhash.xxh3_64_intdigest(raw) - (1 << 63), fails(raw, len(text)), len(text), xxhash.xxh3_64_intdigest(text[:BLOCK]) - (1 << 63)))
            rid, mask, n, h = (pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), rid, batch.column(1), mask, n, h], names=["did", "rid", "part", "mask", "n", "h"])

    none = F.lit("")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.coalesce("lang", none).alias("part"), F.coalesce("text", none).alias("text"))
    return own.mapInArrow(rows, "did long, rid long, part string, mask int, n long, h long")


def refined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys occur more than once."""
    again = rows.groupBy(*keys).agg(F.count("*").alias("_c")).where("_c > 1").drop("_c")
    return rows.join(again, keys, "left_semi")


def block_hashes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(did, rid, ...) with text and blocks: the hashes of its blocks after the first."""

    def hashed(batches):
        for batch in parts(batches):
            out = []
            for t in batch.column(2):
                text, a, size, own = t.as_py(), BLOCK, BLOCK * FACTOR, []
                while a < len(text):
                    own.append(xxhash.xxh3_64_intdigest(text[a : a + size]) - (1 << 63))
                    a, size = a + size, size * FACTOR
                out.append(own)
            rid = pa.array([xxhash.xxh3_64_intdigest(t.as_py().encode()) - (1 << 63) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), rid, batch.column(2), pa.array(out, pa.list_(pa.int64()))], names=["did", "rid", "text", "blocks"])

    bits = docs.sparkSession.sparkContext.broadcast(bit_table(rows, "n"))
    ids = docs.sparkSession.sparkContext.broadcast(bit_table(rows, "did"))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    texts = marked(marked(own, bits, True, "n"), ids, True, "did").mapInArrow(hashed, "did long, rid long, text string, blocks array<long>")
    return rows.join(texts.dropDuplicates(["did", "rid"]), ["did", "rid"])


def duplicates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of known (by `facts`) whose text a document with a smaller id has, table-wide."""
    left = stored(refined(refined(known, ["n"]), ["n", "h"]), "survivors")
    if left.isEmpty():
        return left
    texts = stored(block_hashes(docs, left), "survivor-texts")
    discard(left)
    rows = texts.select("did", "rid", "part", "mask", "n", "h", "blocks")
    longest = rows.agg(F.max(F.size("blocks"))).first()[0] or 0
    for k in range(longest):
        # A class is known by its length and the hash that all of its blocks so far give.
        rows = refined(rows.withColumn("h", F.when(F.size("blocks") > k, F.xxhash64("h", F.get("blocks", F.lit(k)))).otherwise(F.col("h"))), ["n", "h"])
    rows = stored(rows.select("did", "rid", "part", "mask", "n", "h"), "classes")
    out, level = None, 0
    while not rows.isEmpty():
        # The class's smallest document has its text beside all others of the class.
        least = rows.groupBy("n", "h").agg(F.min(F.struct("did", "rid")).alias("m")).select("n", "h", F.col("m.did").alias("did"), F.col("m.rid").alias("rid"))
        own = texts.select("did", "rid", "text").dropDuplicates(["did", "rid"])  # of repeated rows
        first = least.join(own, ["did", "rid"]).select("n", "h", F.col("did").alias("first"), F.col("text").alias("first_text"))
        both = stored(rows.join(own, ["did", "rid"]).join(first, ["n", "h"]).select(*rows.columns, (F.col("text") == F.col("first_text")).alias("same"), (F.col("did") > F.col("first")).alias("later")), f"compared{level}")
        found = both.where("same and later").select(*rows.columns)
        out = found if out is None else out.unionByName(found)
        discard(rows)
        rows, level = stored(both.where("not same").select(*rows.columns), "classes"), level + 1
    return known.limit(0) if out is None else out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The figures of every part(lang), filter_order and step; see the module."""
    known = stored(facts(docs), "facts")
    copies = stored(duplicates(docs, known), "copies")
    last = 1 << len(FILTERS) - 1
    one = lambda df, mask, w: df.select("did", "part", mask.alias("mask"), F.lit(w).alias("w"))
    m = F.col("mask")
    rows = one(known, m, 1).unionByName(one(copies, m, -1)).unionByName(one(copies, m.bitwiseOR(F.lit(last)), 1))
    yes = lambda c: F.max((F.col(c) == 1).cast("int"))
    labelled = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("did")).agg(F.coalesce(yes("quality"), F.lit(0)).alias("good"), F.coalesce(yes("toxic"), F.lit(0)).alias("toxic"))
    each = rows.join(labelled, "did", "left")
    counts = each.groupBy("part", "mask").agg(F.sum("w").alias("c"), F.sum(F.col("w") * F.coalesce("good", F.lit(0))).alias("g"), F.sum(F.col("w") * F.coalesce("toxic", F.lit(0))).alias("t"))
    return orders(counts)


def orders(counts: DataFrame) -> DataFrame:
    """All orders and steps over counts(part, mask, c, g, t), where g and t are those of good and toxic documents."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    made = [(f"{''.join(p)}", k + 1, sum(bit[f] for f in p[:k]), bit[f]) for p in itertools.permutations(FILTERS) for k, f in enumerate(p)]
    every = F.explode(F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(f).alias("own")) for o, s, b, f in made)))
    # A part's masks stand in one row (at most 2 ** 5), so the fixed list of orders multiplies parts, not counts.
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "c", "g", "t")).alias("masks"))
    rows = held.select("part", "masks", every.alias("x")).select("part", "masks", "x.*")
    b, f, n = F.col("before"), F.col("own"), len(list(itertools.permutations(FILTERS)))

    def total(value: str, when):
        return F.aggregate("masks", F.lit(0).cast("long"), lambda acc, x: acc + F.when(when(x["mask"]), x[value]).otherwise(0))

    free, hit = lambda m: m.bitwiseAND(b) == 0, lambda m: m.bitwiseAND(f) != 0
    gone = lambda m: free(m) & hit(m)
    # Among the filters that a document fails, each comes first in an equal share of all orders.
    first = F.aggregate("masks", F.lit(0).cast("long"), lambda acc, x: acc + F.when(hit(x["mask"]), (x["c"] * F.lit(n) / F.bit_count(x["mask"])).cast("long")).otherwise(0))
    return rows.select(
        "part", "filter_order", "step", total("c", lambda m: free(m) & ~hit(m)).alias("kept"), total("c", gone).alias("removed"), total("c", lambda m: ~free(m) & hit(m)).alias("redundant"),
        total("c", lambda m: m == f).alias("unique_fails"), total("g", gone).alias("good_lost"), total("t", gone).alias("toxic_lost"), first.alias("shapley"),
    )
