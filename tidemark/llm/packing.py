"""Conflict-constrained best-fit packing of documents into sequences of a fixed length.

Bins stand in the order of what they have left (residual). A piece goes to the bin with the smallest residual that it fits into and
that it doesn't conflict with: the search starts at the first residual that is large enough and goes on to its successors until a
compatible bin is found; else a new bin opens. A bin carries bitmaps: one of the duplicate clusters it holds (two pieces of one
cluster never share a bin) and, in layers, one of its sources (layer k has a source's bit once the bin holds over k of its pieces),
so at most `per_source` pieces of one source share a bin. Within a shard the bits are numbered densely, and only names that can
conflict there have one, so the bitmaps are exact.

Pieces come longest first, and among equal lengths by source and cluster, those that can't conflict ahead: what the search has passed for a source stays passed for the
next piece of that source and length, and what it has passed for a cluster is looked at again for the next cluster only, so that many
copies or one hot source take about linear time.

Scale: pieces are dealt by a hash of the document, and of its number among equal rows, to shards of about SHARD units each, so a task holds
one bounded shard, and a hot source, cluster or row is spread evenly. Only ids, lengths and hashes are shuffled, never texts; lengths are taken once and stored.

Defined results: a text longer than the capacity is cut into pieces of the capacity and a rest; an empty or null text is one piece of
length 0, which conflicts with nothing; a null doc_id or source is a value like any other; repeated rows are packed each (they share a
cluster); an empty table gives no rows. Bin ids are unique and the result does not depend on how the input is partitioned.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

CAPACITY = 4096
PER_SOURCE = 8
SHARD = 4_000_000


def words(text: Column) -> Column:
    """Length in words that white space separates."""
    return F.when(F.length(F.trim(text)) > 0, F.size(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"))).otherwise(0)


def numbered(names: np.ndarray, counted: np.ndarray, most: int) -> np.ndarray:
    """A number from 0 for each name that occurs more than `most` times among the counted pieces, -1 for the others."""
    values, at, times = np.unique(names[counted], return_inverse=True, return_counts=True)
    out = np.full(len(names), -1)
    out[counted] = np.where(times > most, np.cumsum(times > most) - 1, -1)[at]
    return out


def pack(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, per_source: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. sources and clusters: 64-bit hashes. Equal pieces are taken in the order given."""
    order: list[tuple[int, int]] = []  # (residual, bin) of bins that have room
    source_bits: list[list[int]] = []
    cluster_bits: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    source, cluster_of = numbered(sources, lengths > 0, per_source), numbered(clusters, lengths > 0, 1)
    turn = np.lexsort((cluster_of, source, -lengths))
    before = None
    for k, need, s, c in zip(turn.tolist(), lengths[turn].tolist(), source[turn].tolist(), cluster_of[turn].tolist()):
        s, c = (1 << x if x >= 0 else 0 for x in (s, c))
        if (need, s) != before:
            before, cluster = (need, s), c
            at, passed, again = bisect.bisect_left(order, (need, -1)), [], 0
        if c != cluster:
            cluster, again = c, 0
        # Bins that were passed for a cluster, then the rest of the order.
        found = None
        while again < len(passed) and found is None:
            if cluster_bits[passed[again][1]] & c:
                again += 1
            else:
                found = passed.pop(again)
                if source_bits[found[1]][-1] & s:
                    found = None
        if found is not None:
            place = bisect.bisect_left(order, found)
            del order[place]
            at -= 1
        while found is None and at < len(order):
            residual, b = order[at]
            if source_bits[b][-1] & s:
                at += 1
            elif cluster_bits[b] & c:
                passed.append(order[at])
                again = len(passed)
                at += 1
            else:
                found = order.pop(at)
        if found is None:
            found = capacity, len(cluster_bits)
            cluster_bits.append(0)
            source_bits.append([0] * per_source)
        residual, b = found
        cluster_bits[b] |= c
        for layer in range(per_source if s else 0):
            if not source_bits[b][layer] & s:
                source_bits[b][layer] |= s
                break
        bins[k], offsets[k] = b, capacity - residual
        if residual - need > 0 or need == 0:
            rest = residual - need, b
            place = bisect.bisect_left(order, rest)
            order.insert(place, rest)
            if place < at or rest[0] < need:
                at += 1
                if rest[0] >= need:  # it holds the cluster, but the next cluster may go there
                    again += c > 0 and bisect.bisect_left(passed, rest) <= again
                    bisect.insort(passed, rest)
    return bins, offsets


def numbered_rows(sized: DataFrame, block: int = 65_536) -> DataFrame:
    """Equal rows with a number each (copy), so that they are dealt to different shards: counted, then spread in blocks of numbers."""
    counts = sized.groupBy(*sized.columns).agg(F.count("*").alias("copies"))
    many = F.col("copies") > block
    blocks = counts.where(many).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(block).cast("long"))).alias("from")).repartition("t", "from")
    one = counts.where(~many).withColumn("from", F.lit(0).cast("long"))
    each = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + block, F.col("copies")) - 1)).alias("copy")
    return blocks.unionByName(one).select(*sized.columns, each)


def best_fit(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD, length: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """doc_id, piece, n_units, bin_id and bin_offset of every piece of docs(doc_id, text, source).

    length: units of a document, words by default; cluster: what duplicates share, by default the text in lower case with single spaces.
    """
    length = words(F.col("text")) if length is None else length
    cluster = F.xxhash64(F.lower(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " "))) if cluster is None else cluster
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("source").alias("s"), cluster.alias("c"), F.xxhash64("text").alias("t"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    sized = stored(sized, "lengths")
    total = sized.agg(F.sum("n"), F.count("*")).first()
    shards = max(1, -(-(total[0] or 0) // shard), -(-total[1] // (shard // 64)))
    whole = F.expr(f"sequence(0, greatest(cast(ceil(n / {capacity}) as int), 1) - 1)")
    pieces = numbered_rows(sized).select("*", F.explode(whole).alias("piece")).select(
        F.pmod(F.xxhash64("doc_id", "t", "piece", "copy"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "piece", "s", "c", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("n")
    )
    dealt = pieces.repartition(max(1, min(shards, 100_000)), "shard").sortWithinPartitions("shard", F.desc("n"), "doc_id", "c", "piece", "s")
    names, types = ["doc_id", "piece", "n_units", "bin_id", "bin_offset"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def one(shard_id: int, rows: list[pa.Table]) -> list[pa.RecordBatch]:
        t = pa.concat_tables(rows)
        bins, offsets = pack(*(t.column(k).to_numpy() for k in ("n", "s", "c")), capacity, per_source)
        cols = [t.column("doc_id"), t.column("piece"), t.column("n"), (np.int64(shard_id) << 32) + bins, offsets]
        return [pa.RecordBatch.from_arrays([(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c)).cast(k) for c, k in zip(cols, types)], names=names)]

    def rows(batches):
        held, held_id = [], None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            ids = t.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and ids[a] != held_id:
                    yield from one(held_id, held)
                    held = []
                held_id = int(ids[a])
                held.append(t.slice(a, b - a))
        if held:
            yield from one(held_id, held)

    return dealt.mapInArrow(rows, "doc_id long, piece int, n_units long, bin_id long, bin_offset long")
