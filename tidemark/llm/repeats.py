"""What the two removals of repeated passages share: minimisers, super-k-mers and the traffic between documents and buckets.

A document is a sequence of units (bytes or words). Each window of `window` units has a minimiser, the least hash of its `anchor`-unit
grams, so equal windows have equal minimisers. Consecutive windows with the same minimiser form a super-k-mer, which travels as one packed
string. The steps:

1. Minimisers alone are counted over all documents, twice where a super-k-mer may repeat a window in itself (short periods); a window
   whose minimiser counts once can't be repeated.
2. Documents with a repeated minimiser are cut into super-k-mers; the places of those with a repeated one are stored, with a hash.
3. Equal strings are aggregated by their hashes (map side first), so copies meet as one row with a count and their first occurrence.
4. Where a minimiser has several distinct strings, or one in which it recurs, they go to its bucket, each once, packed from its first
   occurrence, and the operator decides exactly which windows are repeated. A string alone in its bucket needs no decision: its count tells.
5. Decisions return to all occurrences of a string, and by document to the text.

Equal rows (doc_id and text) are first counted and stand as one row; their strings count as often as there are rows, decisions are handed out
once, and the answer is repeated at the end.

Scale: each shuffle is by a hash; hot minimisers are pre-aggregated in 1 and 3. The joins of 1, 4 and 5 are between stored tables, so that
Spark can split a hot key. A bucket of over HOT distinct strings is not given to one task but divided by the same steps with minimisers of
longer grams: super-k-mers within its strings, equal ones aggregated, to buckets of their own, again until none is too large (in the end the
gram is the window, and a bucket holds one window). Whether a document matters for 2 and 5 is first asked from a bit table of fixed size,
which only saves work: the join decides. A finished step is a table in the shared folder, so a lost executor costs its tasks alone; what no
later step reads is deleted.

Memory: a task holds a batch of documents (Arrow's limit in rows) and some tens of bytes for each byte of the longest one, or whole buckets of at
most HOT strings of a bounded length.
"""

from __future__ import annotations

import dataclasses
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored

BITS = 1 << 24
MUL = np.uint64(0x9E3779B97F4A7C15)
LAST = (1 << 63) - 1
#: Distinct strings of a bucket that one task takes; larger buckets are divided further.
HOT = 20_000


@dataclasses.dataclass(frozen=True)
class Kind:
    """split: the units of a text; hashes: one of each unit; join: units from a to b as a packed string; unpack: its units again."""

    window: int
    anchor: int
    split: Callable
    hashes: Callable
    join: Callable
    unpack: Callable

    @property
    def reach(self) -> int:
        return self.window - self.anchor + 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * MUL
    return x ^ (x >> np.uint64(32))


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` units, put together from runs of powers of two."""
    out, have, power, width = None, 0, h, 1
    while True:
        if size & width:
            if out is None:
                out = power
            else:
                n = max(0, min(len(out), len(power) - have))
                out = mixed(out[:n] * MUL + power[have : have + n])
            have += width
        if have == size:
            return out[: max(0, len(h) - size + 1)]
        power = mixed(power[:-width] * MUL + power[width:]) if len(power) > width else power[:0]
        width *= 2


def runs(h: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer, and the grams' hashes. Runs are cut at 4 x reach windows."""
    none = np.empty(0, np.int64)
    if len(h) < kind.window:
        return none.view(np.uint64), none, none, none.view(np.uint64)
    g = rolled(h, kind.anchor)
    low, span, reach = g, 1, kind.reach
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    n = len(g) - reach + 1
    low = np.minimum(low[:n], low[reach - span : reach - span + n])
    start = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    size = np.diff(np.concatenate([start, [n]]))
    most = 4 * reach
    if (size > most).any():
        pieces = -(-size // most)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, size = np.repeat(start, pieces) + within * most, np.minimum(most, np.repeat(size, pieces) - within * most)
    return low[start], start, size, g


def recurring(mini: np.ndarray, start: np.ndarray, size: np.ndarray, g: np.ndarray, kind: Kind) -> np.ndarray:
    """Which super-k-mers may repeat a window in themselves.

    The grams between two equal windows of one super-k-mer are periodic, so one of its windows starts with the minimiser and, further on,
    one ends with it.
    """
    low = np.repeat(mini, size)
    begins, ends = np.flatnonzero(g[: len(low)] == low), np.flatnonzero(g[kind.reach - 1 :] == low)
    first, last = np.searchsorted(begins, start), np.searchsorted(ends, start + size) - 1
    begin, end = np.append(begins, len(g))[first], np.append(ends, -len(g) - kind.reach)[last]
    return (begin < start + size) & (end >= start) & (begin < end + kind.reach - 1)


def keyed(docs: DataFrame) -> DataFrame:
    """did: doc_id, the largest number for null; rid: a hash of the row, so that rows with the same doc_id and text are one document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("did"), F.xxhash64("doc_id", "text").alias("rid"), "text")


def minimisers(docs: DataFrame, kind: Kind, each: bool, without=None) -> DataFrame:
    """(mini, rid) for each super-k-mer, twice for one that may repeat a window in itself, or (each) whose row occurs more than once.

    without: a broadcast bit table; rows that it has are left out.
    """

    def own(text, times):
        mini, start, size, g = runs(kind.hashes(kind.split(text)), kind)
        return np.repeat(mini, 1 + (recurring(mini, start, size, g, kind) | (each and times > 1))) if len(mini) else mini

    def rows(batches):
        for batch in batches:
            batch = batch if without is None else unset(batch, without)
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [own(t.as_py(), n) for t, n in zip(part.column(1), part.column(2).to_pylist())]
                rid = np.repeat(part.column(0).to_numpy(), [len(x) for x in found])
                mini = np.concatenate(found) if found else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(mini.view(np.int64)), pa.array(rid)], names=["mini", "rid"])

    return docs.select("rid", "text", "times").mapInArrow(rows, "mini long, rid long")


def release(spark) -> None:
    """Let Spark's cleaner drop the shuffle files of steps whose results are stored; it waits for a collection of the driver's heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bit_table(df: DataFrame, column: str) -> np.ndarray:
    """BITS bits, set at a column's values modulo BITS: at most BITS / 64 rows, whatever the input's size."""
    bit = df.select(F.pmod(column, F.lit(BITS)).alias("b"))
    words = bit.groupBy((F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return out


def unset(batch, *tables):
    """The rows of a batch whose rid isn't in any of the bit tables."""
    v = batch.column(batch.schema.get_field_index("rid")).to_numpy() & (BITS - 1)
    on = np.zeros(len(v), bool)
    for bits in tables:
        on |= (bits.value[v >> 6] >> (v & 63) & 1).astype(bool)
    return batch.filter(pa.array(~on))


def marked(docs: DataFrame, bits, yes: bool, column: str = "rid", also=None) -> DataFrame:
    """Rows of which a column's bit is set, or isn't. bits: a broadcast variable of the bit table; also: one in which it must not be set."""

    def rows(batches):
        for batch in batches:
            v = batch.column(batch.schema.get_field_index(column)).to_numpy() & (BITS - 1)
            on = (bits.value[v >> 6] >> (v & 63) & 1).astype(bool) == yes
            if also is not None:
                on &= (also.value[v >> 6] >> (v & 63) & 1) == 0
            yield batch.filter(pa.array(on))

    return docs.mapInArrow(rows, docs.schema)


def occurrences(docs: DataFrame, touched: DataFrame, kind: Kind) -> DataFrame:
    """mini, dig (hash of the string), did, rid, start, n (windows), twice (it may repeat a window in itself) and times (of its row) of each super-k-mer in touched."""

    def rows(batches):
        for batch in batches:
            out, held = [], 0
            for did, rid, text, times, minis in zip(*batch.columns):
                units = kind.split(text.as_py())
                mini, start, size, g = runs(kind.hashes(units), kind)
                twice = recurring(mini, start, size, g, kind) if len(mini) else start.astype(bool)
                chosen = np.flatnonzero(np.isin(mini, minis.values.to_numpy().view(np.uint64)))
                m, a, n = mini[chosen], start[chosen], size[chosen]
                dig = np.fromiter((xxhash.xxh3_64_intdigest(kind.join(units, i, j)) for i, j in zip(a.tolist(), (a + n + kind.window - 1).tolist())), np.uint64, len(m))
                out.append((m.view(np.int64), dig.view(np.int64), np.full(len(m), did.as_py()), np.full(len(m), rid.as_py()), a, n, twice[chosen], np.full(len(m), times.as_py())))
                held += len(m)
                if held > 50_000:
                    yield made(out)
                    out, held = [], 0
            if out:
                yield made(out)

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(t) for c, t in zip(zip(*out), types)], names=names)

    names = ["mini", "dig", "did", "rid", "start", "n", "twice", "times"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
    schema = "mini long, dig long, did long, rid long, start int, n int, twice boolean, times long"
    return docs.join(touched, "rid").select("did", "rid", "text", "times", "minis").mapInArrow(rows, schema)


def packed_strings(docs: DataFrame, distinct: DataFrame, kind: Kind) -> DataFrame:
    """The rows of distinct, each with `packed`, the string at its first occurrence. Rows of docs with an equal rid repeat them."""
    inner = ["mini", "dig", "count", "fdid", "fstart", "n", "twice", "strings"]

    def rows(batches):
        for batch in batches:
            at, size, a = batch.column("found").offsets.to_numpy(), 0, 0
            text_bytes = pc.binary_length(batch.column("text")).to_numpy()
            for k in range(batch.num_rows):
                size += int(text_bytes[k])
                if size > 4_000_000 or k + 1 == batch.num_rows:
                    yield made(batch.slice(a, k + 1 - a), np.diff(at[a : k + 2]))
                    size, a = 0, k + 1

    def made(part, each):
        flat = part.column("found").flatten()
        end, packed = np.cumsum(each), []
        spans = list(zip(flat.field("fstart").to_pylist(), flat.field("n").to_pylist()))
        for text, a, b in zip(part.column("text"), (end - each).tolist(), end.tolist()):
            units = kind.split(text.as_py())
            packed += [kind.join(units, i, i + n + kind.window - 1) for i, n in spans[a:b]]
        rid = pa.array(np.repeat(part.column("rid").to_numpy(), each))
        return pa.RecordBatch.from_arrays([*(flat.field(c) for c in inner), rid, pa.array(packed, pa.binary())], names=[*inner, "frid", "packed"])

    asked = distinct.groupBy(F.col("frid").alias("rid")).agg(F.collect_list(F.struct(*inner)).alias("found"))
    schema = "mini long, dig long, count long, fdid long, fstart int, n int, twice boolean, strings long, frid long, packed binary"
    return docs.join(asked, "rid").select("rid", "text", "found").mapInArrow(rows, schema)


def by_bucket(rows: DataFrame, decide: Callable, most: int = 8000) -> DataFrame:
    """(mini, dig, mask): bits of a distinct string's windows. decide: masks of a few whole buckets, given as columns. Equal rows count once."""

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            minis = held.column("mini").to_numpy()
            other = np.flatnonzero(minis != minis[-1]) if len(minis) else minis
            whole = other[-1] + 1 if len(other) else 0
            if whole:
                yield from pieces(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from pieces(held)

    def pieces(t):
        minis, digs = t.column("mini").to_numpy(), t.column("dig").to_numpy()
        t = t.filter(pa.array(np.append(True, (minis[1:] != minis[:-1]) | (digs[1:] != digs[:-1]))))
        minis = t.column("mini").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(minis)) + 1, [len(minis)]])
        a = 0
        while a < len(starts) - 1:
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + most, "right")) - 1)
            part = t.slice(starts[a], starts[b] - starts[a]).combine_chunks()
            masks = decide({c: part.column(c).combine_chunks() if isinstance(part.column(c), pa.ChunkedArray) else part.column(c) for c in part.column_names})
            yield pa.RecordBatch.from_arrays([part.column("mini").combine_chunks(), part.column("dig").combine_chunks(), pa.array([np.packbits(m).tobytes() for m in masks], pa.binary())], names=["mini", "dig", "mask"])
            a = b

    return rows.repartition("mini").sortWithinPartitions("mini", "dig").mapInArrow(run, "mini long, dig long, mask binary")


def divided(rows: DataFrame, kind: Kind, decide: Callable, keep_first: bool, hot: int, anchor: int) -> DataFrame:
    """(mini, dig, mask) as by_bucket gives, for buckets of any size: their strings are cut by minimisers of `anchor` units into buckets of their own."""
    finer = dataclasses.replace(kind, anchor=anchor)

    def cut(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part, out = batch.slice(a, 500), []
                for k, p in enumerate(part.column("packed").to_pylist()):
                    units = kind.unpack(p)
                    h = kind.hashes(units)
                    mini, start, size, g = runs(mixed(h + np.uint64(anchor)), finer)
                    twice = recurring(mini, start, size, g, finer) if len(mini) else start.astype(bool)
                    packed = [kind.join(units, i, j) for i, j in zip(start.tolist(), (start + size + kind.window - 1).tolist())]
                    out += [(k, m, xxhash.xxh3_64_intdigest(x), i, n, t, x) for m, i, n, t, x in zip(mini.view(np.int64).tolist(), start.tolist(), size.tolist(), twice.tolist(), packed)]
                own, mini, dig, offset, n, twice, packed = zip(*out) if out else [()] * 7
                at = pa.array(own, pa.int64())
                cols = [part.column(c).take(at) for c in ("mini", "dig", "n", "count", "fdid", "frid")]
                place = pc.add(part.column("fstart").take(at), pa.array(offset, pa.int32()))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(mini, pa.int64()), pa.array(np.array(dig, np.uint64).view(np.int64)), place, pa.array(offset, pa.int32()), pa.array(n, pa.int32()), pa.array(twice, pa.bool_()), pa.array(packed, pa.binary())], names=names)

    names = ["omini", "odig", "on", "count", "fdid", "frid", "sub", "dig", "fstart", "offset", "n", "twice", "packed"]
    schema = "omini long, odig long, on int, count long, fdid long, frid long, sub long, dig long, fstart int, offset int, n int, twice boolean, packed binary"
    once = rows.dropDuplicates(["mini", "dig"]).select("mini", "dig", "n", "count", "fdid", "frid", "fstart", "packed")
    # Two of the old buckets never share a new one.
    pieces = stored(once.mapInArrow(cut, schema).withColumn("mini", F.xxhash64("omini", "sub")), "pieces")
    first = F.min(F.struct("fdid", "frid", "fstart", "packed")).alias("f")
    distinct = stored(pieces.groupBy("mini", "dig").agg(F.sum("count").alias("count"), first, F.max("n").alias("n"), F.max("twice").alias("twice")), "distinct-pieces")
    sizes = distinct.groupBy("mini").agg(F.count("*").alias("strings"))
    flat = stored(distinct.select("mini", "dig", "count", "f.*", "n", "twice").join(sizes, "mini"), "piece-strings")
    discard(distinct)
    cold, large = flat.where(F.col("strings") <= hot), flat.where(F.col("strings") > hot)
    decided = by_bucket(cold, decide)
    if anchor < kind.window and not large.isEmpty():
        decided = decided.unionByName(divided(large, kind, decide, keep_first, hot, min(kind.window, 2 * anchor)))
    elif anchor >= kind.window:
        decided = by_bucket(flat, decide)
    masks = flat.select("mini", "dig", "count", "fdid", "frid", "fstart").withColumnsRenamed({"count": "total", "fdid": "d", "frid": "r", "fstart": "s"}).join(stored(decided, "piece-decisions"), ["mini", "dig"], "left")
    met = pieces.select("omini", "odig", "on", "mini", "dig", "fdid", "frid", "fstart", "offset", "n").join(masks, ["mini", "dig"])
    whole = ((F.col("fdid") != F.col("d")) | (F.col("frid") != F.col("r")) | (F.col("fstart") != F.col("s"))) if keep_first else F.col("mask").isNull() & (F.col("total") > 1)
    gone = met.where(whole | F.col("mask").isNotNull()).withColumn("mask", F.when(~whole, F.col("mask")))
    spans = gone.groupBy("omini", "odig").agg(F.first("on").alias("on"), F.collect_list(F.struct("offset", "n", "mask")).alias("spans"))

    def bits(batches):
        for batch in batches:
            masks = []
            for n, spans in zip(batch.column("on").to_pylist(), batch.column("spans").to_pylist()):
                m = np.zeros(n, bool)
                for x in spans:
                    m[x["offset"] : x["offset"] + x["n"]] |= True if x["mask"] is None else np.unpackbits(np.frombuffer(x["mask"], np.uint8), count=x["n"]).astype(bool)
                masks.append(np.packbits(m).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("omini"), batch.column("odig"), pa.array(masks, pa.binary())], names=["mini", "dig", "mask"])

    return spans.mapInArrow(bits, "mini long, dig long, mask binary")


def remove(docs: DataFrame, kind: Kind, decide: Callable, keep_first: bool, finish: Callable, schema: str, names: list[str], hot: int = HOT) -> DataFrame:
    """The whole traffic. finish(text, units, removed): a row's values after doc_id; removed: a mask of units, or None for none.

    keep_first: a string's mask holds for its first occurrence and the others go as a whole; else it holds for all of them.
    """
    spark = docs.sparkSession
    rows_ = keyed(docs)
    # Rows that occur more than once stand as one, with their number; the others are told by a bit table.
    table = bit_table(rows_.groupBy("rid").count().where("count > 1"), "rid")
    twins = spark.sparkContext.broadcast(table) if table.any() else None  # without equal rows, no plan has a part for them
    single = rows_.withColumn("times", F.lit(1).cast("long"))
    if twins is not None:
        alike = marked(rows_, twins, True).groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("did").alias("did"), F.first("text").alias("text"), F.count("*").alias("times"))
        alike = stored(alike.select("doc_id", "did", "rid", "text", "times"), "equal-rows")

    def having(bits, yes: bool = True) -> DataFrame:
        """All rows, once each, of which the bit is set, or isn't."""
        own = marked(rows_, bits, yes, also=twins).withColumn("times", F.lit(1).cast("long"))
        return own if twins is None else own.unionByName(marked(alike, bits, yes))

    pairs = minimisers(single, kind, not keep_first, twins)
    pairs = stored(pairs if twins is None else pairs.unionByName(minimisers(alike, kind, not keep_first)), "minimisers")
    repeated = stored(pairs.groupBy("mini").count().where("count > 1").select("mini"), "repeated-minimisers")
    touched = stored(pairs.join(repeated, "mini").groupBy("rid").agg(F.collect_set("mini").alias("minis")), "minimisers-by-document")
    discard(pairs, repeated)
    release(spark)
    bits = spark.sparkContext.broadcast(bit_table(touched, "rid"))
    strings = stored(occurrences(having(bits), touched, kind), "strings")
    discard(touched)
    release(spark)
    first = F.min(F.struct("did", "rid", "start")).alias("first")
    counted = strings.groupBy("mini", "dig").agg(F.sum("times").alias("count"), first, F.max("n").alias("n"), F.max("twice").alias("twice"))
    distinct = stored(counted.select("mini", "dig", "count", F.col("first.did").alias("fdid"), F.col("first.rid").alias("frid"), F.col("first.start").alias("fstart"), "n", "twice"), "distinct-strings")
    buckets = stored(distinct.groupBy("mini").agg(F.count("*").alias("strings"), F.max("twice").alias("any")).where("strings > 1 or any").select("mini", "strings"), "buckets")
    release(spark)
    # Only the first occurrence of a string that needs a decision travels with its text.
    open_ = stored(distinct.join(buckets, "mini"), "open-strings")
    wanted = spark.sparkContext.broadcast(bit_table(open_, "frid"))
    flat = stored(packed_strings(having(wanted), open_, kind), "bucket-strings")
    discard(open_, buckets)
    release(spark)
    cold, large = flat.where(F.col("strings") <= hot), flat.where(F.col("strings") > hot)
    decided = by_bucket(cold, decide)
    if not large.isEmpty():
        decided = decided.unionByName(divided(large, kind, decide, keep_first, hot, min(kind.window, 2 * kind.anchor)))
    masks = stored(distinct.select("mini", "dig", "count", "frid", "fstart").join(stored(decided, "decisions"), ["mini", "dig"], "left"), "masks")
    discard(flat, distinct)
    release(spark)
    met = strings.select("mini", "dig", "rid", "start", "n").join(masks, ["mini", "dig"])
    # A null mask now stands for all windows; rows of which nothing goes are left out.
    if keep_first:
        whole = (F.col("rid") != F.col("frid")) | (F.col("start") != F.col("fstart"))
    else:
        whole = F.col("mask").isNull() & (F.col("count") > 1)
    gone = met.where(whole | F.col("mask").isNotNull()).withColumn("mask", F.when(~whole, F.col("mask")))
    spans = stored(gone.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "mask")).alias("spans")), "spans")
    discard(strings, masks)
    release(spark)
    bits = spark.sparkContext.broadcast(bit_table(spans, "rid"))

    def change_of(length, start, n, mask):
        """Adds 1 where a removed run of windows begins and takes 1 away after its last unit."""
        change = np.zeros(length + 1, np.int32)
        for a, k, m in zip(start.tolist(), n.tolist(), mask):
            if m is None:
                change[a] += 1
                change[a + k - 1 + kind.window] -= 1
            else:
                on = np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), count=k))
                if len(on):
                    jumps = np.flatnonzero(np.diff(on) > 1)
                    np.add.at(change, a + on[np.append(0, jumps + 1)], 1)
                    np.add.at(change, a + on[np.append(jumps, len(on) - 1)] + kind.window, -1)
        return change

    def untouched(batches):
        yield from rows(unset(batch, *(t for t in (bits, twins) if t is not None)) for batch in batches)

    def rows(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                yield made(batch.slice(a, 500))

    def made(batch):
        out, given = [], batch.column("spans") if "spans" in batch.schema.names else None
        for k, (doc_id, text) in enumerate(zip(batch.column("doc_id"), batch.column("text"))):
            text = text.as_py()
            units = kind.split(text)
            removed = None
            if given is not None and given[k].is_valid:
                found = given[k].values
                start, n = (found.field(c).to_numpy() for c in ("start", "n"))
                removed = np.cumsum(change_of(len(units), start, n, found.field("mask").to_pylist())[:-1]) > 0
            out.append((doc_id.as_py(), *finish(text, units, removed)))
        made = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)]
        return pa.RecordBatch.from_arrays([*made, batch.column("times")], names=[*names, "times"])

    types = [pa.string() if part.split()[1] == "string" else pa.int64() for part in schema.split(", ")]
    out = f"{schema}, times long"
    both = single.select("doc_id", "text", "times", "rid").mapInArrow(untouched, out).unionByName(having(bits).join(spans, "rid", "left").select("doc_id", "text", "times", "spans").mapInArrow(rows, out))
    if twins is None:
        return both.drop("times")
    both = both.unionByName(marked(alike, bits, False).select("doc_id", "text", "times").mapInArrow(rows, out))
    return both.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")
