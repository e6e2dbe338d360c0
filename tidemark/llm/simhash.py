"""SimHash near-duplicates: fingerprints, and links within a Hamming radius by tiled exact comparison.

Links are exact: fingerprints at `radius` differing bits agree on at least `KEPT` of `radius + KEPT` blocks of bits, so each
choice of KEPT blocks makes a table of groups that agree there. Within a group, distinct fingerprints are ordered by their number
of set bits and cut into tiles; two tiles are compared by numpy exclusive-or and bit counts, unless their bit counts differ
by more than the radius everywhere. A group yields a spanning forest of its links, never all pairs.

Scale: equal fingerprints count once, so copies never meet in a group. A group above HOT distinct fingerprints is dealt out by bit
count (and by a hash of the fingerprint where one bit count is still too large), each pair of tiles to a task of its own.

Blocks of bits only help at a small radius. For the removal of near-duplicates by similarity (five-word shingles, 0.8) fingerprints have
256 bits, folded from the distinct shingles, and the radius is the expected distance plus four deviations; there, groups share a least
shingle hash instead, and the sets of shingles of what the tiles let through are compared exactly. Only texts with equal sets are copies.

Defined results: a null or blank text has fingerprint 0, which links like any other; a null doc_id keeps its fingerprint and its
component is the smallest non-null doc_id there (null if there is none); repeated rows stay; an empty table gives no rows; other
columns of the input are ignored, whatever their names; every text is read whole.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, cut, discard, fresh_column, list_column, parts, stored
from tidemark.llm.repeats import bit_table, marked

KEPT = 2
HOT = 4096
TILE = 256
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `size` words, space-joined, repeats included; of all words where there are fewer; words end at ASCII white space."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, h = max(1, len(words) - size + 1), xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist())), np.uint64, n)


def fingerprint(text: str | None, size: int = 3) -> int:
    return folded(shingle_hashes(text, size))


def folded(h: np.ndarray) -> int:
    """A bit is set where over half of the hashes have it."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * np.add.reduce(bits, axis=0, dtype=np.int64) > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""

    def rows(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    blocks = radius + KEPT
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(part[k] for k in chosen) for chosen in itertools.combinations(range(blocks), KEPT)]


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32) <= radius


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets, as sorted arrays, have this Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common)


def _tiles(u: np.ndarray, side: np.ndarray, radius: int):
    """(start of rows, start of columns, which are within the radius) for the tiles of one group, ordered by bit count, that may hold links."""
    n, count = len(u), np.bitwise_count(u).sum(axis=1, dtype=np.int32)
    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            x, y = slice(a, a + TILE), slice(b, b + TILE)
            if count[b] - count[x][-1] > radius:
                break  # the tiles are in the order of bit counts
            near = _near(u[x][:, None], u[y][None, :], radius)
            if a == b:
                near = np.triu(near, 1)
            if (side[x] < 2).any():
                near &= (side[x][:, None] != side[y][None, :]) | (side[x][:, None] == 2)
            yield a, b, near


def _forest(node: np.ndarray, u: np.ndarray, side: np.ndarray, radius: int, sure) -> list[tuple[int, int]]:
    """Links of one group as a spanning forest. side: 0 or 1 where only links between both sides are asked for, else 2."""
    label, out = np.arange(len(node)), []
    for a, b, near in _tiles(u, side, radius):
        for i in np.flatnonzero(near.any(axis=1)):
            js = b + np.flatnonzero(near[i])
            js = js[label[js] != label[a + i]]  # links within what is linked are not needed
            for j in js:
                if label[j] != label[a + i] and sure(a + i, j):
                    out.append((int(node[a + i]), int(node[j])))
                    label[label == label[j]] = label[a + i]
    return out


def _partnered(u: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of one group have any other within the radius."""
    found = np.zeros(len(u), bool)
    for a, b, near in _tiles(u, side, radius):
        found[a : a + TILE] |= near.any(axis=1)
        found[b : b + TILE] |= near.any(axis=0)
    return found


def _by_group(batches, made):
    """`made` of the columns of whole groups and of the groups' edges. Rows come ordered by group, the first column; the last group of a batch waits for the next."""

    def lists(column):
        out, values, at = np.empty(len(column), object), column.values.to_numpy(), column.offsets.to_numpy()
        for k in range(len(column)):
            out[k] = values[at[k] : at[k + 1]]
        return out

    def whole(columns):
        key = columns[0]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]).tolist()
        return made(columns, list(itertools.pairwise(edges)))

    held = None
    for batch in batches:
        now = [lists(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        other = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else held[0]
        first = other[-1] + 1 if len(other) else 0
        if first:
            yield whole([x[:first] for x in held])
            held = [x[first:] for x in held]
    if held is not None and len(held[0]):
        yield whole(held)


def _compare(batches, radius: int, least: float | None = None):
    """Links of rows (key, side, node, fingerprint words).

    least: a last column has the shingles' hashes, and a link is kept if their sets are as similar as that.
    """

    def links(columns, groups):
        _, side, node, *fp = columns
        sets = fp.pop() if least else None
        u = np.stack(fp, 1).view(np.uint64)
        found: list[tuple[int, int]] = []
        for a, b in groups:
            sure = (lambda i, j, a=a: similar(sets[a + i], sets[a + j], least)) if least else (lambda i, j: True)
            found += _forest(node[a:b], u[a:b], side[a:b], radius, sure)
        found = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return _by_group(batches, links)


def _survive(batches, names: list[str], radius: int):
    """Those of the rows (key, side, node, text_hash, fingerprint words) that have another of their group within the radius."""

    def survivors(columns, groups):
        u = np.stack(columns[4:], 1).view(np.uint64)
        stay = np.concatenate([_partnered(u[a:b], columns[1][a:b], radius) for a, b in groups])
        return pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in columns], names=names)

    return _by_group(batches, survivors)


def _ordered(dealt: DataFrame, words: list[str], *other: str) -> DataFrame:
    bits = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0]))
    return dealt.select("key", F.col("side").cast("int").alias("side"), "node", *other).repartition("key").sortWithinPartitions("key", bits, "node")


def _compared(dealt: DataFrame, words: list[str], radius: int, least: float | None = None) -> DataFrame:
    ordered = _ordered(dealt, words, *words, *(["shingles"] if least else []))
    return ordered.mapInArrow(functools.partial(_compare, radius=radius, least=least), "a long, b long")


def _survivors(dealt: DataFrame, words: list[str], radius: int) -> DataFrame:
    names = ["key", "side", "node", "text_hash", *words]
    schema = ", ".join(f"{n} {'int' if n == 'side' else 'long'}" for n in names)
    return _ordered(dealt, words, *names[3:]).mapInArrow(functools.partial(_survive, names=names, radius=radius), schema)


def links(fps: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b): a spanning forest, in each group, of the links between the distinct fingerprints `fp`."""
    each = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(masks(radius))))
    grouped = fps.select("fp", F.explode(each).alias("key"))
    sizes = grouped.groupBy("key").count().where("count > 1")
    grouped = grouped.join(sizes, "key").withColumn("bits", F.bit_count("fp"))
    small = grouped.where(F.col("count") <= hot).select("key", F.lit(2).alias("side"), "fp")
    # A hot group becomes tiles of one bit count and one slice each; a tile meets itself and those within the radius.
    slices = F.ceil(F.col("count") / F.lit(8 * hot)).cast("int")
    tile = grouped.where(F.col("count") > hot).withColumn("slices", slices).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    other = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("d")
    met = tile.select("*", other).select("*", F.explode(F.expr("sequence(0, slices - 1)")).alias("o"))
    # The pair's name is the same from both ends; `side` tells which end a row is.
    here, there = F.struct("bits", F.col("own").alias("s")), F.struct((F.col("bits") + F.col("d")).alias("bits"), F.col("o").alias("s"))
    large = met.select(F.xxhash64("key", F.least(here, there), F.greatest(here, there)).alias("key"), F.when(here == there, 2).when(here < there, 0).otherwise(1).alias("side"), "fp")
    return _compared(small.unionByName(large).withColumn("node", F.col("fp")), ["fp"], radius)


def components(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of (doc_id, fp), which should be cheap to read twice: the smallest doc_id that links lead to."""
    owners = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    owners = cut(owners)
    linked = connected_components(links(owners.select("fp"), radius).distinct())
    joined = owners.join(linked, owners.fp == linked.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(joined.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs(doc_id, text)."""
    fps = cut(fingerprints(docs, size))
    return components(fps, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


WIDE = (42, 43, 44, 45)


def wide_radius(similarity: float) -> int:
    """Bits in which wide fingerprints of texts with this Jaccard similarity of shingles are expected to differ, and four deviations more."""
    bits = 64 * len(WIDE)
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def wide_fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, node, w0.., keys): by each seed in WIDE, a fingerprint of 64 bits and the least hash of the distinct shingles; node: a hash of their set."""

    def one(text):
        hashes = [np.unique(shingle_hashes(text, size, seed)) for seed in WIDE]
        return [folded(h) for h in hashes], [int(h[0].view(np.int64)) for h in hashes if len(h)], xxhash.xxh3_64_intdigest(hashes[0].tobytes())

    def rows(batches):
        for batch in batches:
            made = [one(t.as_py()) for t in batch.column(2)]
            words = np.array([w for w, _, _ in made], np.uint64).reshape(-1, len(WIDE))
            node = [n for _, _, n in made]
            cols = [pa.array(np.array(node, np.uint64).view(np.int64)), *(pa.array(words[:, k].copy().view(np.int64)) for k in range(len(WIDE))), pa.array([k for _, k, _ in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "text_hash", "node", *names, "keys"])

    names = [f"w{k}" for k in range(len(WIDE))]
    schema = f"doc_id long, text_hash long, node long, {', '.join(f'{n} long' for n in names)}, keys array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(rows, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of wanted(node, text_hash): sorted distinct hashes, from the documents with such a text.

    Texts that no one asks for are kept out by a bit table of fixed size; the join decides.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "text_hash"))

    def rows(batches):
        for part in parts(batches):
            sets = list_column([np.unique(shingle_hashes(t.as_py(), size)) for t in part.column(1)])
            yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["node", "shingles"])

    texts = marked(docs.select(F.xxhash64("text").alias("rid"), "text"), bits, True).groupBy("rid").agg(F.first("text").alias("text"))
    return wanted.join(texts, wanted.text_hash == texts.rid).select("node", "text").mapInArrow(rows, "node long, shingles array<long>")


def wide_links(docs: DataFrame, nodes: DataFrame, size: int, similarity: float, hot: int = HOT) -> DataFrame:
    """Links between nodes(node, text_hash, w0.., keys) at a large radius, where no block of bits need agree: groups share the least shingle hash of a seed.

    Texts with a Jaccard similarity of 0.8 share one of four least hashes but for 0.2 ** 4 of such pairs. The tiles are compared first by
    fingerprints alone, six numbers a row. Only rows with another one in reach, in that pair of slices, are compared again with their sets of
    shingles; so no set is made or sent for the rest, however large their group is, and pairs are never listed.
    """
    words = [f"w{k}" for k in range(len(WIDE))]
    grouped = nodes.select("node", "text_hash", *words, F.posexplode("keys").alias("k", "v")).select("node", "text_hash", *words, F.xxhash64("k", "v").alias("key"))
    sizes = grouped.groupBy("key").count().where("count > 1").withColumn("slices", F.ceil(F.col("count") / F.lit(hot)).cast("int"))
    sliced = grouped.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    met = sliced.select("*", F.explode(F.expr("sequence(0, slices - 1)")).alias("o"))
    pair, side = F.xxhash64("key", F.least("own", "o"), F.greatest("own", "o")), F.when(F.col("own") == F.col("o"), 2).when(F.col("own") < F.col("o"), 0).otherwise(1)
    dealt = met.select(pair.alias("key"), side.alias("side"), "node", "text_hash", *words)
    near = stored(_survivors(dealt, words, wide_radius(similarity)), "near-fingerprints")
    sets = shingle_sets(docs, near.select("node", "text_hash").distinct(), size)
    linked = cut(_compared(near.join(sets, "node"), words, wide_radius(similarity), similarity).distinct())
    discard(near)
    return linked


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each group the row with the smallest doc_id stays (nulls last).

    Of rows with that doc_id and an equal text one stays, by the smallest hash of the other columns.
    """
    prints = stored(wide_fingerprints(docs, size), "wide-fingerprints")
    words = [f"w{k}" for k in range(len(WIDE))]
    nodes = prints.groupBy("node", *words).agg(F.first("keys").alias("keys"), F.min("text_hash").alias("text_hash"))
    linked = connected_components(wide_links(docs, nodes, size, similarity))
    rooted = prints.join(linked, "node", "left").select(F.coalesce("root", "node").alias("root"), "doc_id", "text_hash")
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("m")).select("m.doc_id", "m.text_hash")
    # Aliases keep columns of docs apart that have the same names.
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.text_hash"))
    out = docs.alias("d").join(kept.alias("k"), same, "left_semi").select("d.*")
    repeated = prints.groupBy("doc_id", "text_hash").count().where("count > 1")
    if repeated.isEmpty():
        return out
    w = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))))))
    rank = fresh_column(docs)
    return out.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)
