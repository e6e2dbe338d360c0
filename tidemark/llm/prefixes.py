"""A trie of conversations by smallest-member ownership.

Every distinct sequence of a conversation's first d turns is a node; its members are the conversations that start with it. The smallest
member owns a node. As a child's members are among its parent's, what a conversation owns is a suffix of its path, and every node is owned
once. So nothing has to be summed over a subtree as such: an occurrence (conversation, depth) adds to its own node the tokens of the rest
of its path, less those of the owned part of that rest, whether the next node is owned (a child) and whether the path ends in an owned node
without children (a leaf). One group-by over prefixes then gives all figures of a node.

A prefix is known by its depth and two running sums of 64-bit hashes of (position, role, text), so it needs no list of turns.

Scale: turns and occurrences are a few numbers each after their hashes are taken; texts are shuffled once, to be put in order. Running sums within
a conversation are taken in blocks of BLOCK turns, with the blocks' totals carried on, so a very long conversation is many tasks' work. The
windows that mark owned nodes are per node and slice of the conversations first, then over the slices' smallest members alone, so the root
and a first turn that a third of all conversations share are split. Conversation ids that end in a node are joined in chunks of CHUNK ids;
the digest, which is sequential by definition, is taken over a node's chunks as they stream by in order, without holding them.

Defined results: a null conv_id belongs to no conversation and is left out; null turns come first; equal turns are ordered by role and
text; repeated rows are turns of their own; null roles and texts are empty; an empty table gives no rows; other columns are ignored; very
long texts count by their code points.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored

BLOCK, CHUNK, SLICES = 4096, 128, 64
NODE = ["depth", "k1", "k2"]


def running(rows: DataFrame, key: str, order: list[Column], block: Column, sums: dict[str, Column]) -> DataFrame:
    """rows with running sums by key, in an order that `block` follows: within blocks first, then the totals of the blocks before."""
    held = rows.withColumn("_block", block)
    local = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(F.asc_nulls_first("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(key, "_block").agg(*(F.sum(x).alias(f"_{n}") for n, x in sums.items()))
    carried = totals.select(key, F.coalesce("_block", F.lit(-(1 << 62))).alias("_at"), *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    own = held.select("*", *(F.sum(x).over(local).alias(n) for n, x in sums.items())).withColumn("_at", F.coalesce("_block", F.lit(-(1 << 62))))
    joined = own.join(carried, [key, "_at"])
    return joined.withColumns({n: F.expr(f"{n} + _{n}") for n in sums}).drop("_at", "_block", *(f"_{n}" for n in sums))


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text and tokens (code points) of every turn."""
    empty = F.lit("")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    return running(rows, "conv_id", order, F.floor(F.col("turn") / BLOCK), {"pos": F.lit(1).cast("long")}).drop("turn")


def forked(turns: DataFrame, share: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that start as another one does: (conv_id), and their turns (conv_id, depth, role, text).

    The first h turns are those of conversation c - c % share, with h the CRC-32 of the decimal c modulo `most`; then come c's own turns
    after its first h. A shared start has under `most` turns, each copied to under `share` conversations.
    """
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    convs = sizes.select("conv_id", (c - c % share).alias("base"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_size", F.lit(0))))
    heads = turns.where((c % share == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    started = convs.join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "role", "text")
    own = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("depth"), "role", "text")
    return sizes.select("conv_id"), started.unionByName(own)


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of convs(conv_id) with turns(conv_id, depth from 1 without gaps, role, text); see the module."""
    hashed = turns.select("conv_id", "depth", F.length("text").cast("long").alias("tokens"), *(F.xxhash64(F.lit(seed), "depth", "role", "text").alias(f"h{seed}") for seed in (1, 2)))
    hashed = stored(hashed.union(convs.select("conv_id", F.lit(0).cast("long"), *[F.lit(0).cast("long")] * 3)), "turns")
    block = F.floor(F.col("depth") / BLOCK)
    # Sums of hashes wrap around, as numbers of 64 bits do: halves are added apart and put together again.
    halves = {f"{part}{seed}": x for seed in (1, 2) for part, x in (("lo", F.col(f"h{seed}").bitwiseAND(F.lit(0xFFFFFFFF))), ("hi", F.shiftrightunsigned(f"h{seed}", 32)))}
    summed = running(hashed, "conv_id", [F.col("depth")], block, halves)
    key = lambda seed: F.shiftleft((F.col(f"hi{seed}") + F.shiftrightunsigned(f"lo{seed}", 32)).bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(F.col(f"lo{seed}").bitwiseAND(F.lit(0xFFFFFFFF)))
    paths = summed.select("conv_id", "depth", "tokens", key(1).alias("k1"), key(2).alias("k2"))
    lengths = hashed.groupBy("conv_id").agg(F.max("depth").alias("length"))
    paths = stored(paths.join(lengths, "conv_id"), "paths")
    discard(hashed)
    marked = stored(owned(paths), "owned")
    discard(paths)
    # The rest of each path: totals less what came before.
    mine = F.when(F.col("own"), F.col("tokens")).otherwise(0)
    totals = marked.groupBy("conv_id").agg(F.sum("tokens").alias("t_occ"), F.sum(mine).alias("t_own"), F.max(F.when((F.col("depth") == F.col("length")) & F.col("own") & F.col("childless"), 1).otherwise(0)).alias("leaf"), F.min(F.when(F.col("own"), F.col("depth"))).alias("from"))
    so_far = running(marked, "conv_id", [F.col("depth")], block, {"s_occ": F.col("tokens"), "s_own": mine}).join(totals, "conv_id")
    rest = (F.col("t_occ") - F.col("s_occ") + F.col("tokens")) - (F.col("t_own") - F.col("s_own") + mine)
    # What is owned is a suffix, so the next node is owned if it isn't before the first owned one.
    child = ((F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("from"))).cast("long")
    nodes = so_far.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.coalesce(child, F.lit(0))).alias("n_children"), F.sum("leaf").cast("long").alias("n_leaves"), F.sum(rest).alias("saved_tokens"))
    nodes = stored(nodes, "nodes")
    # An owner's path holds the parent's key.
    above = marked.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.join(above, ["conv_id", "depth"], "left").join(parents, ["depth", "p1", "p2"], "left")
    ends = digests(marked.where("depth = length"))
    out = named.join(ends, NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def owned(paths: DataFrame, slices: int = SLICES) -> DataFrame:
    """paths with own (the conversation is the node's smallest member) and, for owners, childless (no member goes on)."""
    part = Window.partitionBy(*NODE, "_slice")
    each = paths.withColumn("_slice", F.pmod(F.xxhash64("conv_id"), F.lit(slices))).select("*", F.min("conv_id").over(part).alias("_least"), F.max("length").over(part).alias("_longest"))
    each = stored(each, "slices")
    whole = Window.partitionBy(*NODE)
    heads = each.where("conv_id = _least").select("*", (F.min("conv_id").over(whole) == F.col("conv_id")).alias("own"), (F.max("_longest").over(whole) == F.col("depth")).alias("childless"))
    rest = each.where("conv_id <> _least").select("*", F.lit(False).alias("own"), F.lit(False).alias("childless"))
    return heads.unionByName(rest).drop("_slice", "_least", "_longest")


def digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2 and ends_sha256: the digest of the ascending conv_ids of ends(depth, k1, k2, conv_id)."""
    chunks = ends.groupBy(*NODE, F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def rows(batches):
        at, digest = None, None
        for batch in batches:
            done = []
            for key, ids in zip(zip(*(batch.column(c).to_pylist() for c in NODE)), batch.column("ids")):
                if key != at:
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
            yield made(done)
        if at is not None:
            yield made([(*at, digest.hexdigest())])

    def made(done):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [()] * 4, kinds)], names=[*NODE, "ends_sha256"])

    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").mapInArrow(rows, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, share: int = 100, most: int = 6) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text) after `forked`."""
    turns = stored(placed(conversations), "placed")
    return trie(*forked(turns, share, most))
