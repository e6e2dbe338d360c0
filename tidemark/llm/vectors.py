"""Near-duplicate embeddings by an exact metric range join.

Angles are a metric on directions, and a cosine of at least c means an angle of at most e = arccos(c). Pivots partition the vectors: each
belongs to the pivot with the smallest angle. A cell's vectors within e / 2 of their pivot are its core, the others its shell. Any two
vectors of a core are linked, by the triangle inequality, so cores are counted and never compared with themselves. What may be linked
across cells visits the other cell, as the inequality allows:

* a vector visits a core if its angle to the pivot is at most e more than the core's radius;
* it visits a shell if its angle to the pivot is between the shell's least and largest radius, e allowed on both sides, and it stands
  within e of the great circle that divides its own pivot from the other (both vectors of a pair would).

Of two units only one is visited: cores by shells, and of two of a kind one by the other, in turns. Units are then joined independently: a
task holds a unit's members and streams the visitors past them in batches, comparing by cosines in double precision. A unit answers with the
number of links of each of its vectors and with the least vector of its linked groups, never with pairs.

Scale: equal vectors are one node with a count. Pivots are a sample of at most PIVOTS vectors of a length, by hash, thinned so that none is
within e / 2 of another; they only divide the work, all vectors are indexed. Cells of over MEMBERS vectors are dealt to units of about that
size, so a dense group or a hot vector isn't one task's work, and a core is linear in its size but for its visitors. Vectors travel as they
came. Where directions are spread evenly in many dimensions, no pivot can keep cells apart, and the number of visits is that of a join of
blocks of MEMBERS vectors: quadratic, but never held at once.

Defined results: vectors that are null, empty, zero or hold nulls or non-finite numbers link with nothing, nor do vectors of different
lengths; equal rows are vectors of their own and linked; a null vec_id is no component's name unless all of its ids are null, and is never
kept; of repeated vec_ids all rows are answered; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import connected_components, discard, parts, stored

PIVOTS, MEMBERS = 512, 2048
#: Room for the rounding of angles (radians); what is let through is compared by cosines.
SLACK = 1e-6


def directions(batch_column) -> np.ndarray:
    """Unit vectors in double precision; all of the column have the same length."""
    values = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch_column), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # else squares of extreme numbers overflow
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[k] and b[k]; labels: the least index of each element's group, changed in place."""
    while len(a):
        x, y = labels[a], labels[b]
        off = x != y
        if not off.any():
            return
        pairs = np.unique(np.stack([np.minimum(x[off], y[off]), np.maximum(x[off], y[off])]), axis=1)
        np.minimum.at(labels, pairs[1], pairs[0])
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def nodes_of(vectors: DataFrame) -> DataFrame:
    """node, first (the least vec_id), count, dim and embedding of every distinct vector that may be linked."""
    e = F.col("embedding")
    usable = vectors.where(e.isNotNull() & (F.size(e) > 0)).where(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0))
    once = usable.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("count"))
    return stored(once.select(F.monotonically_increasing_id().alias("node"), "first", "count", F.size("embedding").alias("dim"), "embedding"), "vectors")


def pivots_of(nodes: DataFrame, threshold: float, most: int, members: int) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """Pivots by the vectors' length: about one for half of `members` vectors, a hundredth to `most`; and the number of vectors."""
    sizes = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}
    if not sizes:
        return {}, sizes
    wanted = {d: min(most, max(1, -(-2 * n // members))) for d, n in sizes.items()}
    share = F.create_map(*(F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, 2 * wanted[d] / n + 30 / n))))
    rank = F.xxhash64("embedding")
    sample = nodes.where(F.pmod(rank, F.lit(1 << 30)) < share[F.col("dim")] * (1 << 30)).select("dim", "embedding", rank.alias("h")).toArrow().sort_by("h")
    out = {}
    for d in sizes:
        own = directions(sample.filter(pa.compute.equal(sample["dim"], d)).column("embedding").combine_chunks()) if sample.num_rows else np.empty((0, d))
        kept: list[int] = []
        for k in range(len(own)):
            if len(kept) < wanted[d] and (not kept or (own[kept] @ own[k]).max() < math.cos(math.acos(threshold) / 2)):
                kept.append(k)
        out[d] = own[kept] if kept else np.eye(1, d)
    return out, sizes


def homes(nodes: DataFrame, pivots, threshold: float) -> DataFrame:
    """The nodes with cell, core and radius. They are stored once, as rounding may differ from batch to batch."""
    inner = math.acos(threshold) / 2 - SLACK

    def rows(batches):
        for batch in parts(batches, 2000):
            for part in by_length(batch):
                unit = directions(part.column("embedding"))
                near = unit @ pivots.value[part.column("dim")[0].as_py()].T
                cell = near.argmax(axis=1)
                radius = angles(near[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(radius <= inner), pa.array(radius)], names=[*part.schema.names, "cell", "core", "radius"])

    return nodes.mapInArrow(rows, T.StructType([*nodes.schema, T.StructField("cell", T.IntegerType()), T.StructField("core", T.BooleanType()), T.StructField("radius", T.DoubleType())]))


def by_length(batch):
    """A batch's rows in parts whose vectors have the same length."""
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for d in np.unique(dims):
        yield batch.filter(pa.array(dims == d)) if len(dims) and (dims != d).any() else batch


class Cells:
    """What a task must know of the cells of one vector length: pivots, and by core and shell the radii and the number of units."""

    def __init__(self, pivots: np.ndarray, stats: list, threshold: float, members: int):
        k = len(pivots)
        self.pivots, self.reach = pivots, math.acos(threshold) + SLACK
        self.low, self.high, self.units = np.full((2, k), np.inf), np.full((2, k), -np.inf), np.zeros((2, k), np.int64)
        for r in stats:
            side = 0 if r["core"] else 1
            self.low[side, r["cell"]], self.high[side, r["cell"]], self.units[side, r["cell"]] = r["low"], r["high"], -(-r["n"] // members)
        gaps = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
        #: How much smaller the cosine to another pivot may be for a vector within reach of the dividing circle.
        self.margin = math.sin(min(math.pi / 2, self.reach)) * gaps + SLACK
        a = np.arange(k)
        self.turn = np.where((a[:, None] + a) % 2 == 1, a[:, None] < a, a[:, None] > a)

    def visits(self, near: np.ndarray, cell: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which cores and which shells (rows by pivots) each vector visits, but for its own cell's shell; near: cosines to the pivots."""
        theta, e = angles(near), self.reach
        own = np.zeros_like(near, bool)
        own[np.arange(len(cell)), cell] = True
        cores = (theta <= self.high[0] + e) & np.where(core[:, None], self.turn[cell] & ~own, True)
        beside = near[np.arange(len(cell)), cell][:, None] - near <= self.margin[cell]
        shells = (theta <= self.high[1] + e) & (theta >= self.low[1] - e) & beside & self.turn[cell] & ~own & ~core[:, None]
        return cores, shells


def dealt(nodes: DataFrame, cells, seed: int = 7) -> DataFrame:
    """unit, visitor, node, count, dim and embedding: every vector as a member of its unit and as a visitor of others."""

    def rows(batches):
        for batch in parts(batches, 500):
            for part in by_length(batch):
                d = part.column("dim")[0].as_py()
                known = cells.value[d]
                near = directions(part.column("embedding")) @ known.pivots.T
                cell, core = part.column("cell").to_numpy(), part.column("core").to_numpy(zero_copy_only=False)
                n = part.column("node").to_numpy()
                mixed = (n.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                side = np.where(core, 0, 1)
                mine = (mixed % known.units[side, cell].astype(np.uint64)).astype(np.int64)
                row, at, visitor = [np.arange(len(n))], [unit_id(d, side, cell, mine)], [np.zeros(len(n), bool)]
                for kind, which in enumerate(known.visits(near, cell, core)):
                    r, c = np.nonzero(which & (known.units[kind] > 0))
                    for u in range(int(known.units[kind].max(initial=0))):
                        has = known.units[kind][c] > u
                        row.append(r[has])
                        at.append(unit_id(d, np.full(has.sum(), kind), c[has], np.full(has.sum(), u)))
                        visitor.append(np.ones(has.sum(), bool))
                # Units of the same shell visit each other in turns too.
                shell = np.flatnonzero(side == 1)
                for u in range(int(known.units[1].max(initial=0))):
                    r = shell[(known.units[1][cell[shell]] > u) & np.where((mine[shell] + u) % 2 == 1, mine[shell] < u, mine[shell] > u)]
                    row.append(r)
                    at.append(unit_id(d, np.ones(len(r), np.int64), cell[r], np.full(len(r), u)))
                    visitor.append(np.ones(len(r), bool))
                row, at, visitor = np.concatenate(row), np.concatenate(at), np.concatenate(visitor)
                for a in range(0, len(row), 4000):
                    take = pa.array(row[a : a + 4000])
                    yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 4000]), pa.array(visitor[a : a + 4000]), *(part.column(c).take(take) for c in ("node", "count", "dim", "embedding"))], names=["unit", "visitor", "node", "count", "dim", "embedding"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    return nodes.select("node", "count", "dim", "embedding", "cell", "core").mapInArrow(rows, f"unit long, visitor boolean, node long, count long, dim int, embedding {kind}")


def unit_id(dim: int, side: np.ndarray, cell: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """A number for each unit: length, cell (below 2 ** 12), core or shell, and place in the cell."""
    return (np.int64(dim) << 40) | (cell.astype(np.int64) << 28) | (side.astype(np.int64) << 27) | unit


def compared(rows: DataFrame, threshold: float) -> DataFrame:
    """node, links and least: what each vector of a unit is linked with there, its links by the counts of the others, and a node of its linked group."""

    def run(batches):
        held, at, members = [], None, None
        for batch in batches:
            for part in parts([batch], 1000):
                units, visitor = part.column("unit").to_numpy(), part.column("visitor").to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero((np.diff(units) != 0) | (np.diff(visitor.astype(np.int8)) != 0)) + 1).tolist(), len(units)]
                for a, b in zip(edges, edges[1:]):
                    if a == b:
                        continue
                    piece = part.slice(a, b - a)
                    if units[a] != at:
                        yield from ended(members, held)
                        held, at, members = [], int(units[a]), None
                    if not visitor[a]:
                        held.append(piece)
                        continue
                    if members is None:
                        members = Members(held, at, threshold)
                        held = []
                    yield from members.meet(piece)
        yield from ended(members if members is not None or not held else Members(held, at, threshold), [])

    def ended(members, held):
        if members is None and held:
            members = Members(held, int(held[0].column("unit")[0].as_py()), threshold)
        if members is not None:
            yield from members.answer()

    return rows.repartition("unit").sortWithinPartitions("unit", "visitor").mapInArrow(run, "node long, links long, least long")


class Members:
    """The members of a unit, with what they are linked with so far."""

    def __init__(self, pieces: list, unit: int, threshold: float):
        self.node, self.count = (np.concatenate([p.column(c).to_numpy() for p in pieces]) for c in ("node", "count"))
        self.unit = np.concatenate([directions(p.column("embedding")) for p in pieces])
        self.threshold, n = threshold, len(self.node)
        self.links, self.labels = np.zeros(n, np.int64), np.arange(n)
        if unit >> 27 & 1:
            for a in range(0, n, 256):
                i, j = np.nonzero(self.unit[a : a + 256] @ self.unit[a:].T >= threshold)
                i, j = i + a, j + a
                i, j = i[i < j], j[i < j]
                np.add.at(self.links, i, self.count[j])
                np.add.at(self.links, j, self.count[i])
                merged(self.labels, i, j)
        else:
            self.labels[:] = 0  # a core is one group; its links are counted apart

    def meet(self, piece):
        """Compare visitors; gives what is known of those with links."""
        node, count = piece.column("node").to_numpy(), piece.column("count").to_numpy()
        i, j = np.nonzero(directions(piece.column("embedding")) @ self.unit.T >= self.threshold)
        if len(i):
            links = np.zeros(len(node), np.int64)
            np.add.at(links, i, self.count[j])
            np.add.at(self.links, j, count[i])
            # A visitor's neighbours are one group from now on.
            first = np.flatnonzero(np.diff(i, prepend=-1))
            merged(self.labels, j, np.repeat(j[first], np.diff(np.append(first, len(i)))))
            yield answer(node[i[first]], links[i[first]], self.node[j[first]])

    def answer(self):
        on = self.links > 0
        if on.any():
            yield answer(self.node[on], self.links[on], self.node[self.labels[on]])


def answer(node, links, least):
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(least)], names=["node", "links", "least"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, most: int = PIVOTS, members: int = MEMBERS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    nodes = nodes_of(rows)
    pivots, sizes = pivots_of(nodes, threshold, most, members)
    placed = stored(homes(nodes, spark.sparkContext.broadcast(pivots), threshold), "homes")
    discard(nodes)
    stats = placed.groupBy("dim", "cell", "core").agg(F.count("*").alias("n"), F.sum("count").alias("total"), F.min("node").alias("least"), F.min("radius").alias("low"), F.max("radius").alias("high"))
    known = stats.collect()  # at most two rows a pivot
    cells = spark.sparkContext.broadcast({d: Cells(pivots[d], [r for r in known if r["dim"] == d], threshold, members) for d in sizes})
    found = compared(dealt(placed, cells), threshold)
    # All of a core are linked.
    cores = placed.where("core").join(stats.where("core").select("dim", "cell", "total", "least"), ["dim", "cell"]).select("node", (F.col("total") - F.col("count")).alias("links"), "least")
    found = stored(found.unionByName(cores), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    known_nodes = stored(placed.select("node", "first", "count", "embedding").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "linked")
    discard(placed, found)
    least = known_nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    results = known_nodes.join(least, "root").select("embedding", (F.col("count") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("_known"))
    out = rows.join(results, "embedding", "left")
    component = F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
