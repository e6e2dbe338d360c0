"""Second-order boosted trees for a binary outcome, grown from gradient histograms.

A feature's values are dealt to quantile bins; a missing value has a bin of its own. For each node under consideration, the sums of
gradients and Hessians of the logistic loss are aggregated by (node, feature, bin): within a task first, in arrays, then by a grouped
aggregate. Running sums over the bins give both sides of every split, once with the missing values on the right and once on the left, and
the split with the largest gain

    GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2)

is taken. Depth-wise growth splits every node of a level; leaf-wise growth splits the leaf with the largest gain until there are enough
leaves (nodes that may be wanted are looked at together, a level a job). Leaves hold -G / (H + l2), shrunk by the rate.

Models of several groups (folds, say) are grown side by side: a level is one job for all of them. The driver sees one row a node: its sums
and its best split. Rows stay where they are; the sums of the trees so far are written with them every KEEP trees.

Defined results: nulls and NaN are missing and go to the side that training found better, right where it made no difference; ties take the
first feature, then the lowest bin; a group with one class has no trees; groups without rows have no model and their rows no score.
"""

from __future__ import annotations

import dataclasses
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.files import discard, kept

MISSING = 255
KEEP = 16


@dataclasses.dataclass(frozen=True)
class Growth:
    """How trees are grown. depth-wise to `depth`, or leaf-wise to `leaves`; share and columns: of rows and features for each tree."""

    trees: int = 400
    rate: float = 0.03
    depth: int = 4
    leaves: int | None = None
    share: float = 0.8
    columns: float = 0.8
    l2: float = 5.0
    least_weight: float = 1.0
    least_rows: int = 1
    bins: int = 255
    seed: int = 17


DEPTH_WISE = Growth()
LEAF_WISE = Growth(depth=32, leaves=15, least_weight=1e-3, least_rows=100)

NODE = "g int, tree int, node int, feature string, threshold double, missing_left boolean, left int, right int, value double, cover double, rows long, gain double"


@dataclasses.dataclass
class Tree:
    """Nodes by number; children of n, where it is split, are in left and right. value: of the leaf that it is or was."""

    feature: list[int] = dataclasses.field(default_factory=list)
    bin: list[int] = dataclasses.field(default_factory=list)
    missing_left: list[bool] = dataclasses.field(default_factory=list)
    left: list[int] = dataclasses.field(default_factory=list)
    right: list[int] = dataclasses.field(default_factory=list)
    value: list[float] = dataclasses.field(default_factory=list)
    cover: list[float] = dataclasses.field(default_factory=list)
    rows: list[int] = dataclasses.field(default_factory=list)
    gain: list[float] = dataclasses.field(default_factory=list)

    def add(self, g: float, h: float, n: int, growth: Growth) -> int:
        for c, v in ((self.feature, -1), (self.bin, -1), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, -growth.rate * g / (h + growth.l2)), (self.cover, h), (self.rows, n), (self.gain, 0.0)):
            c.append(v)
        return len(self.left) - 1

    def split(self, n: int, s, growth: Growth) -> tuple[int, int]:
        self.feature[n], self.bin[n], self.missing_left[n], self.gain[n] = s["feature"], s["bin"], s["missing_left"], s["gain"]
        self.left[n] = self.add(s["gl"], s["hl"], s["cl"], growth)
        self.right[n] = self.add(s["g_all"] - s["gl"], s["h_all"] - s["hl"], s["c_all"] - s["cl"], growth)
        return self.left[n], self.right[n]

    def arrays(self):
        return np.array(self.feature), np.array(self.bin), np.array(self.missing_left), np.array(self.left), np.array(self.right), np.array(self.value)


def leaf_of(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """The leaf that each row of bins(rows by features) comes to."""
    feature, cut, missing_left, left, right, _ = tree
    at = np.zeros(len(bins), np.int64)
    inner = np.flatnonzero(left[at] >= 0)
    while len(inner):
        n = at[inner]
        b = bins[inner, feature[n]]
        at[inner] = np.where(np.where(b == MISSING, missing_left[n], b <= cut[n]), left[n], right[n])
        inner = inner[left[at[inner]] >= 0]
    return at


def cuts_of(rows: DataFrame, columns: list[str], bins: int) -> dict[int, list[np.ndarray]]:
    """By group: each feature's bin limits, values that rows have; a value v is in bin k if k limits are at most v. At most bins - 1 limits."""
    shares = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    asked = [F.percentile_approx(F.when(~F.isnan(c), F.col(c)), shares, 10 * bins).alias(f"c{k}") for k, c in enumerate(columns)]
    low = [F.min(F.when(~F.isnan(c), F.col(c))).alias(f"l{k}") for k, c in enumerate(columns)]
    out = {}
    for r in rows.groupBy("g").agg(*asked, *low).collect():  # a row a group
        limits = [np.unique(np.array(r[f"c{k}"] or [], float)) for k in range(len(columns))]
        out[r["g"]] = [x[x > r[f"l{k}"]] if len(x) else x for k, x in enumerate(limits)]
    return out


def to_bins(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    out = np.searchsorted(limits, values, side="right")
    out[np.isnan(values)] = MISSING
    return out.astype(np.uint8)


def numbers(batch, columns: list[str]) -> np.ndarray:
    """Columns of a batch as doubles, rows by columns, NaN for null."""
    return np.stack([batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], axis=1) if batch.num_rows else np.empty((0, len(columns)))


def binned(rows: DataFrame, columns: list[str], cuts) -> DataFrame:
    """g, row, y, margin and bins (a byte a feature) of rows(g, row, y, margin, columns)."""

    def run(batches):
        for batch in batches:
            x, g = numbers(batch, columns), batch.column(0).to_numpy()
            b = np.empty(x.shape, np.uint8)
            for group in np.unique(g):
                own = g == group
                for k, limits in enumerate(cuts.value[int(group)]):
                    b[own, k] = to_bins(x[own, k], limits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([r.tobytes() for r in b], pa.binary())], names=["g", "row", "y", "margin", "bins"])

    return rows.select("g", "row", "y", "margin", *columns).mapInArrow(run, "g int, row long, y double, margin double, bins binary")


def unpacked(batch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, width)


def margins(batch, bins: np.ndarray, trees: dict[int, list[tuple]]) -> np.ndarray:
    """Log-odds of a batch's rows, with the trees grown since they were written."""
    out, g = batch.column(3).to_numpy().copy(), batch.column(0).to_numpy()
    for group in np.unique(g):
        own = np.flatnonzero(g == group)
        for t in trees.get(int(group), ()):
            out[own] += t[5][leaf_of(t, bins[own])]
    return out


def chosen(row: np.ndarray, tree: int, growth: Growth) -> np.ndarray:
    """Which rows a tree is grown on, by a hash of the row's number."""
    with np.errstate(over="ignore"):
        h = (row.astype(np.uint64) + np.uint64(growth.seed * 1_000_003 + tree + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ h >> np.uint64(29)) >> np.uint64(11) < np.uint64(int(growth.share * (1 << 53)))


def histograms(data: DataFrame, width: int, trees: dict[int, list[tuple]], now: dict[int, tuple], wanted: dict[int, list[int]], features: list[int], tree: int, growth: Growth) -> DataFrame:
    """g, node, feature, bin and the sums of gradients, Hessians and rows there. now: the tree that is growing; wanted: its nodes in question."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        offset = np.arange(len(features)) * 256
        for batch in batches:
            bins, g = unpacked(batch, width), batch.column(0).to_numpy()
            p = 1 / (1 + np.exp(-margins(batch, bins, trees)))
            grad, hess = p - batch.column(2).to_numpy(), p * (1 - p)
            use = chosen(batch.column(1).to_numpy(), tree, growth)
            for group, nodes in wanted.items():
                own = np.flatnonzero(use & (g == group))
                if not len(own):
                    continue
                at = leaf_of(now[group], bins[own])
                for n in nodes:
                    here = own[at == n]
                    if len(here):
                        flat = (bins[here][:, features] + offset).ravel()
                        size, k = 256 * len(features), len(features)
                        held = sums.setdefault((group, n), np.zeros((3, size)))
                        held[0] += np.bincount(flat, np.repeat(grad[here], k), size)
                        held[1] += np.bincount(flat, np.repeat(hess[here], k), size)
                        held[2] += np.bincount(flat, minlength=size)
        for (group, n), held in sums.items():
            at = np.flatnonzero(held[2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), group, np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(np.array(features, np.int32)[at // 256]), pa.array((at % 256).astype(np.int32)), *(pa.array(held[k][at]) for k in (0, 1)), pa.array(held[2][at].astype(np.int64))],
                names=["g", "node", "feature", "bin", "sg", "sh", "c"],
            )

    return data.mapInArrow(run, "g int, node int, feature int, bin int, sg double, sh double, c long")


#: One statement, as a job is planned for every level. Rows come by (g, node, feature), so that only the last grouping moves them again.
SPLITS = """
WITH total AS (SELECT g, node, feature, bin, sum(sg) AS sg, sum(sh) AS sh, sum(c) AS c FROM {found} GROUP BY g, node, feature, bin),
sides AS (
  SELECT g, node, feature, bin, sum(sg) OVER f AS g_all, sum(sh) OVER f AS h_all, sum(c) OVER f AS c_all, sum(IF(bin < 255, sg, 0)) OVER r AS gl, sum(IF(bin < 255, sh, 0)) OVER r AS hl, sum(IF(bin < 255, c, 0)) OVER r AS cl,
    sum(IF(bin = 255, sg, 0)) OVER f AS gm, sum(IF(bin = 255, sh, 0)) OVER f AS hm, sum(IF(bin = 255, c, 0)) OVER f AS cm
  FROM total WINDOW f AS (PARTITION BY g, node, feature), r AS (PARTITION BY g, node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
-- A node of which all rows lack a feature still tells its sums.
ways AS (
  SELECT g, node, feature, bin, g_all, h_all, c_all, w AS missing_left, gl + IF(w, gm, 0) AS gl, hl + IF(w, hm, 0) AS hl, cl + IF(w, cm, 0) AS cl
  FROM sides LATERAL VIEW explode(IF(cm > 0 AND bin < 255, array(false, true), array(false))) x AS w),
gains AS (
  SELECT *, CASE WHEN bin < 255 AND hl >= {least_weight} AND h_all - hl >= {least_weight} AND cl >= {least_rows} AND c_all - cl >= {least_rows} AND cl < c_all
    THEN round(gl * gl / (hl + {l2}) + (g_all - gl) * (g_all - gl) / (h_all - hl + {l2}) - g_all * g_all / (h_all + {l2}), 9) END AS gain FROM ways),
best AS (SELECT g, node, max_by(struct(feature, bin, missing_left, gain, gl, hl, cl, g_all, h_all, c_all), struct(coalesce(gain, -1D), -feature, -bin, NOT missing_left)) AS s FROM gains GROUP BY g, node)
SELECT g, node, s.* FROM best
"""


def best_splits(found: DataFrame, growth: Growth) -> DataFrame:
    """By g and node: its sums (g_all, h_all, c_all) and the best split: feature, bin, missing_left, gain and the sums of its left side."""
    return found.sparkSession.sql(SPLITS, found=found.repartition("g", "node", "feature"), l2=growth.l2, least_weight=growth.least_weight, least_rows=growth.least_rows)


def leaf_wise(tree: Tree, splits: dict[int, dict], leaves: int) -> tuple[list[int], list[int]]:
    """Nodes that best-first growth splits, as far as it is known, and the nodes that it must know to go on."""
    held, taken = [0], []
    while len(held) < leaves:
        unknown = [n for n in held if n not in splits]
        if unknown:
            return taken, unknown
        best = max(held, key=lambda n: (splits[n]["gain"] or 0, -n))
        if (splits[best]["gain"] or 0) <= 1e-6:
            break
        held.remove(best)
        taken.append(best)
        held += [tree.left[best], tree.right[best]]
    return taken, []


def pruned(tree: Tree, taken: set[int]) -> Tree:
    """The tree with the splits in `taken` alone, numbered anew from the root down."""
    out, order, at = Tree(), [0], {0: 0}
    while order:
        n = order.pop(0)
        for own, new in zip(dataclasses.astuple(tree), (out.feature, out.bin, out.missing_left, out.left, out.right, out.value, out.cover, out.rows, out.gain)):
            new.append(own[n])
        me = len(out.left) - 1
        at[n] = me
        if n in taken:
            order += [tree.left[n], tree.right[n]]
        else:
            out.feature[me] = out.bin[me] = out.left[me] = out.right[me] = -1
            out.gain[me], out.missing_left[me] = 0.0, False
    for n, me in at.items():
        if n in taken:
            out.left[me], out.right[me] = at[tree.left[n]], at[tree.right[n]]
    return out


def grown(data: DataFrame, width: int, groups: list[int], trees: dict[int, list[tuple]], tree: int, growth: Growth) -> dict[int, Tree]:
    """The next tree of every group."""
    rng = random.Random(growth.seed * 7919 + tree)
    features = sorted(rng.sample(range(width), max(1, math.ceil(growth.columns * width - 1e-9))))
    made, splits = {g: Tree() for g in groups}, {g: {} for g in groups}
    for t in made.values():
        t.add(0.0, 1.0, 0, growth)
    wanted, level = {g: [0] for g in groups}, {g: {0: 0} for g in groups}
    while wanted:
        now = {g: made[g].arrays() for g in wanted}
        for r in best_splits(histograms(data, width, trees, now, wanted, features, tree, growth), growth).collect():  # a row a node
            g, n, t = r["g"], r["node"], made[r["g"]]
            if n == 0:
                t.value[0], t.cover[0], t.rows[0] = -growth.rate * r["g_all"] / (r["h_all"] + growth.l2), r["h_all"], r["c_all"]
            splits[g][n] = r.asDict()
        following = {}
        for g, asked in wanted.items():
            t, own = made[g], splits[g]
            for n in asked:
                own.setdefault(n, {"gain": None})
                if (own[n]["gain"] or 0) > 1e-6 and level[g][n] < growth.depth:
                    for child in t.split(n, own[n], growth):
                        level[g][child] = level[g][n] + 1
                else:
                    own[n]["gain"] = None
            new = [n for n in range(len(t.left)) if n not in own and level[g][n] < growth.depth]
            for n in range(len(t.left)):
                if n not in own and level[g][n] >= growth.depth:
                    own[n] = {"gain": None}
            if growth.leaves is not None:
                # Of the nodes ahead, those below the largest gains may be wanted.
                taken, unknown = leaf_wise(t, own, growth.leaves)
                if not unknown:
                    new = []
                else:
                    parent = {c: n for n in range(len(t.left)) if t.left[n] >= 0 for c in (t.left[n], t.right[n])}
                    top = sorted({parent[n] for n in new if n in parent}, key=lambda n: -(own[n]["gain"] or 0))[: growth.leaves - 1 - len(taken) + len(unknown)]
                    new = [n for n in new if n in unknown or parent.get(n) in top]
            if new:
                following[g] = new
        wanted = following
    out = {}
    for g, t in made.items():
        taken = {n for n in range(len(t.left)) if t.left[n] >= 0} if growth.leaves is None else set(leaf_wise(t, splits[g], growth.leaves)[0])
        out[g] = pruned(t, taken)
    return out


@dataclasses.dataclass
class Boosted:
    """Fitted models by group: base log-odds, and trees whose thresholds are values (left: below the threshold)."""

    columns: list[str]
    groups: list[tuple]
    keys: list[str]
    base: dict[int, float]
    trees: dict[int, list[Tree]]
    cuts: dict[int, list[np.ndarray]]
    growth: Growth

    def threshold(self, g: int, feature: int, cut: int) -> float:
        limits = self.cuts[g][feature]
        return float(limits[cut]) if cut < len(limits) else math.inf

    def node_rows(self) -> list[tuple]:
        """A row a node, as NODE says; leaves have no feature. Tree -1 holds the base."""
        out = []
        for g, base in self.base.items():
            out.append((g, -1, 0, None, None, None, None, None, base, None, None, None))
            for k, t in enumerate(self.trees.get(g, [])):
                for n in range(len(t.left)):
                    inner = t.left[n] >= 0
                    out.append((g, k, n, self.columns[t.feature[n]] if inner else None, self.threshold(g, t.feature[n], t.bin[n]) if inner else None, t.missing_left[n] if inner else None, t.left[n] if inner else None, t.right[n] if inner else None, t.value[n], t.cover[n], t.rows[n], t.gain[n] if inner else None))
        return out

    def flat(self) -> dict[int, list[tuple]]:
        """By group, for each tree: feature, threshold, missing_left, left, right, value and cover arrays."""
        return {g: [(np.array(t.feature), np.array([self.threshold(g, f, b) if f >= 0 else np.nan for f, b in zip(t.feature, t.bin)]), np.array(t.missing_left), np.array(t.left), np.array(t.right), np.array(t.value), np.array(t.cover)) for t in ts] for g, ts in self.trees.items()}


def from_rows(columns: list[str], rows: list[tuple], growth: Growth) -> Boosted:
    """A model without keys from its node rows."""
    base, trees, limits = {0: 0.0}, {0: []}, [set() for _ in columns]
    at = {c: k for k, c in enumerate(columns)}
    for r in rows:
        if r[3] is not None and math.isfinite(r[4]):
            limits[at[r[3]]].add(r[4])
    cuts = [np.array(sorted(x)) for x in limits]
    for _, tree, _, feature, threshold, missing_left, left, right, value, cover, n, gain in sorted(rows, key=lambda r: (r[1], r[2])):
        if tree < 0:
            base[0] = value
            continue
        if tree == len(trees[0]):
            trees[0].append(Tree())
        t, inner = trees[0][tree], feature is not None
        new = (at[feature], int(np.searchsorted(cuts[at[feature]], threshold)), missing_left, left, right) if inner else (-1, -1, False, -1, -1)
        for c, v in zip((t.feature, t.bin, t.missing_left, t.left, t.right, t.value, t.cover, t.rows, t.gain), (*new, value, cover, n, gain or 0.0)):
            c.append(v)
    return Boosted(columns, [()], [], base, trees, {0: cuts}, growth)


def grouped(rows: DataFrame, keys: list[str], groups: list[tuple] | None = None) -> tuple[DataFrame, list[tuple]]:
    """rows with g, the number of their group by keys; the groups, a few, are numbered in their order."""
    spark = rows.sparkSession
    if not keys:
        return rows.withColumn("g", F.lit(0)), [()]
    if groups is None:
        groups = sorted(tuple(r) for r in rows.select(*keys).distinct().collect())
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("g", T.IntegerType())])
    return rows.join(F.broadcast(spark.createDataFrame([(*x, k) for k, x in enumerate(groups)], schema)), keys), groups


def fit(rows: DataFrame, columns: list[str], keys: list[str] | None = None, growth: Growth = DEPTH_WISE) -> Boosted:
    """Models by keys, fitted on rows(keys, y, columns)."""
    keys = keys or []
    numbered, groups = grouped(rows.where("y is not null").select(*keys, F.col("y").cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in columns)), keys)
    dealt = kept(numbered.withColumn("row", F.monotonically_increasing_id()), "boosting-rows")
    rates = {r["g"]: r["m"] for r in dealt.groupBy("g").agg(F.avg("y").alias("m")).collect()}
    base = {g: math.log(m / (1 - m)) if 0 < m < 1 else math.copysign(math.log(1e6 - 1), m - 0.5) for g, m in rates.items()}
    model = Boosted(columns, groups, keys, base, {g: [] for g in rates}, cuts_of(dealt, columns, min(growth.bins, MISSING)), growth)
    alive = [g for g, m in rates.items() if 0 < m < 1]
    spark = rows.sparkSession
    start = F.create_map(*(F.lit(x) for g, b in base.items() for x in (g, b))) if base else F.create_map(F.lit(0), F.lit(0.0))
    data = kept(binned(dealt.withColumn("margin", start[F.col("g")]), columns, spark.sparkContext.broadcast(model.cuts)), "boosting-bins")
    discard(dealt)
    fresh: dict[int, list[tuple]] = {g: [] for g in alive}
    for tree in range(growth.trees if alive else 0):
        for g, t in grown(data, len(columns), alive, fresh, tree, growth).items():
            model.trees[g].append(t)
            fresh[g].append(t.arrays())
        if tree % KEEP == KEEP - 1:
            before, data = data, kept(advanced(data, len(columns), fresh), "boosting-bins")
            discard(before)
            fresh = {g: [] for g in alive}
    discard(data)
    return model


def advanced(data: DataFrame, width: int, trees: dict[int, list[tuple]]) -> DataFrame:
    """The rows with the trees added to their log-odds."""

    def run(batches):
        for batch in batches:
            yield batch.set_column(3, "margin", pa.array(margins(batch, unpacked(batch, width), trees)))

    return data.mapInArrow(run, data.schema)


def walked(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of values x, by thresholds."""
    feature, threshold, missing_left, left, right = tree[:5]
    at = np.zeros(len(x), np.int64)
    inner = np.flatnonzero(left[at] >= 0)
    while len(inner):
        n = at[inner]
        v = x[inner, feature[n]]
        at[inner] = np.where(np.where(np.isnan(v), missing_left[n], v < threshold[n]), left[n], right[n])
        inner = inner[left[at[inner]] >= 0]
    return at


def score(model: Boosted, rows: DataFrame, name: str = "p") -> DataFrame:
    """rows of the model's groups with the probability of 1 and `margin`, its log-odds."""
    numbered, _ = grouped(rows, model.keys, model.groups)
    flat, base, columns = model.flat(), model.base, model.columns
    out = T.StructType([*rows.schema, T.StructField(name, T.DoubleType()), T.StructField("margin", T.DoubleType())])
    order = [*rows.columns, "g"]

    def run(batches):
        for batch in batches:
            x, g = numbers(batch, columns), batch.column(batch.num_columns - 1).to_numpy()
            z = np.zeros(len(g))
            for group in np.unique(g):
                own = np.flatnonzero(g == group)
                z[own] = base[int(group)] + sum((t[5][walked(t, x[own])] for t in flat[int(group)]), np.zeros(len(own)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-z))), pa.array(z)], names=out.names)

    return numbered.select(*order).mapInArrow(run, out)


def importance(model: Boosted, spark) -> DataFrame:
    """By group and feature: total gain and number of splits."""
    nodes = spark.createDataFrame(model.node_rows(), NODE)
    return nodes.where("feature is not null").groupBy("g", "feature").agg(F.sum("gain").alias("gain"), F.count("*").alias("splits"))
