"""Contributions of features to the log-odds of boosted trees: exact Shapley values along the trees' own paths.

A missing feature is stood for by the tree's training rows: at its splits both sides count, by their cover. For a leaf, the features on its
path are the players. With o_k whether a row passes all of k's splits on the path and z_k the product of the shares of cover there, a
coalition S reaches the leaf with weight prod(o_k in S) * prod(z_k outside). The coefficients of prod(z_k + o_k x) over the other players,
weighted by s! (d - 1 - s)! / d!, give the contribution of a player times (o - z): a polynomial of the path's length instead of all subsets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.boosting import Boosted, grouped, numbers


def paths(tree: tuple) -> list[tuple[float, list[tuple[int, list[tuple[float, bool, bool]], float]]]]:
    """For each leaf its value and the players on its path: feature, conditions (threshold, missing goes left, leaf is left) and share of cover."""
    feature, threshold, missing_left, left, right, value, cover = tree
    out, todo = [], [(0, {})]
    while todo:
        n, players = todo.pop()
        if left[n] < 0:
            out.append((float(value[n]), [(f, c, z) for f, (c, z) in players.items()]))
            continue
        for child, is_left in ((left[n], True), (right[n], False)):
            conditions, share = players.get(int(feature[n]), ([], 1.0))
            todo.append((int(child), players | {int(feature[n]): ([*conditions, (float(threshold[n]), bool(missing_left[n]), is_left)], share * float(cover[child] / cover[n]))}))
    return out


def expected(leaves: list) -> float:
    return sum(v * math.prod(z for _, _, z in players) for v, players in leaves)


def contributions_of(x: np.ndarray, trees: list[list]) -> np.ndarray:
    """Rows by features: the sum over trees (as `paths` gives them) of each feature's contribution."""
    out = np.zeros(x.shape)
    for leaves in trees:
        for value, players in leaves:
            d = len(players)
            if not d:
                continue
            passes = np.empty((d, len(x)))
            for k, (f, conditions, _) in enumerate(players):
                v, ok = x[:, f], np.ones(len(x), bool)
                for threshold, missing_left, is_left in conditions:
                    ok &= np.where(np.isnan(v), missing_left, v < threshold) == is_left
                passes[k] = ok
            shares = np.array([z for _, _, z in players])
            weights = np.array([math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)])
            for k, (f, _, z) in enumerate(players):
                poly = np.zeros((d, len(x)))
                poly[0] = 1
                for j in range(d):
                    if j != k:
                        poly[1:] = poly[1:] * shares[j] + poly[:-1] * passes[j]
                        poly[0] *= shares[j]
                out[:, f] += value * (passes[k] - z) * (weights @ poly)
    return out


def contributions(model: Boosted, rows: DataFrame) -> DataFrame:
    """rows with base_value and contributions, a map by feature: base value plus contributions is the log-odds of the model's score."""
    numbered, _ = grouped(rows, model.keys, model.groups)
    trees = {g: [paths(t) for t in ts] for g, ts in model.flat().items()}
    bases = {g: model.base[g] + sum(map(expected, ts)) for g, ts in trees.items()}
    columns = model.columns
    kind = T.MapType(T.StringType(), T.DoubleType())
    out = T.StructType([*rows.schema, T.StructField("base_value", T.DoubleType()), T.StructField("contributions", kind)])

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                x, g = numbers(batch, columns), batch.column(batch.num_columns - 1).to_numpy()
                made, base = np.zeros(x.shape), np.zeros(len(g))
                for group in np.unique(g):
                    own = np.flatnonzero(g == group)
                    made[own], base[own] = contributions_of(x[own], trees[int(group)]), bases[int(group)]
                at = pa.array(np.arange(len(g) + 1, dtype=np.int32) * len(columns))
                maps = pa.MapArray.from_arrays(at, pa.array(columns * len(g), pa.string()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base), maps], names=out.names)

    return numbered.select(*rows.columns, "g").mapInArrow(run, out)


def overall(explained: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """By keys and feature, over rows with contributions: the mean absolute contribution, the mean one, and the share of all."""
    keys = keys or []
    long = explained.select(*keys, F.explode("contributions").alias("feature", "value"))
    means = long.groupBy(*keys, "feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean"))
    totals = means.groupBy(*keys).agg(F.sum("mean_abs").alias("_all"))
    joined = means.join(totals, keys) if keys else means.crossJoin(F.broadcast(totals))  # one row without keys
    return joined.withColumn("share", F.try_divide("mean_abs", "_all")).drop("_all")
