import itertools
import math
import random

import numpy as np
import pytest

from tidemark.operators import boosting, explain
from tidemark.operators.boosting import Growth


def data(n, seed=1, features=4, grid=None):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x = [rng.gauss(0, 1) if grid is None else rng.randrange(grid) / 4 for _ in range(features)]
        if rng.random() < 0.2:
            x[1] = None
        if rng.random() < 0.1:
            x[2] = float("nan")
        z = x[0] + (0.8 if x[1] is None else -x[1]) + 0.5 * (x[3] > 0)
        rows.append((*x, float(rng.random() < 1 / (1 + math.exp(-z)))))
    return rows


def frame(spark, rows, features=4):
    return spark.createDataFrame(rows, ", ".join(f"x{k} double" for k in range(features)) + ", y double")


def brute_tree(x, grad, hess, growth):
    """The tree by trying every threshold of every feature at every node, row by row."""
    nan = np.isnan(x)

    def best(rows):
        g, h = grad[rows].sum(), hess[rows].sum()
        found = None
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f][~nan[rows, f]])
            for lower, t in zip(values, [*values[1:], math.inf]):
                for missing_left in (False, True) if nan[rows, f].any() else (False,):
                    left = np.where(nan[rows, f], missing_left, x[rows, f] < t)
                    gl, hl = grad[rows][left].sum(), hess[rows][left].sum()
                    if not left.any() or left.all() or min(hl, h - hl) < growth.least_weight or min(left.sum(), (~left).sum()) < growth.least_rows:
                        continue
                    gain = round(gl**2 / (hl + growth.l2) + (g - gl) ** 2 / (h - hl + growth.l2) - g**2 / (h + growth.l2), 9)
                    if gain > 1e-6 and (found is None or gain > found[0]):
                        found = gain, f, lower, missing_left, left
        return found

    # Leaf-wise with as many leaves as there may be is the same as depth-wise, but for the depth.
    leaves, done = [(np.arange(len(x)), 0)], []
    while leaves and (growth.leaves is None or len(leaves) + len(done) < growth.leaves):
        splits = [(best(rows) if depth < growth.depth else None) for rows, depth in leaves]
        known = [k for k, s in enumerate(splits) if s is not None]
        if not known:
            break
        k = max(known, key=lambda k: splits[k][0]) if growth.leaves is not None else known[0]
        rows, depth = leaves.pop(k)
        left = splits[k][4]
        leaves += [(rows[left], depth + 1), (rows[~left], depth + 1)]
    values = np.empty(len(x))
    for rows, _ in leaves + done:
        values[rows] = -growth.rate * grad[rows].sum() / (hess[rows].sum() + growth.l2)
    return values


@pytest.mark.parametrize("growth", [Growth(trees=1, depth=3, share=1, columns=1, rate=0.3), Growth(trees=1, depth=30, leaves=6, share=1, columns=1, rate=0.3, least_rows=20, least_weight=1e-3), Growth(trees=1, depth=1, share=1, columns=1, l2=0.5)])
def test_one_tree_is_that_of_a_brute_force_search(spark, growth):
    rows = data(500, grid=9)
    df = frame(spark, rows)
    columns = [f"x{k}" for k in range(4)]
    model = boosting.fit(df, columns, growth=growth)
    x = np.array([[math.nan if v is None else v for v in r[:4]] for r in rows])
    y = np.array([r[4] for r in rows])
    p = y.mean()
    want = math.log(p / (1 - p)) + brute_tree(x, p - y, np.full(500, p * (1 - p)), growth)
    got = boosting.score(model, df.select("*", *[]), "p").collect()
    assert len(got) == 500
    for r in got:
        k = next(k for k, row in enumerate(rows) if str(row) == str(tuple(r)[:5]))
        assert r.margin == pytest.approx(want[k], abs=1e-9) and r.p == pytest.approx(1 / (1 + math.exp(-r.margin)))
    tree = model.trees[0][0]
    leaves = sum(n < 0 for n in tree.left)
    assert leaves <= (growth.leaves or 2**growth.depth) and leaves == (6 if growth.leaves else leaves)
    assert tree.rows[0] == 500 == sum(n for n, left in zip(tree.rows, tree.left) if left < 0)


def test_groups_are_fitted_apart_and_learn(spark):
    a, b = data(600, 2), data(400, 3)
    df = frame(spark, a).selectExpr("*", "'a' as k").union(frame(spark, [(*r[:4], 1 - r[4]) for r in b]).selectExpr("*", "'b' as k")).union(frame(spark, [(*r[:4], 1.0) for r in b[:50]]).selectExpr("*", "'c' as k"))
    columns = [f"x{k}" for k in range(4)]
    growth = Growth(trees=20, rate=0.2, depth=3)
    both = boosting.fit(df, columns, ["k"], growth)
    alone = boosting.fit(df.where("k = 'b'"), columns, ["k"], Growth(trees=20, rate=0.2, depth=3, share=1.0))
    assert both.trees[2] == [] and len(both.trees[0]) == 20 == len(alone.trees[0])
    fresh = frame(spark, data(500, 9)).selectExpr("*", "'a' as k")
    scored = boosting.score(both, fresh).collect()
    up, down = [r.p for r in scored if r.y], [r.p for r in scored if not r.y]
    auc = sum((u > d) + (u == d) / 2 for u in up for d in down) / len(up) / len(down)
    assert auc > 0.68
    opposite = boosting.score(both, fresh.withColumn("k", __import__("pyspark").sql.functions.lit("b"))).collect()
    assert sum(r.p for r in opposite if r.y) / len(up) < sum(r.p for r in opposite if not r.y) / len(down)
    assert boosting.importance(both, spark).where("g = 0").orderBy("gain", ascending=False).first().feature in ("x0", "x1")


def test_contributions_are_shapley_values(spark):
    """They sum to the log-odds, and equal the enumeration of all subsets of the four features."""
    rows = data(400, 5)
    df = frame(spark, rows)
    columns = [f"x{k}" for k in range(4)]
    model = boosting.fit(df, columns, growth=Growth(trees=6, rate=0.3, depth=5, leaves=9, least_rows=5, least_weight=1e-3))
    explained = explain.contributions(model, boosting.score(model, df)).limit(40).collect()
    trees = model.flat()[0]

    def value(tree, row, known, n=0):
        feature, threshold, missing_left, left, right, values, cover = tree
        if left[n] < 0:
            return values[n]
        v = row[feature[n]]
        if feature[n] in known:
            missing = v is None or math.isnan(v)
            return value(tree, row, known, left[n] if (missing_left[n] if missing else v < threshold[n]) else right[n])
        return (cover[left[n]] * value(tree, row, known, left[n]) + cover[right[n]] * value(tree, row, known, right[n])) / cover[n]

    for r in explained:
        worth = {s: model.base[0] + sum(value(t, tuple(r)[:4], s) for t in trees) for k in range(5) for s in map(frozenset, itertools.combinations(range(4), k))}
        assert r.base_value == pytest.approx(worth[frozenset()], abs=1e-9)
        assert r.base_value + sum(r.contributions.values()) == pytest.approx(r.margin, abs=1e-9)
        for f in range(4):
            others = [k for k in range(4) if k != f]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (worth[frozenset(s) | {f}] - worth[frozenset(s)]) for k in range(4) for s in itertools.combinations(others, k))
            assert r.contributions[f"x{f}"] == pytest.approx(want, abs=1e-9)
    shares = explain.overall(explain.contributions(model, df)).collect()
    assert sum(r.share for r in shares) == pytest.approx(1)
