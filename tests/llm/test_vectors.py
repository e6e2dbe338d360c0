import numpy as np
import pytest

from tidemark.llm import vectors


def brute(rows, threshold):
    """n_links, component_id and kept by comparing all pairs."""
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        a = a / np.abs(a).max()
        return a / np.sqrt((a * a).sum())

    units = [unit(v) for _, v in rows]
    n = len(rows)
    near = [[k for k in range(n) if k != j and units[j] is not None and units[k] is not None and len(units[j]) == len(units[k]) and units[j] @ units[k] >= threshold] for j in range(n)]
    out = []
    for j in range(n):
        seen, todo = {j}, [j]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids, default=None)
        out.append((rows[j][0], len(near[j]), least, least is not None and rows[j][0] == least))
    return out


def planted(rng, n, dim, noise):
    centres = rng.normal(size=(6, dim))
    rows = [centres[rng.integers(6)] + noise * rng.normal(size=dim) for _ in range(n)] + list(rng.normal(size=(n // 3, dim)))
    return [[float(np.float32(x)) for x in v] for v in rows]


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("dim,noise,most,members", [(8, 0.25, 512, 2048), (8, 0.35, 12, 20), (3, 0.4, 5, 7), (16, 0.2, 3, 10), (2, 0.5, 40, 5)])
def test_matches_brute_force(spark, dim, noise, most, members):
    rng = np.random.default_rng(dim)
    rows = [(k, v) for k, v in enumerate(planted(rng, 150, dim, noise))]
    rows += [(1000 + k, rows[0][1]) for k in range(30)] + [(2000, [2 * x for x in rows[1][1]]), (5, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.near_duplicates(df, 0.9, most, members).collect()
    assert key(map(tuple, got)) == key(brute(rows, 0.9))
    again = vectors.near_duplicates(df.repartition(5), 0.9, most, members).collect()
    assert key(map(tuple, again)) == key(map(tuple, got))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [None, 1.0, 1.0]), (7, good), (8, good), (None, good), (9, [1.0, 2.0]), (10, [1.0, 2.0]), (None, [5.0]), (None, None), (11, [1e300, 2e300, 3e300]), (12, [1e-300, 2e-300, 3e-300]), (-4, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, unit string")
    got = key(map(tuple, vectors.near_duplicates(df).collect()))
    assert got == key(brute(rows, 0.9))
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_a_dense_group_is_not_compared_pair_by_pair(spark):
    """Copies with little noise are one core, which no one visits: what travels is linear."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    rows = [(k, [float(x) for x in centre + 0.02 * rng.normal(size=32)]) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    nodes = vectors.nodes_of(df)
    pivots, _ = vectors.pivots_of(nodes, 0.9, 512, 100)
    assert len(pivots[32]) == 1
    got = vectors.near_duplicates(df, 0.9, 512, 100).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(2999, 0)} and sum(r.kept for r in got) == 1
