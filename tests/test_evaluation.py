import datetime
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, errors, folds, inference, metrics, models, regime, walkforward


def scored(spark, pairs, key="a"):
    return spark.createDataFrame([(key, float(y), float(p)) for y, p in pairs], "k string, y double, p double")


def test_perfect_inverted_and_one_class(spark):
    good = [(0, 0.01), (0, 0.02), (1, 0.98), (1, 0.99)]
    row = metrics.evaluate(scored(spark, good), ["k"]).first()
    assert (row.accuracy, row.roc_auc, row.f1, row.pr_auc) == (1, 1, 1, 1)
    assert metrics.roc_auc(scored(spark, [(y, 1 - p) for y, p in good]), ["k"]).first().roc_auc == 0
    assert metrics.roc_auc(scored(spark, [(1, 0.2), (1, 0.3)]), ["k"]).first().roc_auc is None
    flat = metrics.evaluate(scored(spark, [(1, 0.4), (0, 0.4), (0, 0.4), (0, 0.4)]), ["k"]).first()
    assert flat.roc_auc == 0.5 and flat.ece == pytest.approx(0.15)


def test_auc_with_ties_by_pairs(spark):
    rng = random.Random(1)
    pairs = [(rng.random() < 0.4, round(rng.random(), 1)) for _ in range(200)]
    up, down = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    want = sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down)
    assert metrics.roc_auc(scored(spark, pairs), ["k"]).first().roc_auc == pytest.approx(want)


def test_threshold(spark):
    row = metrics.select_threshold(scored(spark, [(0, 0.1), (0, 0.2), (1, 0.6), (1, 0.9)]), ["k"]).first()
    assert row.threshold == pytest.approx(0.21) and row.score == 1
    assert metrics.select_threshold(scored(spark, [(1, 0.9), (1, 0.2)]), ["k"]).first().threshold == 0.5


@pytest.mark.parametrize("horizon", [1, 5])
@pytest.mark.parametrize("rolling", [None, 300])
def test_folds_are_ordered_and_apart(spark, horizon, rolling):
    days = spark.range(2000).select(F.expr("date_add(date'2006-01-02', cast(id as int))").alias("date"), F.col("id").alias("pos"))
    f = folds.folds(days, 800, 126, 126, 120, horizon, 5, rolling)
    rows = f.orderBy("fold").collect()
    assert [r.fold for r in rows] == list(range(len(rows))) and len(rows) == 9
    assert folds.violations(f, horizon).count() == 0
    for r in rows:
        assert r.inner_start - r.fit_end == horizon + 6 and r.test_start - r.inner_end == horizon + 6
        assert r.fit_start == (0 if rolling is None else max(0, r.fit_end - rolling + 1))
    assigned = folds.assign(days.select("date"), f).groupBy("fold", "part").count().collect()
    assert all(r["count"] == 126 for r in assigned if r.part == "test")
    assert folds.search_windows(days, 800, 3, 120).agg(F.max("val_end")).first()[0] < 800


def test_signed_ranks_and_false_discovery(spark):
    df = spark.createDataFrame([("m", k, 0.5 + d, 0.5) for k, d in enumerate([0.1, -0.2, 0.3, 0.0])] + [("same", k, 0.5, 0.5) for k in range(4)], "model string, fold long, value double, value_ref double")
    got = {r.model: r for r in inference.signed_ranks(df).collect()}
    assert (got["m"].w_plus, got["m"].w_minus, got["m"].wins) == (2 + 4 + 0.5, 3 + 0.5, 2)
    assert got["same"].w_plus == got["same"].w_minus == 5
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "model string, p double")
    assert {r.model: r.p_adj and round(r.p_adj, 6) for r in inference.adjust_p(p).collect()} == {"a": 0.03, "b": 0.04, "c": 0.04, "d": None}


def test_exact_p_values_by_all_sign_patterns(spark):
    """With ties and zeros too: patterns of signs are enumerated over the ranks of absolute differences."""
    rng = random.Random(8)
    cases = {"plain": [0.1, -0.2, 0.3, 0.4, 0.55], "ties": [0.1, 0.1, -0.1, 0.2, 0.2, 0.3], "zeros": [0.0, 0.0, 0.1, 0.2, -0.2, 0.4, 0.4], "none": [0.0] * 4, "few": [0.1, 0.2], "one": [0.0, 0.0, 0.3], "many": [round(rng.gauss(0.3, 1), 1) for _ in range(12)]}
    df = spark.createDataFrame([(m, k, 0.5 + x, 0.5) for m, xs in cases.items() for k, x in enumerate(xs)], "model string, fold long, value double, value_ref double")
    got = {r.model: r for r in inference.signed_rank_p(inference.signed_ranks(df)).collect()}
    for m, xs in cases.items():
        size = sorted(map(abs, xs))
        rank = {x: (size.index(x) + 1 + len(size) - size[::-1].index(x)) / 2 for x in size}
        moving, still = [rank[abs(x)] for x in xs if x], sum(rank[0] for x in xs if not x)
        least = min(sum(rank[abs(x)] for x in xs if x > 0), sum(rank[abs(x)] for x in xs if x < 0))
        hits = sum(sum(r for r, s in zip(moving, signs) if s) <= least for signs in itertools.product((0, 1), repeat=len(moving)))
        assert got[m].p == (None if len(xs) < 3 else pytest.approx(min(1, 2 * hits / 2 ** len(moving)))), m
        assert got[m].w == pytest.approx(least + still / 2)
    # Beyond the exact range the normal curve is close to it.
    long = spark.createDataFrame([("a", k, 0.5 + 0.01 * (k + 1) * (-1 if k % 3 == 0 else 1), 0.5) for k in range(51)], "model string, fold long, value double, value_ref double")
    signed = inference.signed_ranks(long)
    w, n = signed.first().w, 51
    assert inference.signed_rank_p(signed).first().p == pytest.approx(math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24) / math.sqrt(2)), rel=1e-6)
    z = spark.createDataFrame([(x / 10,) for x in range(80)], "z double").select("z", inference.normal_tail(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-9) for r in z)


def test_permutation_and_bootstrap(spark):
    rng = random.Random(2)
    rows = [(f, datetime.date(2020, 1, 1) + datetime.timedelta(days=40 * f + t), f"t{k}", float(rng.random() < 0.5), rng.random()) for f in range(3) for t in range(20) for k in range(4)]
    df = spark.createDataFrame(rows, "fold long, date date, ticker string, y double, p double")
    for out in (inference.permutation_auc(df, ["fold"], 30).first(), inference.permutation_pooled(df, 30).first()):
        assert out.draws == 30 and abs(out.null_mean - 0.5) < 0.1 and 0 <= out.p_value <= 1
    values = spark.createDataFrame([(k, 0.5 + 0.01 * k) for k in range(12)], "fold long, value double")
    b = inference.block_bootstrap(values, 4, 200).first()
    assert b.low < b.mean < b.high
    # Samples have as many values as there are: means of 7 values, in whole blocks of 2, would be eighths.
    few = spark.createDataFrame([(k, float(k == 0)) for k in range(7)] + [(9, None)], "fold long, value double")
    c = inference.block_bootstrap(few, 2, 300).first()
    assert round(c.high * 7, 6) == round(c.high * 7) and c.mean == pytest.approx(1 / 7)
    assert inference.block_bootstrap(few.where("fold = 0"), 4, 10).first().low is None


def book(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(datetime.date(2020, 1, 1) + datetime.timedelta(days=t), f"t{k}", rng.random(), rng.gauss(0, 0.01)) for t in range(60) for k in range(4) if (t, k) != (5, 2)], "date date, ticker string, p double, ret double")


def test_costs_only_reduce_returns(spark):
    w = backtest.weights(book(spark))
    assert w.count() == 239 and w.groupBy("date").agg(F.sum("weight").alias("s")).where("s > 1.0000001").count() == 0
    days = backtest.simulate(w)
    sweep = {r.bps: r for r in backtest.cost_sweep(days).collect()}
    annual = [sweep[b].annual_return for b in (0.0, 5.0, 10.0, 20.0)]
    assert annual == sorted(annual, reverse=True) and len({r.turnover for r in sweep.values()}) == 1
    be = backtest.break_even(days).first()[0]
    net = backtest.simulate(w, be).agg(F.avg("net")).first()[0]
    assert be >= 0 and (be == 0 or net == pytest.approx(0, abs=1e-12))


def test_errors_partition_rows(spark):
    rows = book(spark).withColumn("y", (F.col("ret") > 0).cast("double"))
    out = errors.breakdown(rows).collect()
    assert sum(r.n for r in out) == 239 and sum(r.share for r in out) == pytest.approx(1)
    assert sum(r.n for r in errors.confidence_deciles(rows).collect()) == 239
    assert sum(r.n for r in errors.by_bucket(rows, "ret").collect()) == 239


def test_filter_is_causal_and_finds_states(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, s, (150, 2)) for s in (0.5, 3.0, 0.5, 3.0)])
    params = regime.fit_hmm(x, 2, 20)
    full = regime.forward_filter(x, *params)
    assert np.allclose(full[:200], regime.forward_filter(x[:200], *params))
    state = full.argmax(1)
    assert (state[:150] == 0).mean() > 0.9 and (state[160:300] == 1).mean() > 0.9
    states = spark.createDataFrame([(datetime.date(2020, 1, 1) + datetime.timedelta(days=k), int(s)) for k, s in enumerate([0, 0, 1, 1, 1, 0])], "date date, state long")
    assert [(r.state, r.sessions) for r in regime.timeline(states).orderBy("run").collect()] == [(0, 2), (1, 3), (0, 1)]


def test_learner_calibration_and_contributions(spark):
    rng = random.Random(4)
    rows = []
    for k in range(600):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((k, a, b if k % 9 else None, float(rng.random() < 1 / (1 + 2.718 ** -(2 * a)))))
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    out = models.fit_predict(df.where("id < 400"), df.where("id >= 400"), ["a", "b"]).withColumn("all", F.lit(0))
    assert metrics.roc_auc(out, ["all"]).first().roc_auc > 0.8
    for calibrated in (models.isotonic(out.where("id < 500"), out), models.platt(out.where("id < 500"), out)):
        assert calibrated.where("p <= 0 or p >= 1 or p is null").count() == 0
    c = models.linear_contributions(df.where("b is not null"), {"a": 2.0, "b": -1.0}, {"a": 0.0, "b": 0.5})
    assert models.top_contributions(c, ["id"], 1).groupBy("id").count().agg(F.max("count")).first()[0] <= 2


def test_importance_deals_whole_rows_and_leaves_a_small_plan(spark):
    rng = random.Random(5)
    names = [f"x{k}" for k in range(12)]
    rows = [(*(rng.gauss(0, 1) if k % 3 or rng.random() < 0.8 else None for k in range(12)), 0.0) for _ in range(300)]
    rows = [(*r[:12], float(rng.random() < 1 / (1 + math.exp(-3 * r[1])))) for r in rows]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", y double")
    out = models.permutation_importance(df, df, names, repeats=3, at_once=5)
    assert len(out._jdf.queryExecution().analyzed().toString().splitlines()) < 5  # not a branch for every few features
    losses = {r.feature: r.mean_loss for r in out.collect()}
    assert sorted(losses) == sorted(names) and losses["x1"] > 0.2 and max(abs(v) for n, v in losses.items() if n != "x1") < 0.05
    dealt = models.shuffled(df, names, 3, 17).collect()
    for draw in range(3):
        mine = [r for r in dealt if r.draw == draw]
        assert sorted(map(str, ([r[n] for n in names] for r in mine))) == sorted(str(list(r._new)) for r in mine)
        assert len(mine) == 300 and sum([r[n] for n in names] != list(r._new) for r in mine) > 200


def test_quantiles_without_a_key(spark):
    import numpy as np

    rng = random.Random(9)
    values = [rng.choice([rng.gauss(0, 1), 0.5, 0.25]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(7)
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    assert metrics.quantiles(df, "v", shares, 16).first().q == pytest.approx(np.quantile(values, shares).tolist())
    one = spark.createDataFrame([(3.0,)], "v double")
    assert metrics.quantiles(one, "v", [0.0, 0.7]).first().q == [3.0, 3.0]


def test_buckets_of_equal_width_where_quantiles_coincide(spark):
    rows = spark.createDataFrame([(0.6, 1.0, 0.0)] * 95 + [(0.4, 0.0, float(k)) for k in range(1, 6)], "p double, y double, v double")
    assert sum(r.n for r in errors.by_bucket(rows, "v").collect()) == 100 and errors.by_bucket(rows, "v").count() > 1


def test_sparse_turnover_is_that_of_the_dense_grid(spark):
    rng = random.Random(10)
    rows = [(datetime.date(2020, 1, 1) + datetime.timedelta(days=t), f"t{k}", rng.random(), 0.01) for t in range(30) for k in range(5) if rng.random() < 0.6]
    w = backtest.weights(spark.createDataFrame(rows, "date date, ticker string, p double, ret double"))
    held = {(r.date, r.ticker): r.weight for r in w.collect()}
    days = sorted({d for d, _ in held})
    want = {d: sum(abs(held.get((d, f"t{k}"), 0) - (held.get((days[n - 1], f"t{k}"), 0) if n else 0)) for k in range(5)) for n, d in enumerate(days)}
    assert {r.date: r.traded for r in backtest.simulate(w).collect()} == pytest.approx(want)


def walk_rows(spark):
    rng = random.Random(11)
    rows = []
    for t in range(420):
        for name, group in (("A", "dev"), ("B", "dev"), ("C", "test")):
            x = rng.gauss(0, 1)
            rows.append((name, datetime.date(2020, 1, 1) + datetime.timedelta(days=t), x, float(rng.random() < 1 / (1 + 2.718 ** -x)), group))
    return spark.createDataFrame(rows, "ticker string, date date, ret_1d double, y double, group string")


def test_walk_forward(spark):
    rows = walk_rows(spark)
    f = folds.folds(folds.sessions(rows), 200, 60, 60, 40).cache()
    assert f.count() == 3
    base = walkforward.predict(rows, f)
    m = {(r.model, r.fold): r for r in walkforward.fold_metrics(base).collect()}
    assert len(m) == 9 and all(m["majority", k].roc_auc == 0.5 and m["persistence", k].accuracy > 0.55 for k in range(3))
    learned = walkforward.learn(rows, f.where("fold = 0"), ["ret_1d"], "logistic")
    r = walkforward.fold_metrics(learned).first()
    assert r.roc_auc > 0.65 and not r.is_baseline and r.n == 180 and r.brier_uncalibrated > 0
    held = walkforward.predict(rows, f, train=["dev"], score=["test"])
    assert {x.ticker for x in held.select("ticker").distinct().collect()} == {"C"}
    # What is fitted doesn't see the test window.
    last = f.where("fold = 2").first()
    turned = rows.withColumn("y", F.when(F.col("date") >= last.test_start_date, 1 - F.col("y")).otherwise(F.col("y")))
    probs = lambda df: sorted((x.ticker, x.date, x.model, x.prob, x.threshold) for x in walkforward.predict(df, f.where("fold = 2")).collect())
    assert probs(rows) == probs(turned)
    board = {x.model: x for x in walkforward.leaderboard(walkforward.fold_metrics(base)).collect()}
    assert board["persistence"].folds == 3 and board["persistence"].roc_auc > board["majority"].roc_auc


def test_regimes_keep_the_rows_of_gaps(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, s, (200, 2)) for s in (0.5, 3.0, 0.5, 3.0)])
    rows = spark.createDataFrame([(datetime.date(2020, 1, 1) + datetime.timedelta(days=k), float(a), float(b)) for k, (a, b) in enumerate(x)], "date date, a double, b double")
    f = folds.folds(folds.sessions(rows), 500, 100, 100, 60)
    got = regime.assign_by_fold(rows, f, ["a", "b"], 2).orderBy("date").collect()
    limits = {r.fold: r for r in f.collect()}
    assert len(got) == 100 * len(limits)
    first = [r for r in got if r.fold == 0]
    # By hand: fitted up to the inner window's end, gaps between parts included, and filtered from the first row.
    train = x[: limits[0].inner_end + 1]
    z = (x - train.mean(0)) / train.std(0)
    want = regime.forward_filter(z[:600], *regime.fit_hmm(z[: limits[0].inner_end + 1], 2))[500:]
    assert np.allclose([r.posterior for r in first], want)
    ahead = regime.assign_by_fold(rows, f, ["a", "b"], 2, smoothed=True).count()
    assert ahead == len(got) and regime.assign_by_fold(rows, f, ["a", "b"], 2, least=10_000).count() == 0
    c = {(r.kind, r.n_states): r for r in regime.compare(rows, ["a", "b"], sizes=(2, 3)).collect()}
    assert len(c) == 6 and c["kmeans", 2].bic is None and c["kmeans", 3].holdout_ll is None and c["kmeans", 2].stability > 0.5
    assert c["hmm", 2].bic < c["gmm", 2].bic and c["hmm", 2].plausible and c["hmm", 2].stability > 0.9
    # More starts never score worse, and a fold can be assigned by any kind.
    scores = [regime.fit_kind(kind, z[:300], 3, 17, start)[0] for kind in ("gmm", "kmeans") for start in range(3)]
    assert all(np.isfinite(scores)) and len(set(scores[:3])) > 1
    for kind in ("gmm", "kmeans"):
        rows_ = regime.assign_by_fold(rows, f, ["a", "b"], 2, kind=kind).collect()
        assert len(rows_) == len(got) and all(abs(sum(r.posterior) - 1) < 1e-9 for r in rows_)
    assert regime.agreement(np.array([0, 1, 1]), np.array([1, 0, 0]), 2) == 1


def test_search_is_seeded_and_boosted_learners_learn(spark):
    grid = {"a": [1, 2, 3], "b": [0.1, 0.2]}
    assert models.sampled(grid, 4, 1) == models.sampled(grid, 4, 1) and len(models.sampled(grid, 200)) == 6
    rows = walk_rows(spark)
    fit, score = rows.where("date < date'2020-10-01'"), rows.where("date >= date'2020-10-01'")
    for kind in ("boosted_trees", "boosted_leaves"):
        out = models.fit_predict(fit, score, ["ret_1d"], kind, trees=5).withColumn("all", F.lit(0))
        assert metrics.roc_auc(out, ["all"]).first().roc_auc > 0.6


def test_infinite_scores_are_not_used(spark):
    rows = spark.createDataFrame([(1.0, 0.5), (0.0, float("inf")), (1.0, float("nan")), (None, 0.5), (1.0, None), (0.0, float("-inf"))], "y double, p double")
    assert metrics.usable(rows).count() == 1
