import dataclasses
import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import estimators, panel, registry
from tidemark.operators.registry import Registry, Spec


def relations(spark, n=330):
    rng = random.Random(4)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=k) for k in range(n)]
    rows = []
    for t in ("AX", "AY", "BZ"):
        c = 100.0
        for d in days:
            o, c = c, c * math.exp(rng.gauss(0, 0.02))
            rows.append((t, d, o, max(o, c) * 1.01, min(o, c) * 0.99, c, c, 1e6 * rng.random() + 1))
    bars = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double")
    context = spark.createDataFrame([(d, 50 + rng.random(), 20 + rng.random()) for d in days], "date date, bench_close double, vix double")
    sectors = spark.createDataFrame([(s, d, 30 + rng.random()) for s in "AB" for d in days], "sector string, date date, close double")
    return bars, context, sectors


def test_declarations(spark):
    r = registry.declared()
    assert sorted(r.specs) == sorted(panel.feature_names()) and len(r.specs) == 58
    assert r.warm_up(r.chosen()) == panel.WARM_UP and r.warm_up(r.chosen(["volume"])) == 21 and r.warm_up([]) == 0
    assert r.table(spark, r.chosen(["trend"])).count() == 4
    with pytest.raises(ValueError, match="scale"):
        r.add(Spec("close_itself", "price", 1, scale_free=False))
    with pytest.raises(ValueError, match="duplicate"):
        Registry([Spec("a", "g", 1), dataclasses.replace(Spec("a", "g", 2))])
    with pytest.raises(KeyError, match="astrology"):
        r.chosen(["astrology"])


def test_groups_plan_their_own_windows_alone(spark):
    bars, context, sectors = relations(spark)
    whole = panel.build(bars, context, sectors)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for groups in (["volume"], ["trend", "calendar"], ["momentum"], ["market"]):
        own = registry.build(bars, context, sectors, groups, drop_warm_up=False)
        names = own.columns[2:]
        audit = panel.audit(own.join(whole.select("ticker", "date"), ["ticker", "date"]), whole, names).collect()
        assert len(audit) == len(names) and all(r.n_diff == 0 and r.n_rows > 0 for r in audit)
        text = plan(own)
        assert ("Join" in text) == (groups == ["market"]) and text.count("Window") < plan(whole).count("Window")
    assert "_ends" not in plan(registry.build(bars, context, sectors, ["volume"]))
    assert registry.build(bars, context, sectors, ["volume"]).count() == 3 * (330 - 21)
    assert registry.build(bars, context, sectors, names=["ret_3d"]).count() == 3 * (330 - 4)


@pytest.mark.parametrize("kind,params", [("logistic", {}), ("boosted_leaves", {"trees": 3, "least_rows": 10})])
def test_models_are_stored_and_serve(spark, tmp_path, kind, params):
    rng = random.Random(6)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=k) for k in range(220)]
    rows = [(t, d, x := rng.gauss(0, 1), None if rng.random() < 0.1 else rng.random(), float(rng.random() < 1 / (1 + math.exp(-2 * x)))) for d in days for t in "ABCD"]
    df = spark.createDataFrame(rows, "ticker string, date date, a double, b double, y double")
    parts = estimators.serving_parts(df, inner=60)
    assert parts.where("part = 'fit'").select("date").distinct().count() == 220 - 60 - 6
    model = estimators.serve(df, ["a", "b"], str(tmp_path), kind, "v1", **params)
    scored = lambda m: sorted((r.ticker, r.date, r.prob_raw, r.prob, r.flagged) for r in m.transform(df).collect())
    again = estimators.PanelModel.load(str(tmp_path / f"{kind}-v1-2020-08-07"))
    assert scored(model) == scored(again) and again.card == model.card and again.card["n_fit"] == 4 * (220 - 120 - 6)
    assert estimators.usable(again.card, "v1", "2020-08-07") and not estimators.usable(again.card, "v2", "2020-08-07")
    served = estimators.serve(df, ["a", "b"], str(tmp_path), kind, "v1", **params)  # from the store
    assert served.card == model.card and 0.05 <= served.card["threshold"] <= 0.95
    up = model.transform(df).groupBy("y").agg(F.avg("prob").alias("p")).orderBy("y").collect()
    assert up[1].p > up[0].p + 0.05
