import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import audit, panel
from tidemark.operators import bars as B


def series(spark, closes, ticker="AA"):
    day = datetime.date(2020, 1, 1)
    rows = [(ticker, day + datetime.timedelta(days=k), float(c), c * 1.02, c * 0.98, float(c), float(c), 100.0 + 10 * (k % 7)) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double")


def walk(n, seed):
    rng, c, out = random.Random(seed), 100.0, []
    for _ in range(n):
        c *= math.exp(rng.gauss(0, 0.02))
        out.append(c)
    return out


@pytest.fixture(scope="module")
def two(spark):
    return series(spark, walk(320, 1), "AA").unionByName(series(spark, walk(320, 2), "BB")).cache()


def last(df, column):
    return df.orderBy("date").select(column).collect()[-1][0]


def test_rising_and_straight_series(spark):
    rising = series(spark, [100 + k for k in range(60)])
    assert last(panel.with_means(panel.with_returns(rising)), "rsi_14") == 100
    flat = panel.with_returns(rising).select("date", I.efficiency_ratio(F.col("close"), 20, F.col("step")).alias("e"))
    assert last(flat, "e") == pytest.approx(1)
    there_and_back = series(spark, [100 + min(k, 40 - k) for k in range(41)])
    back = panel.with_returns(there_and_back).select("date", I.efficiency_ratio(F.col("close"), 40, F.col("step")).alias("e"))
    assert last(back, "e") == pytest.approx(0)
    assert last(panel.with_means(panel.with_returns(series(spark, [50.0] * 40))), "rsi_14") == 100


def test_exponential_mean_matches_the_recursion(spark):
    closes = walk(300, 3)
    got = [r[1] for r in I.with_ewm(series(spark, closes), e=I.ema(F.col("close"), 12)).select("date", "e").orderBy("date").collect()]
    a, y, want = 2 / 13, closes[0], [closes[0]]
    for x in closes[1:]:
        y = (1 - a) * y + a * x
        want.append(y)
    assert got[:11] == [None] * 11 and got[11:] == pytest.approx(want[11:], rel=1e-12)


def test_beta_of_the_benchmark_is_one_and_constants_have_no_correlation(two):
    r = panel.with_returns(two).withColumn("one", F.lit(1.0))
    row = r.select("date", I.beta(F.col("ret_1d"), F.col("ret_1d") * 2, 60).alias("b"), I.corr(F.col("ret_1d"), F.col("one"), 20).alias("c")).orderBy(F.desc("date")).first()
    assert row.b == pytest.approx(0.5) and row.c is None


def test_zero_return_is_down_and_the_last_rows_have_no_label(spark):
    b = series(spark, [10, 10, 11, 10])
    ctx = b.select("date", F.col("close").alias("bench_close"))
    t = [tuple(r) for r in panel.targets(b, ctx, (1,)).orderBy("date").select("direction_1d", "fwd_excess_ret_1d", "excess_direction_1d").collect()]
    assert [x[0] for x in t] == [0, 1, 0, None] and [x[1] for x in t] == [0, 0, 0, None]


def wide(b):
    r = panel.with_returns(b)
    cols = panel.returns() | panel.momentum() | panel.volatility() | panel.volume() | panel.trend() | panel.calendar()
    f = r.select("ticker", "date", *(c.alias(n) for n, c in cols.items()))
    o = panel.with_means(r).select("ticker", "date", "rsi_14")
    return f.join(o, ["ticker", "date"]), [*cols, "rsi_14"]


def test_features_do_not_see_the_future(two):
    full, names = wide(two)
    cutoff = two.agg(F.max("date")).first()[0] - datetime.timedelta(days=40)
    cut, _ = wide(two.where(F.col("date") <= cutoff))
    broken, _ = wide(two.withColumns({c: F.when(F.col("date") > cutoff, F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")}).where(F.col("date") <= datetime.date(2030, 1, 1)))
    for other in (cut, broken.where(F.col("date") <= cutoff)):
        found = panel.audit(full, other, names).collect()
        assert len(found) == len(names) and all(r.n_diff == 0 and r.n_rows > 0 for r in found)


def test_features_are_free_of_scale(two):
    full, names = wide(two)
    scaled, _ = wide(two.withColumns({**{c: F.col(c) * 7 for c in ("open", "high", "low", "close", "adj_close")}, "volume": F.col("volume") * 3}))
    assert {r.feature for r in panel.audit(full, scaled, names, rtol=1e-6, atol=1e-9).collect() if r.n_diff} == set()


def test_the_audit_finds_a_planted_leak(two):
    ahead = two.select("ticker", "date", I.lead(F.col("close")).alias("x"))
    cutoff = two.agg(F.max("date")).first()[0] - datetime.timedelta(days=10)
    cut = two.where(F.col("date") <= cutoff).select("ticker", "date", I.lead(F.col("close")).alias("x"))
    assert panel.audit(ahead, cut, ["x"]).first().n_diff == 2


def test_cleaning(spark):
    b = series(spark, [10, 11, 12])
    assert B.upsert(b, b.limit(1).withColumn("close", F.lit(99.0)), ["ticker", "date"]).where("close = 99").count() == 1
    assert [r[0] for r in spark.createDataFrame([(" ^spx ",), ("brk.b",), ("1a",), ("A" * 17,), (None,)], "s string").select(B.normalise_symbol(F.col("s"))).collect()] == ["^SPX", "BRK.B", None, None, None]
    half = b.withColumn("adj_close", F.when(F.col("date") == datetime.date(2020, 1, 2), F.lit(None)).otherwise(F.col("close") / 2))
    assert [r.adj_factor for r in B.adjust(half).orderBy("date").collect()] == [0.5, 0.5, 0.5]
    bad = b.withColumn("low", F.when(F.col("date") == datetime.date(2020, 1, 2), 50.0).otherwise(F.col("low")))
    checked = B.validate(bad, B.weekdays(bad)).first()
    assert checked.inverted == 1 and checked.status == "error"


def test_validation_finds_each_fault(spark):
    b = series(spark, walk(500, 7)).where(F.weekday("date") < 5)
    days = B.weekdays(b)
    day = lambda k: F.col("date") == datetime.date(2020, 1, 1) + datetime.timedelta(days=k)
    assert B.validate(b, days).first().status == "error"  # fewer than 400 rows
    long = series(spark, walk(700, 7)).where(F.weekday("date") < 5)
    days = B.weekdays(long)
    assert B.validate(long, days).first().status == "ok"
    holed = long.withColumn("close", F.when(day(5), None).otherwise(F.col("close"))).withColumn("volume", F.lit(0.0)).where(~day(6))
    r = B.validate(holed, days).first()
    assert (r.some_prices, r.no_prices, r.missing, r.zero_volume, r.stale, r.status) == (1, 0, 1, 1.0, 0, "warning")
    index = holed.withColumn("ticker", F.lit("^AA")).where(~day(5)).unionByName(long.where(day(6) | day(5)))
    assert B.validate(index.where("ticker = '^AA'"), days).first().missing == 2
    stale = B.validate(long.where(F.col("date") < datetime.date(2021, 11, 1)), days).first()
    assert stale.stale == days.where(F.col("date") >= datetime.date(2021, 11, 1)).count() and stale.missing == 0
    holidays = spark.createDataFrame([(datetime.date(2020, 1, 7),)], "date date")
    assert B.validate(long, B.weekdays(long, holidays)).first().unexpected == 1


def context(spark, n, seed):
    return series(spark, walk(n, seed)).select("date", F.col("close").alias("bench_close"), F.lit(20.0).alias("vix")), series(spark, walk(n, seed + 1), "A").withColumnRenamed("ticker", "sector")


def test_audits_pass_causal_features_and_find_leaks(spark, two):
    bench, sect = context(spark, 320, 5)
    build = lambda b, c, s: panel.with_returns(panel.with_context(b, c, s)).select("ticker", "date", "ret_1d", I.log_return(F.col("bench_close"), 5).alias("bench_ret_5d"), I.lead(F.col("close")).alias("leak"), "close")
    cutoff = [datetime.date(2020, 10, 1)]
    for report in (audit.perturbation(build, two, bench, sect, ["ret_1d", "bench_ret_5d", "leak"], cutoff), audit.truncation(build, two, bench, sect, ["ret_1d", "bench_ret_5d", "leak"], cutoff)):
        assert {r.feature: (r.n_rows, r.n_diff) for r in report.collect()} == {"ret_1d": (2, 0), "bench_ret_5d": (2, 0), "leak": (2, 2)}
    assert {r.feature: r.n_diff > 0 for r in audit.scale(build, two, bench, sect, ["ret_1d", "close"]).collect()} == {"ret_1d": False, "close": True}
    r = audit.target_causality(two, 5, cutoff).first()
    assert (r.n_rows, r.n_changed, r.n_deaf) == (2, 0, 0)


def test_the_panel_has_every_feature(spark, two):
    bench, sect = context(spark, 320, 5)
    groups = spark.createDataFrame([("AA", "dev", "tech")], "ticker string, group string, sector string")
    p = panel.tagged(panel.build(two, bench, sect), groups)
    features = [c for c in p.columns if c not in {"ticker", "date", "group", "sector", "ewma_sigma", *panel.label_columns()}]
    assert len(features) == 58 and p.count() == 2 * (320 - panel.WARM_UP)
    assert {(r.ticker, r.group, r.sector) for r in p.collect()} == {("AA", "dev", "tech"), ("BB", "unassigned", "unknown")}
    assert panel.labelled(p, "direction_5d").count() == p.count() - 10
    with pytest.raises(KeyError):
        panel.labelled(p, "direction_9d")


def test_band_is_fitted_apart_from_the_rows_it_labels(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([("A", k, rng.gauss(0, 0.02), 0.02) for k in range(3000)] + [("B", 1, 0.01, 0.02)], "ticker string, k int, ret double, sigma double")
    band = panel.kappa(rows.where("k < 2000 and ticker = 'A'"), 1)
    labels = panel.ternary(rows.where("k >= 2000 or ticker = 'B'"), band, 1)
    assert 0.28 < labels.where("ticker = 'A'").agg(F.avg((F.col("label") == 0).cast("int"))).first()[0] < 0.38
    assert labels.where("ticker = 'B'").first().label is None


def test_bars_merged_from_one_pass_are_those_of_the_trades(spark):
    rng = random.Random(8)
    rows = [(rng.choice("AN"), rng.choice(["F", "O", None]), rng.choice([datetime.date(2020, 1, k) for k in (1, 2, 3)] + [None]), rng.choice([None, 1, 2, 3, 4]), rng.randrange(2), rng.randrange(3), 1, float(rng.randrange(1, 9)), float(rng.randrange(100, 999))) for _ in range(400)]
    lines = spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_shipdate date, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double")
    trades = B.ticks(lines)
    fine = B.fine_bars(trades)
    same = lambda a, b: sorted(map(str, (r.asDict() for r in a.collect()))) == sorted(map(str, (r.asDict() for r in b.select(*a.columns).collect())))
    for key in ("ticker", "sector"):
        assert same(B.to_bars(trades, key, "date"), B.merged(fine, key, "date"))
    at = lambda df: {r.date: (r.bench_close, None if r.vix is None else round(r.vix, 9)) for r in df.collect()}
    assert at(B.market_context(trades)) == at(B.merged_context(fine, trades))
