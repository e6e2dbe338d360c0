"""Features, labels and the panel that joins them: context is joined by date first, then one shuffle by instrument serves all windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as I

WARM_UP = 253
DECAY = 0.94


def with_context(bars: DataFrame, context: DataFrame, sectors: DataFrame, limit: int = 3) -> DataFrame:
    """Benchmark, volatility and sector closes on an instrument's own days; gaps take the last of the `limit` rows before."""
    joined = matched(bars, context.select("date", "bench_close", "vix"), sectors)
    filled = I.ordered().rowsBetween(-limit, 0)
    return joined.select(*bars.columns, "sector", *(F.last(c, True).over(filled).alias(c) for c in ("bench_close", "vix", "sector_close")))


def matched(bars: DataFrame, context: DataFrame, sectors: DataFrame) -> DataFrame:
    """bars with the context of the same date, null where there is none."""
    s = sectors.select(F.col("sector"), "date", F.col("close").alias("sector_close"))
    return bars.withColumn("sector", F.substring("ticker", 1, 1)).join(context, "date", "left").join(s, ["sector", "date"], "left")


def staleness(bars: DataFrame, context: DataFrame, sectors: DataFrame) -> DataFrame:
    """By instrument: rows without a context of their own date, before any gap is filled."""
    gaps = lambda c: F.sum(F.col(c).isNull().cast("long"))
    return matched(bars, context, sectors).groupBy("ticker").agg(gaps("bench_close").alias("gaps"), gaps("vix").alias("vix_gaps"), gaps("sector_close").alias("sector_gaps"))


def with_returns(bars: DataFrame) -> DataFrame:
    """The columns that several groups build on."""
    c, v = F.col("close"), F.when(F.col("volume") > 0, F.col("volume"))
    return bars.withColumns({"ret_1d": I.log_return(c), "vol_pos": v, "tr": I.true_range(F.col("high"), F.col("low"), c), "step": F.abs(c - I.lag(c))})


def returns() -> dict[str, Column]:
    c = F.col("close")
    return {f"ret_{n}d": I.log_return(c, n) for n in (1, 3, 5, 10, 20)} | {f"ret_1d_lag{k}": I.lag(F.col("ret_1d"), k) for k in range(1, 6)}


def momentum() -> dict[str, Column]:
    """Moving averages and what needs a single pass; for rsi and macd see with_means."""
    c = F.col("close")
    out = {f"px_to_sma_{n}": I.ratio(c, I.sma(c, n)) - 1 for n in (10, 20, 50, 200)}
    out |= {"sma_ratio_20_50": I.ratio(I.sma(c, 20), I.sma(c, 50)) - 1, "sma_ratio_50_200": I.ratio(I.sma(c, 50), I.sma(c, 200)) - 1}
    return out | {"mom_12_1": F.ln(I.ratio(I.lag(c, 21), I.lag(c, 252))), "price_position_252": I.price_position(c, 252)}


def with_means(rows: DataFrame) -> DataFrame:
    """All exponential means that the features need (rows from with_returns), in one pass, and what follows from them.

    Adds rsi_14 (0 to 100), macd_line, macd_signal, macd_hist, atr_14 and ewma_sigma, the causal volatility of a day.
    """
    c, r = F.col("close"), F.col("ret_1d")
    change = c - I.lag(c)
    moves = rows.withColumns({"_up": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "_down": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))})
    first = I.with_ewm(moves, _g=I.wilder(F.col("_up"), 14), _l=I.wilder(F.col("_down"), 14), _fast=I.ema(c, 12), _slow=I.ema(c, 26), atr_14=I.wilder(F.col("tr"), 14), ewma_sigma=(r * r, 1 - DECAY, 60))
    line = first.withColumns({
        "rsi_14": F.when(F.col("_g").isNotNull(), F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + I.ratio(F.col("_g"), F.col("_l"))))),
        "macd_line": F.col("_fast") - F.col("_slow"), "ewma_sigma": F.sqrt("ewma_sigma"),
    })
    # The signal is a mean of the line, which starts late: a fold of the same kind, over rows that are already together and in order.
    second = I.with_ewm(line, macd_signal=(F.col("macd_line"), 0.2, 9))
    return second.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal")).drop("_up", "_down", "_g", "_l", "_fast", "_slow")


def means() -> dict[str, Column]:
    """Features that with_means makes possible."""
    c = F.col("close")
    return {"rsi_14": F.col("rsi_14") / 100, "macd_norm": I.ratio(F.col("macd_line"), c), "macd_hist_norm": I.ratio(F.col("macd_hist"), c), "atr_14_norm": I.ratio(F.col("atr_14"), c)}


def volatility() -> dict[str, Column]:
    r = F.col("ret_1d")
    vol = {n: I.realised_volatility(r, n) for n in (5, 20, 60)}
    out = {f"vol_{n}": v for n, v in vol.items()}
    out |= {"vol_ratio_5_20": I.ratio(vol[5], vol[20]), "vol_ratio_20_60": I.ratio(vol[20], vol[60])}
    out |= {"parkinson_vol_20": I.parkinson(F.col("high"), F.col("low"), 20), "downside_vol_ratio_20": I.ratio(I.realised_volatility(I.downside(r), 20), vol[20])}
    return out | {"standardised_move": I.ratio(r, I.std(r, 20))}


def volume() -> dict[str, Column]:
    v = F.col("vol_pos")
    money = F.col("close") * v
    return {"rel_volume_20": I.ratio(v, I.sma(v, 20)), "volume_z_20": I.zscore(v, 20), "dollar_volume_ratio_20": I.ratio(money, I.sma(money, 20)), "price_volume_corr_20": I.corr(F.col("ret_1d"), v, 20)}


def trend() -> dict[str, Column]:
    c = F.col("close")
    up = F.when(F.col("ret_1d") > 0, 1.0).otherwise(0.0)
    return {"efficiency_ratio_20": I.efficiency_ratio(c, 20, F.col("step")), "dist_high_252": I.ratio(c, I.rolling_max(c, 252)) - 1, "dist_low_252": I.ratio(c, I.rolling_min(c, 252)) - 1, "up_day_ratio_20": I.gate(F.avg(up).over(I.trailing(20)), up, 20)}


def market(bars: DataFrame) -> DataFrame:
    """bars with context; adds the market features, the benchmark's return first."""
    b, v, s, c = F.col("bench_close"), F.col("vix"), F.col("sector_close"), F.col("close")
    one = bars.withColumn("bench_ret_1d", I.log_return(b))
    m, r = F.col("bench_ret_1d"), F.col("ret_1d")
    two = one.withColumns({
        "bench_ret_5d": I.log_return(b, 5), "bench_ret_20d": I.log_return(b, 20), "bench_vol_20": I.realised_volatility(m, 20), "bench_px_to_sma_50": I.ratio(b, I.sma(b, 50)) - 1,
        "beta_60": I.beta(r, m, 60), "corr_bench_60": I.corr(r, m, 60), "vix_level": v, "vix_z_60": I.zscore(v, 60), "vix_chg_5d": I.log_return(v, 5), "sector_ret_5d": I.log_return(s, 5), "_ret_5d": I.log_return(c, 5),
    })
    return two.withColumns({"resid_ret_5d": F.col("_ret_5d") - F.col("beta_60") * F.col("bench_ret_5d"), "rel_sector_ret_5d": F.col("_ret_5d") - F.col("sector_ret_5d")}).drop("_ret_5d")


MARKET = ("bench_ret_1d", "bench_ret_5d", "bench_ret_20d", "bench_vol_20", "bench_px_to_sma_50", "beta_60", "corr_bench_60", "resid_ret_5d", "vix_level", "vix_z_60", "vix_chg_5d", "sector_ret_5d", "rel_sector_ret_5d")


def calendar() -> dict[str, Column]:
    d = F.col("date")
    out = {f"dow_{name}": (F.weekday(d) == k).cast("double") for k, name in enumerate(("tue", "wed", "thu", "fri"), 1)}
    turn = 2 * math.pi / 12 * F.month(d)
    return out | {"month_sin": F.sin(turn), "month_cos": F.cos(turn), "days_to_month_end": F.datediff(F.last_day(d), d) / F.lit(31.0)}


def with_forward(bars: DataFrame, context: DataFrame, horizons: tuple[int, ...] = (1, 5)) -> DataFrame:
    """bars with _b<h>, the benchmark's forward returns over its own days."""
    w = Window.orderBy("date")  # one row a date
    return bars.join(context.select("date", *((F.try_divide(F.lead("bench_close", h).over(w), F.col("bench_close")) - 1).alias(f"_b{h}") for h in horizons)), "date", "left")


def targets(bars: DataFrame, context: DataFrame, horizons: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Forward returns, directions and excess over the benchmark (whose forward returns are over its own days)."""
    c, o = F.col("close"), F.col("open")
    own = bars if {f"_b{h}" for h in horizons} <= set(bars.columns) else with_forward(bars, context, horizons)
    cols: dict[str, Column] = {}
    for h in horizons:
        cols |= {f"fwd_ret_{h}d": I.ratio(I.lead(c, h), c) - 1, f"fwd_ret_open_{h}d": I.ratio(I.lead(c, h), I.lead(o, 1)) - 1}
    first = own.withColumns(cols)
    more: dict[str, Column] = {}
    for h in horizons:
        r, ro = F.col(f"fwd_ret_{h}d"), F.col(f"fwd_ret_open_{h}d")
        more |= {f"direction_{h}d": I.direction(r), f"direction_open_{h}d": I.direction(ro), f"fwd_excess_ret_{h}d": r - F.col(f"_b{h}"), f"excess_direction_{h}d": I.direction(r - F.col(f"_b{h}"))}
    return first.withColumns(more).drop(*(f"_b{h}" for h in horizons))


#: The groups of instruments that are fitted on, and those held out.
GROUPS = {"AF": "dev", "AO": "dev", "NF": "dev", "NO": "val", "RF": "test", "RO": "test"}


def tagged(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the group and sector of groups(ticker, group, sector): "unassigned" and "unknown" where there is none."""
    return rows.drop("group", "sector").join(groups, "ticker", "left").fillna({"group": "unassigned", "sector": "unknown"})


def build(bars: DataFrame, context: DataFrame, sectors: DataFrame, horizons: tuple[int, ...] = (1, 5), warm_up: int = WARM_UP) -> DataFrame:
    """The whole panel: every feature of the seven groups and every label, by instrument and date, without the warm-up rows.

    What is known by date is joined before; then bars are shuffled by instrument once, and all windows and exponential means keep that partitioning.
    """
    rows = market(with_means(with_returns(with_context(with_forward(bars, context, horizons), context, sectors))))
    features = returns() | momentum() | means() | volatility() | volume() | trend() | calendar()
    wide = rows.withColumn("_row", F.row_number().over(I.ordered())).select("*", *(x.alias(n if n != "rsi_14" else "_rsi") for n, x in features.items() if n not in rows.columns or n == "rsi_14"))
    labelled = targets(wide, context, horizons).where(F.col("_row") > warm_up).drop("rsi_14").withColumnRenamed("_rsi", "rsi_14")
    return labelled.select("ticker", "date", *feature_names(), *label_columns(horizons), "ewma_sigma", "sector")


def feature_names() -> list[str]:
    return [*returns(), *momentum(), *means(), *volatility(), *volume(), *trend(), *calendar(), *MARKET]


def label_columns(horizons: tuple[int, ...] = (1, 5)) -> list[str]:
    return [f"{n}_{h}d" for h in horizons for n in ("fwd_ret", "fwd_ret_open", "direction", "direction_open", "fwd_excess_ret", "excess_direction")]


def labelled(panel: DataFrame, label: str) -> DataFrame:
    """Rows that have the label; a label that the panel doesn't know is an error."""
    if label not in panel.columns:
        raise KeyError(f"unknown label: {label}")
    return panel.where(F.col(label).isNotNull())


def kappa(rows: DataFrame, horizon: int, share: float = 1 / 3, limits: tuple[float, float] = (0.05, 1.5)) -> DataFrame:
    """By instrument: the band, in volatilities of the horizon, that holds a share of the returns; rows(ticker, ret, sigma) of a fit window."""
    k = F.percentile(F.abs("ret") / (F.col("sigma") * math.sqrt(horizon)), F.lit(share))
    return rows.where("ret is not null and sigma is not null").groupBy("ticker").agg(F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), k)).alias("kappa"))


def ternary(rows: DataFrame, bands: DataFrame, horizon: int) -> DataFrame:
    """rows(ticker, ret, sigma) with label -1, 0 or 1 by a band fitted elsewhere; null where return, volatility or band is missing."""
    band = F.col("kappa") * F.col("sigma") * math.sqrt(horizon)
    label = F.when(F.col("ret").isNull() | band.isNull(), F.lit(None)).when(F.col("ret") > band, 1).when(F.col("ret") < -band, -1).otherwise(0)
    return rows.join(bands, "ticker", "left").withColumn("label", label.cast("long")).drop("kappa")


def drop_warm_up(panel: DataFrame, rows: int = WARM_UP) -> DataFrame:
    return panel.withColumn("_row", F.row_number().over(I.ordered())).where(F.col("_row") > rows).drop("_row")


def audit(a: DataFrame, b: DataFrame, columns: list[str], keys: tuple[str, ...] = ("ticker", "date"), rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """By column: shared rows, and those of them in which two builds of a panel differ (a null equals a null)."""
    both = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in columns)).join(b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in columns)), list(keys))
    off = lambda x, y: ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False)))
    long = both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), off(F.col(f"a_{c}"), F.col(f"b_{c}")).alias("off")) for c in columns))).alias("x"))
    return long.groupBy("x.feature").agg(F.count("*").alias("n_rows"), F.sum(F.col("x.off").cast("long")).alias("n_diff"))
