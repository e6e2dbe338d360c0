"""The features' declarations, and panels of some groups of them.

A spec tells a feature's group, the rows that its value looks back on, the columns that it is made from and whether it is free of scale (only
such features may be pooled over instruments). From the specs follow the warm-up of a choice of features, and the steps that a panel of
some groups needs: what no chosen feature depends on is neither joined nor computed.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import panel

BAR, MEANS, CONTEXT = ("open", "high", "low", "close", "volume"), ("rsi_14", "macd_line", "macd_hist", "atr_14"), ("bench_close", "vix", "sector_close")


@dataclasses.dataclass(frozen=True)
class Spec:
    name: str
    group: str
    lookback: int
    inputs: tuple[str, ...] = ("close",)
    scale_free: bool = True


class Registry:
    def __init__(self, specs: list[Spec] | None = None):
        self.specs: dict[str, Spec] = {}
        for s in specs or []:
            self.add(s)

    def add(self, spec: Spec) -> None:
        if spec.name in self.specs:
            raise ValueError(f"duplicate feature name: {spec.name}")
        if not spec.scale_free:
            raise ValueError(f"not free of scale, so it can't be pooled: {spec.name}")
        self.specs[spec.name] = spec

    def chosen(self, groups: list[str] | None = None, names: list[str] | None = None) -> list[Spec]:
        """The specs of some groups or names, all by default, in the order in which they were declared."""
        for asked, known in ((groups, {s.group for s in self.specs.values()}), (names, self.specs)):
            if asked is not None and set(asked) - set(known):
                raise KeyError(f"not declared: {sorted(set(asked) - set(known))}")
        return [s for s in self.specs.values() if (groups is None or s.group in groups) and (names is None or s.name in names)]

    def warm_up(self, specs: list[Spec]) -> int:
        return max((s.lookback for s in specs), default=0)

    def inputs(self, specs: list[Spec]) -> set[str]:
        return {x for s in specs for x in s.inputs}

    def table(self, spark, specs: list[Spec] | None = None) -> DataFrame:
        return spark.createDataFrame([(s.name, s.group, s.lookback, list(s.inputs), s.scale_free) for s in specs or self.chosen()], "feature string, `group` string, lookback int, inputs array<string>, scale_free boolean")


def declared() -> Registry:
    """All 58 features."""
    spec = lambda group, inputs=("close",), **lookbacks: [Spec(n, group, k, inputs) for n, k in lookbacks.items()]
    out = [Spec(f"ret_{n}d", "price", n + 1) for n in (1, 3, 5, 10, 20)] + [Spec(f"ret_1d_lag{k}", "price", k + 2) for k in range(1, 6)]
    out += spec("momentum", **{f"px_to_sma_{n}": n for n in (10, 20, 50, 200)}, sma_ratio_20_50=50, sma_ratio_50_200=200, mom_12_1=253, price_position_252=252)
    out += [Spec("rsi_14", "momentum", 42, ("close", "rsi_14")), Spec("macd_norm", "momentum", 78, ("close", "macd_line")), Spec("macd_hist_norm", "momentum", 87, ("close", "macd_hist"))]
    out += spec("volatility", **{f"vol_{n}": n + 1 for n in (5, 20, 60)}, vol_ratio_5_20=21, vol_ratio_20_60=61, downside_vol_ratio_20=21, standardised_move=21)
    out += [Spec("parkinson_vol_20", "volatility", 20, ("high", "low")), Spec("atr_14_norm", "volatility", 42, ("close", "atr_14"))]
    out += spec("volume", ("close", "volume"), rel_volume_20=20, volume_z_20=20, dollar_volume_ratio_20=20, price_volume_corr_20=21)
    out += spec("trend", efficiency_ratio_20=21, dist_high_252=252, dist_low_252=252, up_day_ratio_20=21)
    out += spec("market", ("close", "bench_close"), bench_ret_1d=2, bench_ret_5d=6, bench_ret_20d=21, bench_vol_20=21, bench_px_to_sma_50=50, beta_60=61, corr_bench_60=61, resid_ret_5d=61)
    out += spec("market", ("vix",), vix_level=1, vix_z_60=60, vix_chg_5d=6) + spec("market", ("close", "sector_close"), sector_ret_5d=6, rel_sector_ret_5d=6)
    return Registry(out + spec("calendar", ("date",), **dict.fromkeys(panel.calendar(), 1)))


def build(bars: DataFrame, context: DataFrame, sectors: DataFrame, groups: list[str] | None = None, names: list[str] | None = None, registry: Registry | None = None, drop_warm_up: bool = True) -> DataFrame:
    """ticker, date and the chosen features, without the rows of their own warm-up."""
    registry = registry or declared()
    specs = registry.chosen(groups, names)
    needs = registry.inputs(specs)
    rows = bars
    if needs & set(CONTEXT):
        rows = panel.with_context(rows, context, sectors)
    rows = panel.with_returns(rows)
    if needs & set(MEANS):
        rows = panel.with_means(rows)
    if needs & set(CONTEXT):
        rows = panel.market(rows)
    made = panel.returns() | panel.momentum() | panel.volatility() | panel.volume() | panel.trend() | panel.calendar() | (panel.means() if needs & set(MEANS) else {})
    columns = [made[s.name].alias(s.name) if s.name in made else F.col(s.name) for s in specs]
    if not drop_warm_up:
        return rows.select("ticker", "date", *columns)
    return rows.select("ticker", "date", *columns, F.row_number().over(I.ordered()).alias("_row")).where(F.col("_row") > registry.warm_up(specs)).drop("_row")
