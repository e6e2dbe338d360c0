"""Audits of a panel's causality: what future data may not change, and what a change of scale may not change.

An audit builds the panel twice, from the given relations and from altered ones, and compares them by feature. build(bars, context, sectors) is
any function of DataFrames.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import panel
from tidemark.sources.files import kept

PRICES = ("open", "high", "low", "close", "adj_close")
Build = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def _noise(seed: int, *keys: Column) -> Column:
    """A hash as a number between -1 and 1."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2_000_001)) / 1e6 - 1


def corrupt_after(bars: DataFrame, cutoff, seed: int = 0, drift: float = 0.05, key: str = "ticker") -> DataFrame:
    """bars with another, plausible path of prices after the cutoff, which goes on from the last price before it; the rest stays."""
    w = Window.partitionBy(key).orderBy("date")
    later = F.col("date") > F.lit(cutoff).cast("date")
    shock = F.when(later, drift + 0.05 * _noise(seed, F.col(key), F.col("date"))).otherwise(0.0)
    anchor = F.last(F.when(~later, F.col("close")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    path = F.coalesce(anchor, F.col("close")) * F.exp(F.sum("_shock").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    opened = F.col("_path") * (1 + 0.01 * _noise(seed + 1, F.col(key), F.col("date")))
    new = {"open": opened, "high": F.greatest(opened, F.col("_path")) * 1.01, "low": F.least(opened, F.col("_path")) * 0.99, "close": F.col("_path"), "adj_close": F.col("_path"), "volume": 5e7 + 1e7 * _noise(seed + 2, F.col(key), F.col("date"))}
    made = bars.withColumn("_shock", shock).withColumn("_path", path)
    return made.withColumns({c: F.when(later, x).otherwise(F.col(c)) for c, x in new.items() if c in bars.columns}).drop("_shock", "_path")


def _context_after(context: DataFrame, cutoff, seed: int) -> DataFrame:
    later = F.col("date") > F.lit(cutoff).cast("date")
    return context.withColumns({c: F.when(later, F.col(c) * (1.5 + 0.4 * _noise(seed, F.lit(c), F.col("date")))).otherwise(F.col(c)) for c in ("bench_close", "vix")})


def _at(a: DataFrame, b: DataFrame, columns: list[str], cutoff) -> DataFrame:
    there = F.col("date") == F.lit(cutoff).cast("date")
    return panel.audit(a.where(there), b.where(there), columns).withColumn("cutoff", F.lit(cutoff).cast("date"))


def _whole(build: Build, bars: DataFrame, context: DataFrame, sectors: DataFrame, columns: list[str], cutoffs: list) -> DataFrame:
    """The unaltered panel on the cutoffs, made once."""
    return kept(build(bars, context, sectors).where(F.col("date").isin([datetime.date.fromisoformat(str(c)) for c in cutoffs])).select("ticker", "date", *columns), "audited")


def _all(reports: list[DataFrame]) -> DataFrame:
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out.select("feature", "cutoff", "n_rows", "n_diff")


def perturbation(build: Build, bars: DataFrame, context: DataFrame, sectors: DataFrame, columns: list[str], cutoffs: list) -> DataFrame:
    """By feature and cutoff: instruments compared on that day, and those whose value changes when all data after it do."""
    whole = _whole(build, bars, context, sectors, columns, cutoffs)
    return _all([_at(whole, build(corrupt_after(bars, c), _context_after(context, c, 1), corrupt_after(sectors, c, 3, key="sector")), columns, c) for c in cutoffs])


def truncation(build: Build, bars: DataFrame, context: DataFrame, sectors: DataFrame, columns: list[str], cutoffs: list) -> DataFrame:
    """The same, with the data after the cutoff left out."""
    whole = _whole(build, bars, context, sectors, columns, cutoffs)
    cut = lambda df, c: df.where(F.col("date") <= F.lit(c).cast("date"))
    return _all([_at(whole, build(cut(bars, c), cut(context, c), cut(sectors, c)), columns, c) for c in cutoffs])


def scale(build: Build, bars: DataFrame, context: DataFrame, sectors: DataFrame, columns: list[str], prices: float = 7.0, volumes: float = 3.0) -> DataFrame:
    """By feature: rows compared, and those that change when prices and volumes are multiplied."""
    by = lambda df: df.withColumns({c: F.col(c) * (volumes if c == "volume" else prices) for c in (*PRICES, "volume", "bench_close") if c in df.columns})
    return panel.audit(build(bars, context, sectors), build(by(bars), by(context), by(sectors)), columns, rtol=1e-6, atol=1e-9)


def target_causality(bars: DataFrame, horizon: int, cutoffs: list) -> DataFrame:
    """By cutoff: labels compared, those that change with data beyond the horizon, and those that are the same on a rising and a falling path."""
    w = Window.partitionBy("ticker").orderBy("date")
    label = lambda df, name: df.select("ticker", "date", F.when(F.lead("close", horizon).over(w).isNotNull(), (F.lead("close", horizon).over(w) > F.col("close")).cast("int")).alias(name))
    # The last session that a label of the cutoff may see, by instrument: data after the latest of them are beyond every horizon.
    ahead = bars.select("date", "ticker", F.lead("date", horizon).over(w).alias("reach")).where(F.col("date").isin([datetime.date.fromisoformat(str(c)) for c in cutoffs]))
    ends = {str(r["date"]): r["reach"] for r in ahead.groupBy("date").agg(F.max("reach").alias("reach")).collect()}  # a row a cutoff
    reports = []
    for c in (c for c in map(str, cutoffs) if ends.get(c) is not None):
        day = F.col("date") == F.lit(c).cast("date")
        own, beyond = label(bars, "own").where(day), label(corrupt_after(bars, ends[c], 1), "beyond").where(day)
        up, down = label(corrupt_after(bars, c, 2, 0.2), "up").where(day), label(corrupt_after(bars, c, 2, -0.2), "down").where(day)
        both = own.join(beyond, ["ticker", "date"]).join(up, ["ticker", "date"]).join(down, ["ticker", "date"])
        reports.append(both.groupBy(F.col("date").alias("cutoff")).agg(F.count("*").alias("n_rows"), F.sum((~F.col("own").eqNullSafe(F.col("beyond"))).cast("long")).alias("n_changed"), F.sum(F.col("up").eqNullSafe(F.col("down")).cast("long")).alias("n_deaf")))
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def positions(days: DataFrame, count: int = 6, margin: int = 30, first: int = 300) -> DataFrame:
    """Evenly spaced sessions to audit, from the first that has a whole history to the last that has a future; days(date, pos)."""
    n = days.agg(F.count("*").alias("n")).select((F.col("n") - margin).alias("usable"))
    at = n.select("usable", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"))
    spot = F.when(F.col("usable") <= first, F.greatest(F.lit(0), F.col("usable") - 1)).otherwise(F.floor(first + (F.col("usable") - 1 - first) * F.col("k") / (count - 1)))
    return at.select(spot.cast("long").alias("pos")).distinct().join(days, "pos").select("pos", "date")
