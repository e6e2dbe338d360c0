"""Cost-aware simulation of equal weights on signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import ordered


def weights(book: DataFrame, threshold: float = 0.5) -> DataFrame:
    """date, ticker, ret and weight of every row of book(date, ticker, p, ret). A date on which an instrument has no row counts as weight zero."""
    signal = F.when(F.col("p") >= threshold, 1.0).otherwise(0.0)
    total = F.sum("signal").over(Window.partitionBy("date"))
    return book.withColumn("signal", signal).select("date", "ticker", F.coalesce("ret", F.lit(0.0)).alias("ret"), F.coalesce(F.try_divide(F.col("signal"), total), F.lit(0.0)).alias("weight"))


def changes(w: DataFrame) -> DataFrame:
    """date and change of each change of weight: on a row's own date, and on the next date of the book where the instrument has no row there."""
    dates = w.select("date").distinct().withColumn("after", F.lead("date").over(Window.orderBy("date")))  # one row a date
    rows = w.join(dates, "date")
    own = ordered()
    held = F.when(F.lag("after").over(own) == F.col("date"), F.lag("weight").over(own)).otherwise(0.0)
    gone = F.col("after").isNotNull() & ~F.coalesce(F.lead("date").over(own) == F.col("after"), F.lit(False))
    both = rows.select(F.array(F.struct("date", F.abs(F.col("weight") - held).alias("change")), F.struct(F.when(gone, F.col("after")).alias("date"), F.col("weight").alias("change"))).alias("x"))
    return both.select(F.explode("x").alias("x")).select("x.*").where("date is not null")


def simulate(w: DataFrame, bps: float | Column = 5.0) -> DataFrame:
    """date, gross, traded, positions and net: costs per side of each change of weight."""
    cost = bps if isinstance(bps, Column) else F.lit(float(bps))
    days = w.groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"), F.sum((F.col("weight") > 0).cast("long")).alias("positions"))
    traded = changes(w).groupBy("date").agg(F.sum("change").alias("traded"))
    return days.join(traded, "date").select("date", "gross", "traded", "positions", (F.col("gross") - F.col("traded") * cost * 1e-4).alias("net"))


def equity(days: DataFrame, value: str = "net", keys: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative product and drawdown by date. One row a date and key."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = days.withColumn("equity", F.exp(F.sum(F.log1p(value)).over(w)))
    return curve.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def summary(days: DataFrame, value: str = "net", keys: tuple[str, ...] = ()) -> DataFrame:
    r = F.col(value)
    vol = F.stddev_samp(r) * F.sqrt(F.lit(252.0))
    return equity(days, value, keys).groupBy(*keys).agg(
        (F.avg(r) * 252).alias("annual_return"), vol.alias("annual_vol"), F.coalesce(F.try_divide(F.avg(r) * 252, vol), F.lit(0.0)).alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("hit_rate"), F.avg("traded").alias("turnover"), F.avg("positions").alias("mean_positions"),
    )


def cost_sweep(days: DataFrame, costs: tuple[float, ...] = (0, 5, 10, 20)) -> DataFrame:
    each = days.select("date", "gross", "traded", "positions", F.explode(F.array(*(F.lit(float(c)) for c in costs))).alias("bps")).withColumn("net", F.col("gross") - F.col("traded") * F.col("bps") * 1e-4)
    return summary(each, "net", ("bps",))


def break_even(days: DataFrame) -> DataFrame:
    """Costs per side at which the mean return is gone; 0 where it isn't positive."""
    return days.agg(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.avg("gross"), F.avg("traded") * 1e-4), F.lit(0.0))).alias("break_even_bps"))


def buy_and_hold(book: DataFrame) -> DataFrame:
    return book.groupBy("date").agg(F.avg("ret").alias("ret"))
