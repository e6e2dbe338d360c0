"""The relations that the registered queries start from, derived from the star schema's order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import indicators as I
from tidemark.operators import bars as B
from tidemark.operators import folds, models, panel
from tidemark.sources.files import table

FOLD = 400  # sessions to a fold of the deterministic predictions


def trades(spark: SparkSession, d: str) -> DataFrame:
    return B.ticks(table(spark, d, "lineitem"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    return B.to_bars(trades(spark, d), "ticker", "date")


def context(spark: SparkSession, d: str) -> DataFrame:
    return B.market_context(trades(spark, d))


def sectors(spark: SparkSession, d: str) -> DataFrame:
    return B.to_bars(trades(spark, d), "sector", "date")


def returns(spark: SparkSession, d: str) -> DataFrame:
    return panel.with_returns(bars(spark, d))


def means(spark: SparkSession, d: str) -> DataFrame:
    return panel.with_means(returns(spark, d))


def in_context(spark: SparkSession, d: str) -> DataFrame:
    return panel.with_returns(panel.with_context(bars(spark, d), context(spark, d), sectors(spark, d)))


def book(spark: SparkSession, d: str) -> DataFrame:
    """ticker, date, fold, ret_1d, ret (the next day's) and y of every labelled bar."""
    b = bars(spark, d)
    c = F.col("close")
    rows = b.select("ticker", "date", I.log_return(c).alias("ret_1d"), (I.ratio(I.lead(c), c) - 1).alias("ret")).where("ret is not null")
    days = folds.sessions(b).select("date", F.floor(F.col("pos") / FOLD).cast("long").alias("fold"))
    return rows.join(days, "date").withColumn("y", I.direction(F.col("ret")))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Three deterministic models on the book, by fold: a logistic curve of the last return, and the majority and persistence of the fold before."""
    rows = book(spark, d)
    before = rows.withColumn("fold", F.col("fold") + 1)
    rows = rows.where("fold > 0")
    made = models.baselines()
    scores = {"signal": F.when(F.col("ret_1d").isNull(), 0.5).otherwise(1 / (1 + F.exp(-F.col("ret_1d")))), "majority": made["majority"], "persistence": made["persistence"]}
    cols = ["ticker", "date", "fold", "ret_1d", "ret", "y"]
    return rows.join(models.baseline_rates(before, ["fold"]), "fold").select(*cols, F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.round(p, 6).alias("p")) for n, p in scores.items()))).alias("x")).select(*cols, "x.model", "x.p")


def signal(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).where("model = 'signal'")


def states(spark: SparkSession, d: str) -> DataFrame:
    """date and state of the market: terciles, by fixed limits, of the benchmark's drawdown from its last 60 closes."""
    from pyspark.sql import Window

    w = Window.orderBy("date").rowsBetween(-59, 0)
    down = F.col("bench_close") / F.max("bench_close").over(w) - 1
    return context(spark, d).withColumn("down", down).select("date", F.when(F.col("down") < -0.9, 2).when(F.col("down") < -0.6, 1).otherwise(0).cast("long").alias("state"))


#: Columns that are the same doubles in any engine: inputs, and a single operation on them.
EXACT = {"open", "high", "low", "close", "adj_close", "volume", "price", "quantity", "change", "true_range"}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so that engines that add in another order can be compared."""
    return df.select(*(F.round(f.name, places).alias(f.name) if isinstance(f.dataType, T.DoubleType) and f.name not in EXACT else F.col(f.name) for f in df.schema))
