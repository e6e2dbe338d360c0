"""Where predictions go wrong: outcomes, confidence, buckets, groups, time, reversals and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import metrics


def judged(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit = F.col("p") >= threshold
    return rows.withColumns({"correct": (hit == (F.col("y") == 1)).cast("double"), "confidence": F.abs(F.col("p") - 0.5), "outcome": F.when(hit, F.when(F.col("y") == 1, "TP").otherwise("FP")).otherwise(F.when(F.col("y") == 1, "FN").otherwise("TN"))})


def breakdown(rows: DataFrame) -> DataFrame:
    out = judged(rows).groupBy("outcome").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("confidence").alias("mean_confidence"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def confidence_deciles(rows: DataFrame) -> DataFrame:
    return metrics.binned(judged(rows), [], "confidence", closed="right").groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("correct").alias("accuracy"), F.avg("y").alias("base_rate"))


def by_bucket(rows: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """Performance by equal-frequency buckets of a conditioning variable."""
    known = judged(rows).where(F.col(value).isNotNull())
    b = metrics.binned(known, [], value, bins, "right")
    if b.select("bin").distinct().limit(2).count() < 2:  # all quantiles are equal: bins of equal width instead
        span = known.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))  # one row
        width = F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a")) * bins
        b = known.crossJoin(F.broadcast(span)).withColumn("bin", F.coalesce(F.greatest(F.lit(0), F.ceil(width) - 1), F.lit(0)).cast("long")).drop("_a", "_b")
    sums = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.avg("correct").alias("accuracy"), F.avg("y").alias("base_rate"))
    return sums.join(metrics.roc_auc(b, ["bin"]), "bin")


def by_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = judged(rows).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("y").alias("base_rate"))
    return sums.join(metrics.roc_auc(rows, keys), keys)


def daily(rows: DataFrame) -> DataFrame:
    return judged(rows).groupBy("date").agg(F.avg("correct").alias("accuracy"), F.count("*").alias("n"))


def rolling(rows: DataFrame, window: int = 60, least: int = 30) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(-(window - 1), 0)  # one row a date
    return daily(rows).select("date", F.when(F.count("accuracy").over(w) >= least, F.avg("accuracy").over(w)).alias("rolling_accuracy"))


def confident_errors(rows: DataFrame, share: float = 0.9) -> DataFrame:
    j = judged(rows)
    cut = metrics.quantiles(j, "confidence", [share]).select(F.col("q")[0].alias("cut"))
    return j.crossJoin(F.broadcast(cut)).where((F.col("confidence") >= F.col("cut")) & (F.col("correct") == 0)).drop("cut")


def rolling_steps(rows: DataFrame, window: int = 60, step: int = 5) -> DataFrame:
    """By instrument: the accuracy of the `window` rows before each `step`-th row."""
    w = Window.partitionBy("ticker").orderBy("date")
    seen = judged(rows).withColumns({"_k": F.row_number().over(w) - 1, "accuracy": F.avg("correct").over(w.rowsBetween(-window, -1))})
    return seen.where((F.col("_k") >= window) & ((F.col("_k") - window) % step == 0)).select("ticker", "date", "accuracy")


def confident_stats(rows: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """Accuracy of the most and the least confident max(1, floor(share n)) rows within keys."""
    w = Window.partitionBy(*keys)
    by = w.orderBy(F.desc("confidence"), "ticker", "date")
    ranked = judged(rows).withColumns({"_k": F.row_number().over(by), "_n": F.count("*").over(w)}).withColumn("_m", F.greatest(F.lit(1), F.floor(F.col("_n") * share + 1e-9)))
    sides = F.explode(F.array_compact(F.array(F.when(F.col("_k") <= F.col("_m"), F.lit("top")), F.when(F.col("_k") > F.col("_n") - F.col("_m"), F.lit("bottom"))))).alias("side")
    return ranked.select(*keys, "correct", sides).groupBy(*keys, "side").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"))


def by_regime(rows: DataFrame, states: DataFrame, reference: str = "majority") -> DataFrame:
    """Area under the curve by model and regime, and how far it is above the reference model's on the same regime."""
    area = metrics.roc_auc(rows.join(states, "date"), ["model", "state"])
    ref = area.where(F.col("model") == reference).select("state", F.col("roc_auc").alias("_ref"))
    return area.join(ref, "state", "left").withColumn("lift", F.col("roc_auc") - F.col("_ref")).drop("_ref")


def flips(trend: DataFrame) -> DataFrame:
    """Dates on which the sign of `trend`(date, value) changes; a sign of zero is a state of its own."""
    sign = F.signum("value")
    return trend.withColumn("s", sign).withColumn("b", F.lag("s").over(Window.orderBy("date"))).where("b is not null and s <> b").select(F.col("date").alias("flip"))


def near_flips(rows: DataFrame, flip: DataFrame, days: int = 6) -> DataFrame:
    """rows with `near`: a flip lies within so many calendar days. Each flip is spread over its days, so the join is on equal dates."""
    close = flip.select(F.explode(F.sequence(F.date_sub("flip", days), F.date_add("flip", days))).alias("date")).distinct().withColumn("near", F.lit(True))
    return rows.join(close, "date", "left").withColumn("near", F.coalesce("near", F.lit(False)))
