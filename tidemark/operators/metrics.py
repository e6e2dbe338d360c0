"""Probability metrics, grouped: each takes scored rows with y, p and grouping keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 10


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose y and p are finite."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where(finite("y") & finite("p"))


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p, c, pos and neg: usable rows and their classes by distinct score. All metrics follow from it, so rows are shuffled once."""
    return usable(rows).groupBy(*keys, "p").agg(F.count("*").alias("c"), F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def confusion(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    hit, up = F.col("p") >= threshold, F.col("y") == 1
    n = lambda c: F.sum(c.cast("long"))
    return shares(usable(rows).groupBy(*keys).agg(F.count("*").alias("n"), n(hit & up).alias("tp"), n(hit & ~up).alias("fp"), n(~hit & up).alias("fn"), n(~hit & ~up).alias("tn")))


def shares(counts: DataFrame) -> DataFrame:
    """n, tp, fp, fn and tn with the shares that follow from them."""
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    first = counts.withColumns({"accuracy": (tp + tn) / F.col("n"), "base_rate": (tp + fn) / F.col("n"), "precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "positive_rate": (tp + fp) / F.col("n")})
    return first.withColumns({"f1": part(2 * tp, 2 * tp + fp + fn), "accuracy_over_base_rate": F.col("accuracy") - F.greatest("base_rate", 1 - F.col("base_rate"))})


def roc_auc(rows: DataFrame, keys: list[str], ranges: int = 1024) -> DataFrame:
    """Area under the curve with average ranks for ties; null where there is one class.

    Scores are counted first, so a window sees a row for each distinct score, and ranked within ranges of the score, to which the totals of the
    ranges below are added: no task holds all scores of a key.
    """
    part = F.greatest(F.lit(-1), F.least(F.lit(ranges), F.floor(F.col("p") * ranges))).cast("int")
    scores = usable(rows).groupBy(*keys, "p").agg(F.count("*").alias("c"), F.sum("y").alias("pos")).withColumn("_part", part)
    totals = scores.groupBy(*keys, "_part").agg(F.sum("c").alias("_c"))  # `ranges` rows a key at most
    below = totals.select(*keys, "_part", (F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_c")).alias("_below"))
    w = Window.partitionBy(*keys, "_part").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = scores.withColumn("rank", F.sum("c").over(w) - (F.col("c") - 1) / 2).join(below, [*keys, "_part"])
    sums = ranked.groupBy(*keys).agg(F.sum((F.col("rank") + F.col("_below")) * F.col("pos")).alias("r"), F.sum("pos").alias("np"), F.sum("c").alias("n"))
    return sums.select(*keys, F.try_divide(F.col("r") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * (F.col("n") - F.col("np"))).alias("roc_auc"))


def average_precision(rows: DataFrame, keys: list[str]) -> DataFrame:
    scores = usable(rows).groupBy(*keys, "p").agg(F.count("*").alias("c"), F.sum("y").alias("pos"))
    w = Window.partitionBy(*keys).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    curve = scores.withColumns({"tp": F.sum("pos").over(w), "seen": F.sum("c").over(w)})
    return curve.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("pr_auc"))


def brier_logloss(rows: DataFrame, keys: list[str], eps: float = 1e-9) -> DataFrame:
    q = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    return usable(rows).groupBy(*keys).agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier"), F.avg(-(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))).alias("log_loss"))


def quantiles(rows: DataFrame, value: str, shares: list[float], ranges: int = 256) -> DataFrame:
    """One row: `q`, the exact interpolated quantiles of all rows' non-null values. No task sees all of them.

    Distinct values are counted, dealt to ranges between approximate quantiles, and ranked within their range, the ranges' totals coming first.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    cuts = counts.agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("cuts"))
    dealt = counts.crossJoin(F.broadcast(cuts)).select("v", "c", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("part"))  # cuts: one row
    totals = dealt.groupBy("part").agg(F.sum("c").alias("t"))  # `ranges` rows at most
    before = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"), F.sum("t").over(Window.partitionBy()).alias("n"))
    w = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.join(F.broadcast(before), "part").withColumn("high", F.col("before") + F.sum("c").over(w)).withColumn("low", F.col("high") - F.col("c"))
    at = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    held = lambda rank: F.max(F.when((F.col("low") <= rank) & (rank < F.col("high")), F.col("v")))
    ends = ranked.groupBy("n").agg(*(held(F.floor(a)).alias(f"a{k}") for k, a in enumerate(at)), *(held(F.ceil(a)).alias(f"b{k}") for k, a in enumerate(at)))
    mixed = [F.when(F.col(f"a{k}") == F.col(f"b{k}"), F.col(f"a{k}")).otherwise((F.ceil(a) - a) * F.col(f"a{k}") + (a - F.floor(a)) * F.col(f"b{k}")) for k, a in enumerate(at)]
    return ends.select(F.array(*mixed).alias("q"))


def binned(rows: DataFrame, keys: list[str], value: str = "p", bins: int = BINS, closed: str = "left") -> DataFrame:
    """rows with `bin`: equal-frequency bins between distinct quantiles. A value on an interior edge goes up (left) or down (right)."""
    shares = [k / bins for k in range(bins + 1)]
    if keys:
        edges = rows.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("q"))
    else:
        edges = quantiles(rows, value, shares)
    edges = edges.select(*keys, F.array_sort(F.array_distinct("q")).alias("_edges"))
    interior = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    passed = (lambda e: e <= F.col(value)) if closed == "left" else (lambda e: e < F.col(value))
    joined = rows.join(edges, keys) if keys else rows.crossJoin(F.broadcast(edges))  # one row without keys
    return joined.withColumn("bin", F.size(F.filter(interior, passed)).cast("long")).drop("_edges")


def reliability(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By equal-frequency bin of the score: mean score, mean outcome and rows."""
    return _reliability(counted(rows, keys), keys)


def _reliability(counts: DataFrame, keys: list[str]) -> DataFrame:
    shares = F.array(*(F.lit(k / BINS) for k in range(BINS + 1)))
    edges = counts.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile("p", shares, F.col("c")))).alias("_edges"))
    interior = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    b = counts.join(edges, keys).withColumn("bin", F.size(F.filter(interior, lambda e: e <= F.col("p"))).cast("long"))
    return b.groupBy(*keys, "bin").agg((F.sum(F.col("p") * F.col("c")) / F.sum("c")).alias("mean_p"), (F.sum("pos") / F.sum("c")).alias("mean_y"), F.sum("c").alias("n"))


def calibration(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and maximum calibration error."""
    return _calibration(counted(rows, keys), keys)


def _calibration(counts: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    return _reliability(counts, keys).groupBy(*keys).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def evaluate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics of scored rows."""
    return evaluate_counts(counted(rows, keys), keys)


def evaluate_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics, from rows counted by distinct score."""
    w = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"rank": F.sum("c").over(w) - (F.col("c") - 1) / 2, "_tp": F.sum("pos").over(back), "_seen": F.sum("c").over(back)})
    q, p, pos, neg = F.least(F.greatest("p", F.lit(1e-9)), F.lit(1 - 1e-9)), F.col("p"), F.col("pos"), F.col("neg")
    n = lambda c, x: F.sum(F.when(c, x).otherwise(0.0)).cast("long")
    hit = p >= 0.5
    sums = ranked.groupBy(*keys).agg(
        F.sum("c").alias("n"), n(hit, pos).alias("tp"), n(hit, neg).alias("fp"), n(~hit, pos).alias("fn"), n(~hit, neg).alias("tn"), F.sum(F.col("rank") * pos).alias("_r"), F.sum("pos").alias("_np"),
        F.try_divide(F.sum(pos * F.col("_tp") / F.col("_seen")), F.sum("pos")).alias("pr_auc"),
        (F.sum((1 - p) * (1 - p) * pos + p * p * neg) / F.sum("c")).alias("brier"), (-F.sum(pos * F.ln(q) + neg * F.ln(1 - q)) / F.sum("c")).alias("log_loss"),
    )
    area = F.try_divide(F.col("_r") - F.col("_np") * (F.col("_np") + 1) / 2, F.col("_np") * (F.col("n") - F.col("_np")))
    return shares(sums.withColumn("roc_auc", area).drop("_r", "_np")).join(_calibration(counts, keys), keys)


def select_threshold(rows: DataFrame, keys: list[str], metric: str = "balanced_accuracy") -> DataFrame:
    """The first of the best thresholds from 0.05 to 0.95; 0.5 where there is one class or one probability."""
    grid = F.explode(F.expr("transform(sequence(5, 95), k -> k / 100D)")).alias("threshold")
    counts = usable(rows).groupBy(*keys, "p").agg(F.count("*").alias("c"), F.sum("y").alias("pos"))
    hit = F.col("p") >= F.col("threshold")
    sums = counts.select("*", grid).groupBy(*keys, "threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0.0)).alias("tp"), F.sum(F.when(hit, F.col("c") - F.col("pos")).otherwise(0.0)).alias("fp"),
        F.sum("pos").alias("np"), F.sum(F.col("c") - F.col("pos")).alias("nn"), F.min("p").alias("low"), F.max("p").alias("high"),
    )
    score = {
        "balanced_accuracy": (F.try_divide("tp", "np") + F.try_divide(F.col("nn") - F.col("fp"), F.col("nn"))) / 2,
        "accuracy": (F.col("tp") + F.col("nn") - F.col("fp")) / (F.col("np") + F.col("nn")),
        "f1": F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("np")), F.lit(0.0)),
    }[metric]
    best = sums.withColumn("score", F.round(score, 12)).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "threshold"))).where("_r = 1")
    flat = (F.col("np") == 0) | (F.col("nn") == 0) | (F.col("low") == F.col("high"))
    return best.select(*keys, F.when(flat, 0.5).otherwise(F.col("threshold")).alias("threshold"), F.when(flat, F.lit(None)).otherwise(F.col("score")).alias("score"))
