"""Tests on folds: signed ranks, false-discovery control, block bootstrap and permutation nulls.

Draws are rows: a draw's random choices are hashes of (seed, draw, key), so the work is joins and groupings that Spark spreads out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import metrics


def paired(fold_metrics: DataFrame, reference: str, metric: str, itself: bool = False) -> DataFrame:
    """model, fold, value, value_ref: each model against the reference on the same folds; itself: the reference too."""
    ref = fold_metrics.where(F.col("model") == reference).select("fold", F.col(metric).alias("value_ref"))
    return fold_metrics.where(F.lit(itself) | (F.col("model") != reference)).select("model", "fold", F.col(metric).alias("value")).join(ref, "fold")


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """Wilcoxon's statistic by model, ranks of zero differences split between both signs; wins are folds above the reference.

    halves: twice the ranks of the differences that aren't zero, for signed_rank_p. A model's folds, a few, are one row.
    """
    d = pairs.withColumn("d", F.round(F.col("value") - F.col("value_ref"), 12)).where("d is not null")
    w = Window.partitionBy("model")
    rank = F.rank().over(w.orderBy(F.abs("d"))) + (F.count("*").over(Window.partitionBy("model", F.abs("d"))) - 1) / 2
    r = F.col("rank")
    signed = d.withColumn("rank", rank).groupBy("model").agg(
        F.count("*").alias("folds"), F.sum((F.col("d") > 0).cast("long")).alias("wins"), F.avg("d").alias("mean_diff"),
        F.sum(F.when(F.col("d") > 0, r).when(F.col("d") == 0, r / 2).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, r).when(F.col("d") == 0, r / 2).otherwise(0.0)).alias("w_minus"),
        F.array_sort(F.collect_list(F.when(F.col("d") != 0, (2 * r).cast("int")))).alias("halves"),
    )
    return signed.withColumn("w", F.least("w_plus", "w_minus"))


def significance(fold_metrics: DataFrame, reference: str = "majority", metric: str = "roc_auc") -> DataFrame:
    """By model: folds, wins, mean_diff, w, p and p_adj of its signed ranks against the reference's; the reference itself has p 1."""
    tested = signed_rank_p(signed_ranks(paired(fold_metrics, reference, metric, itself=True)))
    return adjust_p(tested.select("model", "wins", "mean_diff", "w", "p"))


#: Up to so many differences the null distribution is counted out; beyond, the normal curve stands for it.
EXACT = 50


def signed_rank_p(signed: DataFrame) -> DataFrame:
    """signed (from signed_ranks) with p, two-sided, and without `halves`.

    The null distribution of the statistic, given the ranks that there are (ties and zeros included), is a fold over them: an array of the
    number of sign patterns by twice the positive rank sum, to which each rank adds itself moved by twice its size. A zero gives half of
    its rank to both sides under any pattern. Null for fewer than 3 folds, 1 where all differences are zero. Beyond EXACT folds by the
    normal curve, its variance from the same ranks.
    """
    ranks = F.col("halves")
    size = F.aggregate(ranks, F.lit(0), lambda a, x: a + x)
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size))
    # ways[s] + ways[s - r]: the array moved by r places, cut to its length, is added to itself
    step = lambda ways, r: F.zip_with(ways, F.slice(F.concat(F.array_repeat(F.lit(0.0), r), ways), 1, F.size(ways)), lambda a, b: a + b)
    ways = F.aggregate(ranks, start, step)
    zeros = (F.col("w_plus") + F.col("w_minus")) * 2 - size  # both halves of the zeros' ranks, in halves
    least = (F.col("w") * 2 - zeros / 2).cast("int")
    below = F.aggregate(F.slice("_ways", 1, F.greatest(least + 1, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    exact = F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), F.size("halves")))
    squares = F.aggregate(ranks, F.lit(0.0), lambda a, x: a + F.pow(x / 2.0, F.lit(2.0)))
    z = F.abs(F.col("w_plus") - F.col("w_minus")) / 2 / F.sqrt(squares / 4)
    p = F.when(F.col("folds") < 3, F.lit(None)).when(F.size("halves") == 0, 1.0).when(F.size("halves") <= EXACT, exact).otherwise(normal_tail(z))
    few = F.when(F.size("halves") <= EXACT, ways)
    return signed.withColumn("_ways", few).withColumn("p", p.cast("double")).drop("_ways", "halves")


def normal_tail(z: Column) -> Column:
    """Both tails of the normal curve beyond z >= 0: the continued fraction of the complementary error function, its series for small z."""
    x = z / math.sqrt(2)
    series = F.aggregate(F.sequence(F.lit(0), F.lit(60)), F.struct(x.alias("term"), F.lit(0.0).alias("sum")), lambda a, k: F.struct((-a["term"] * x * x / (k + 1)).alias("term"), (a["sum"] + a["term"] / (2 * k + 1)).alias("sum")))
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda a, k: x + k / 2.0 / a)
    return F.when(x < 2.5, 1 - 2 / math.sqrt(math.pi) * series["sum"]).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / fraction)


def adjust_p(p: DataFrame, name: str = "p") -> DataFrame:
    """Benjamini-Hochberg: p_adj beside each p; nulls stay null."""
    n = F.count(name).over(Window.partitionBy())  # a row a model
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last(name), "model"))
    ranked = p.withColumn("_rank", rank).withColumn("_q", F.col(name) * n / F.col("_rank"))
    least = F.min("_q").over(Window.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("p_adj", F.when(F.col(name).isNotNull(), F.least(F.lit(1.0), least))).drop("_rank", "_q")


def uniform(seed: int, *keys: Column) -> Column:
    """A hash of the keys as a number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def block_bootstrap(values: DataFrame, block: int = 4, draws: int = 2000, seed: int = 17) -> DataFrame:
    """Mean of values(fold, value) and the 2.5 and 97.5 % quantiles of means of resampled contiguous blocks of folds."""
    w = Window.orderBy("fold")  # one row a fold
    clean = values.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    numbered = clean.withColumn("pos", F.row_number().over(w) - 1)
    n = numbered.agg(F.count("*").alias("n")).where("n >= 2").withColumn("size", F.least(F.lit(block), F.col("n").cast("int")))
    spark = values.sparkSession
    slots = spark.range(draws).select(F.col("id").alias("draw")).crossJoin(F.broadcast(n)).select("draw", "n", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("size")).cast("int") - 1)).alias("b"))
    starts = slots.withColumn("at", F.floor(uniform(seed, F.col("draw"), F.col("b")) * (F.col("n") - F.col("size") + 1)).cast("int"))
    # The last block is cut, so that a sample has as many values as there are.
    each = starts.select("draw", "at", F.explode(F.sequence(F.lit(0), F.least(F.col("size"), (F.col("n") - F.col("b") * F.col("size")).cast("int")) - 1)).alias("k"))
    rows = each.select("draw", (F.col("at") + F.col("k")).alias("pos"))
    means = rows.join(numbered, "pos").groupBy("draw").agg(F.avg("value").alias("m"))
    q = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count("*").alias("draws"))
    return clean.agg(F.avg("value").alias("mean")).crossJoin(F.broadcast(q))


def permutation_auc(rows: DataFrame, strata: list[str], draws: int = 200, seed: int = 17) -> DataFrame:
    """The area under the curve, its mean and deviation with y dealt anew within strata, and the share of draws that reach it."""
    own = Window.partitionBy(*strata)
    base = metrics.usable(rows).select("y", "p", *strata).withColumns({"i": F.row_number().over(own.orderBy("p", "y")), "ups": F.sum("y").over(own)})
    each = base.select("p", "i", "ups", *strata, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    # A permutation only says which of a stratum's rows are the positive ones: those with the least hashes.
    spot = Window.partitionBy("draw", *strata).orderBy(F.xxhash64(F.lit(seed), "draw", "i", *strata), "i")
    null = metrics.roc_auc(each.withColumn("y", (F.row_number().over(spot) <= F.col("ups")).cast("double")), ["draw"])
    observed = metrics.roc_auc(base.withColumn("all", F.lit(0)), ["all"]).select(F.col("roc_auc").alias("observed"))
    joined = null.crossJoin(F.broadcast(observed))
    return joined.agg(F.first("observed").alias("observed"), F.avg("roc_auc").alias("null_mean"), F.stddev_pop("roc_auc").alias("null_std"), F.avg((F.col("roc_auc") >= F.col("observed")).cast("double")).alias("p_value"), F.count("*").alias("draws"))


def permutation_pooled(rows: DataFrame, draws: int = 100, seed: int = 17) -> DataFrame:
    """As permutation_auc, but whole sessions change places within a fold, so what the rows of a date share stays together."""
    slot = Window.partitionBy("fold", "date").orderBy("ticker")
    base = metrics.usable(rows).select("fold", "date", "ticker", "y", "p").withColumn("slot", F.row_number().over(slot))
    days = base.select("fold", "date").distinct()
    each = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    by = Window.partitionBy("draw", "fold")
    here = each.select("draw", "fold", "date", F.row_number().over(by.orderBy("date")).alias("k"))
    there = each.withColumn("u", uniform(seed, F.col("draw"), F.col("date"))).select("draw", "fold", F.col("date").alias("from_date"), F.row_number().over(by.orderBy("u")).alias("k"))
    moved = here.join(there, ["draw", "fold", "k"])
    labels = base.select("fold", F.col("date").alias("from_date"), "slot", "y")
    mixed = moved.join(base.select("fold", "date", "slot", "p"), ["fold", "date"]).join(labels, ["fold", "from_date", "slot"])
    null = metrics.roc_auc(mixed, ["draw"])
    observed = metrics.roc_auc(base.withColumn("all", F.lit(0)), ["all"]).select(F.col("roc_auc").alias("observed"))
    joined = null.crossJoin(F.broadcast(observed))
    return joined.agg(F.first("observed").alias("observed"), F.avg("roc_auc").alias("null_mean"), F.stddev_pop("roc_auc").alias("null_std"), F.avg((F.col("roc_auc") >= F.col("observed")).cast("double")).alias("p_value"), F.count("*").alias("draws"))
