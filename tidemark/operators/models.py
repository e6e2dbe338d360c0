"""Baselines as grouped aggregates, learners as MLlib pipelines, calibration, search and explanations."""

from __future__ import annotations

import dataclasses
import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import boosting, metrics
from tidemark.operators.regime import STARTS
from tidemark.sources.files import discard, kept


def baseline_rates(fit: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _all, _up and _down: the share of gains, of those after a rise, and of those otherwise."""
    up = F.coalesce(F.col("ret_1d") > 0, F.lit(False))
    return fit.groupBy(*keys).agg(F.avg("y").alias("_all"), F.avg(F.when(up, F.col("y"))).alias("_up"), F.avg(F.when(~up, F.col("y"))).alias("_down"))


def baselines() -> dict[str, Column]:
    """Scores by model, over rows with ret_1d and the rates of their fit window. Persistence is 0.5 where the signal is missing."""
    last = F.when(F.col("ret_1d").isNull(), 0.5).otherwise(F.when(F.col("ret_1d") > 0, F.col("_up")).otherwise(F.col("_down")))
    return {"majority": F.col("_all"), "persistence": last, "always_long": F.lit(1 - 1e-6)}


def persistence(rows: DataFrame, keys: list[str], fit: DataFrame | None = None) -> DataFrame:
    """rows with p: the share of gains after a rise or otherwise, within keys of fit (rows by default); 0.5 where the signal is missing."""
    return _baseline("persistence", rows, keys, fit)


def majority(rows: DataFrame, keys: list[str], fit: DataFrame | None = None) -> DataFrame:
    """rows with p: the share of gains within keys of fit (rows by default)."""
    return _baseline("majority", rows, keys, fit)


def _baseline(name: str, rows: DataFrame, keys: list[str], fit: DataFrame | None) -> DataFrame:
    return rows.join(baseline_rates(rows if fit is None else fit, keys), keys).withColumn("p", baselines()[name]).drop("_all", "_up", "_down")


def always_long(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", F.lit(1 - 1e-6))


def learner(kind: str, n: int, **params):
    """An unfitted classifier by name; n: rows it will be fitted on."""
    common = {"featuresCol": "features", "labelCol": "y"}
    if kind in ("logistic", "elastic_net"):
        c = params.get("C", 1.0 if kind == "logistic" else 0.1)
        return LogisticRegression(**common, regParam=1 / (c * n), elasticNetParam=params.get("l1_ratio", 0.0 if kind == "logistic" else 0.5), maxIter=params.get("max_iter", 100), standardization=False)
    if kind == "random_forest":
        return RandomForestClassifier(**common, numTrees=params.get("trees", 100), maxDepth=params.get("depth", 8), minInstancesPerNode=params.get("leaf", 50), seed=17)
    raise ValueError(f"unknown learner: {kind}")


#: Learners of boosting.py, which take nulls as they are.
BOOSTED = {"boosted_trees": boosting.DEPTH_WISE, "boosted_leaves": boosting.LEAF_WISE}


def growth(kind: str, **params) -> boosting.Growth:
    return dataclasses.replace(BOOSTED[kind], **params)


def pipeline(kind: str, columns: list[str], n: int, **params) -> Pipeline:
    """Median imputation, assembly, scaling and the learner, all fitted on the fit window alone."""
    filled = [f"_{c}" for c in columns]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True), learner(kind, n, **params),
    ])


def fit_predict(fit: DataFrame, score: DataFrame, columns: list[str], kind: str = "logistic", **params) -> DataFrame:
    """score with p from a model fitted on fit(y, columns)."""
    if kind in BOOSTED:
        return boosting.score(boosting.fit(fit, columns, growth=growth(kind, **params)), score).select(*score.columns, "p")
    train = fit.where("y is not null")
    model = pipeline(kind, columns, max(1, train.count()), **params).fit(train)
    out = model.transform(score).withColumn("p", vector_to_array("probability")[1])
    return out.select(*score.columns, "p")


BLOCKS = "array<struct<low:double,high:double,pos:double,c:double>>"


def pooled(scores: Column) -> Column:
    """Adjacent violators pooled: an array of (low, high, pos, c), in the order of scores, as blocks whose means rise."""
    block = lambda b: F.struct(b["low"].alias("low"), b["high"].alias("high"), b["pos"].alias("pos"), b["c"].alias("c"))

    def into(m: Column, b: Column) -> Column:
        """A block goes into the new one as long as its mean isn't below that of what is pooled so far."""
        joins = ~m["done"] & (b["pos"] * m["c"] >= m["pos"] * b["c"])
        as_one = F.struct(b["low"].alias("low"), m["high"].alias("high"), (b["pos"] + m["pos"]).alias("pos"), (b["c"] + m["c"]).alias("c"), (m["k"] + 1).alias("k"), F.lit(False).alias("done"))
        return F.when(joins, as_one).otherwise(F.struct(m["low"], m["high"], m["pos"], m["c"], m["k"], F.lit(True).alias("done")))

    def pushed(stack: Column, x: Column) -> Column:
        start = F.struct(x["low"].alias("low"), x["high"].alias("high"), x["pos"].alias("pos"), x["c"].alias("c"), F.lit(0).alias("k"), F.lit(False).alias("done"))
        merged = F.aggregate(F.reverse(stack), start, into)
        return F.transform(F.array(merged), lambda m: F.concat(F.slice(stack, 1, F.size(stack) - m["k"]), F.array(block(m))))[0]

    return F.aggregate(scores, F.array().cast(BLOCKS), pushed)


def isotonic_steps(inner: DataFrame, keys: list[str], ranges: int = 64) -> DataFrame:
    """keys, n, classes and steps: the monotone fit of inner(keys, y, p) as blocks of scores.

    Scores are counted first and pooled within ranges of p, then across them, which gives the same blocks; a row a key holds them.
    """
    counts = metrics.counted(inner, keys).withColumn("_range", F.floor(F.col("p") * ranges))
    one = F.struct(F.col("p").alias("low"), F.col("p").alias("high"), F.col("pos").alias("pos"), F.col("c").cast("double").alias("c"))
    parts = counts.groupBy(*keys, "_range").agg(pooled(F.array_sort(F.collect_list(one))).alias("_blocks"), F.sum("c").alias("_n"), F.sum("pos").alias("_pos"))
    sums = parts.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("_blocks"))).alias("_all"), F.sum("_n").alias("n"), F.sum("_pos").alias("_pos"))
    return sums.select(*keys, "n", F.when((F.col("_pos") > 0) & (F.col("_pos") < F.col("n")), 2).otherwise(1).alias("classes"), pooled(F.col("_all")).alias("steps"))


def stepped(p: Column, steps: Column) -> Column:
    """The fit at p: a block's mean within it, straight lines between blocks, the outer blocks' means beyond."""
    mean = lambda b: b["pos"] / b["c"]
    below, above = F.filter(steps, lambda b: b["low"] <= p), F.filter(steps, lambda b: b["low"] > p)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    between = mean(a) + (mean(b) - mean(a)) * (p - a["high"]) / (b["low"] - a["high"])
    return F.when(a.isNull(), mean(b)).when((p <= a["high"]) | b.isNull(), mean(a)).otherwise(between)


def isotonic(inner: DataFrame, scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """scored with p calibrated by a monotone fit on inner(keys, y, p), kept off 0 and 1; unchanged where inner has one class or no rows."""
    own = keys or ["_one"]
    one = (lambda df: df) if keys else (lambda df: df.withColumn("_one", F.lit(0)))
    steps = isotonic_steps(one(inner), own)
    low = F.least(1 / (F.col("n") + 2), F.lit(0.01))
    made = F.least(F.greatest(stepped(F.col("p"), F.col("steps")), low), 1 - low)
    joined = one(scored).join(F.broadcast(steps), own, "left")  # a row a key
    return joined.withColumn("p", F.when(F.col("classes") == 2, made).otherwise(F.col("p"))).select(*scored.columns)


def platt(inner: DataFrame, scored: DataFrame, eps: float = 1e-6) -> DataFrame:
    """scored with p calibrated by a logistic curve on its log-odds."""
    clipped = F.least(F.greatest("p", F.lit(eps)), F.lit(1 - eps))
    to = VectorAssembler(inputCols=["_z"], outputCol="_v")
    z = lambda df: to.transform(df.withColumn("_z", F.ln(clipped / (1 - clipped))))
    model = LogisticRegression(featuresCol="_v", labelCol="y", regParam=1e-6, probabilityCol="_q", rawPredictionCol="_r", predictionCol="_l").fit(z(inner))
    return model.transform(z(scored)).withColumn("p", vector_to_array("_q")[1]).drop("_z", "_v", "_q", "_r", "_l")


def sampled(grid: dict[str, list], trials: int, seed: int = 17) -> list[dict]:
    """Distinct choices of parameters, drawn at random: `trials` draws, repeats left out."""
    rng, out = random.Random(seed), []
    for _ in range(trials):
        params = {name: values[rng.randrange(len(values))] for name, values in grid.items()}
        if params not in out:
            out.append(params)
    return out


def search(windows: list[tuple[DataFrame, DataFrame]], columns: list[str], kind: str, grid: dict[str, list], trials: int = 25, seed: int = 17) -> list[tuple[float, dict]]:
    """Mean area under the curve over windows of (fit, validation), for each sampled choice of parameters, best first."""
    out = []
    for params in sampled(grid, trials, seed):
        scores = [metrics.roc_auc(fit_predict(f, v, columns, kind, **params).withColumn("all", F.lit(0)), ["all"]).first()["roc_auc"] for f, v in windows]
        known = [s for s in scores if s is not None]
        out.append((sum(known) / len(known) if known else float("nan"), params))
    return sorted(out, key=lambda x: -x[0])


def permutation_importance(fit: DataFrame, score: DataFrame, columns: list[str], kind: str = "logistic", repeats: int = 5, seed: int = 17, at_once: int = 10) -> DataFrame:
    """By feature: the area under the curve as it is, and the mean loss of it when the feature's values are dealt anew among the scored rows.

    A row's new value is that of the row whose rank is its own by a hash of another draw, within 64 parts of the rows by hash. A draw deals all
    features alike, so every row is stored once a draw, beside the row that its values come from; no values are moved by feature. The areas of
    `at_once` features and all draws are one grouped plan, and the driver sees a row a feature.
    """
    train = fit.where("y is not null")
    model = pipeline(kind, columns, max(1, train.count())).fit(train)
    scored = lambda df, keys: metrics.roc_auc(model.transform(df).select(*keys, "y", vector_to_array("probability")[1].alias("p")), keys)
    base = scored(score.withColumn("all", F.lit(0)), ["all"]).first()["roc_auc"]
    dealt = shuffled(score.where("y is not null").select("y", *columns), columns, repeats, seed)
    out = []
    for a in range(0, len(columns), at_once):
        some = columns[a : a + at_once]
        each = dealt.withColumn("feature", F.explode(F.array(*map(F.lit, some))))
        at = {c: k for k, c in enumerate(columns)}
        mixed = each.select("feature", "draw", "y", *(F.when(F.col("feature") == c, F.col("_new")[at[c]]).otherwise(F.col(c)).alias(c) if c in some else F.col(c) for c in columns))
        out += scored(mixed, ["feature", "draw"]).groupBy("feature").agg(F.lit(base).cast("double").alias("roc_auc"), F.avg(F.lit(base) - F.col("roc_auc")).alias("mean_loss")).collect()  # a row a feature
    discard(dealt)
    return score.sparkSession.createDataFrame(out, "feature string, roc_auc double, mean_loss double")


def shuffled(rows: DataFrame, columns: list[str], repeats: int, seed: int) -> DataFrame:
    """rows(y, columns) once for each draw, with draw and _new: the columns, as doubles, of the row that has this one's rank by the draw's hash. Stored."""
    numbered = kept(rows.withColumn("_row", F.monotonically_increasing_id()), "importance")
    parts = numbered.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(64)))
    own = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy("_row"))).drop("_row")
    drawn = parts.select("_part", "_row", F.array(*(F.col(c).cast("double") for c in columns)).alias("_new"), F.explode(F.array(*map(F.lit, range(repeats)))).alias("draw"))
    spot = F.row_number().over(Window.partitionBy("draw", "_part").orderBy(F.xxhash64(F.lit(seed), "draw", "_row"), "_row"))
    out = kept(own.join(drawn.withColumn("_k", spot).drop("_row"), ["_part", "_k"]).drop("_part", "_k"), "importance")
    discard(numbered)
    return out


def mixture_states(rows: DataFrame, columns: list[str], k: int = 3, kind: str = "gmm") -> DataFrame:
    """rows with state and posterior by a Gaussian mixture or k-means on standardised columns, the best of several starts (`regime.STARTS`)."""
    if rows.isEmpty():
        return rows.withColumns({"state": F.lit(None).cast("long"), "posterior": F.lit(None).cast("array<double>")})
    assembled = VectorAssembler(inputCols=columns, outputCol="raw").transform(rows)
    scaled = kept(StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(assembled).transform(assembled), "mixture")
    seeds = range(17, 17 + STARTS[kind])
    if kind == "gmm":
        fits = [GaussianMixture(k=k, seed=s, probabilityCol="probability", predictionCol="state").fit(scaled) for s in seeds]
        out = max(fits, key=lambda m: m.summary.logLikelihood).transform(scaled)
        return out.withColumn("posterior", vector_to_array("probability")).select(*rows.columns, F.col("state").cast("long"), "posterior")
    out = min((KMeans(k=k, seed=s, predictionCol="state").fit(scaled) for s in seeds), key=lambda m: m.summary.trainingCost).transform(scaled)
    return out.withColumn("posterior", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: (s == F.col("state")).cast("double"))).select(*rows.columns, F.col("state").cast("long"), "posterior")


def linear_contributions(rows: DataFrame, weights: dict[str, float], means: dict[str, float]) -> DataFrame:
    """rows with a map of exact contributions of a linear model: weight times distance from the mean."""
    return rows.withColumn("contributions", F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*((F.col(c) - F.lit(means[c])) * F.lit(w) for c, w in weights.items()))))


def top_contributions(rows: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """The n largest contributions of each sign by row, from a map column."""
    long = rows.select(*keys, F.explode("contributions").alias("feature", "value")).where("value <> 0").withColumn("sign", F.signum("value").cast("int"))
    w = Window.partitionBy(*keys, "sign").orderBy(F.desc(F.abs("value")), "feature")
    return long.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def importance_stability(importances: DataFrame, top: int = 3) -> DataFrame:
    """By feature: folds in which it is among the top, mean rank and its deviation; importances(fold, feature, value)."""
    w = Window.partitionBy("fold").orderBy(F.desc("value"), "feature")
    ranked = importances.withColumn("rank", F.row_number().over(w))
    return ranked.groupBy("feature").agg(F.sum((F.col("rank") <= top).cast("long")).alias("appearances"), F.avg("rank").alias("mean_rank"), F.stddev_pop("rank").alias("std_rank"))
