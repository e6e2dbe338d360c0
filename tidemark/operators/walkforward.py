"""The walk-forward run: fit on the fit window, calibrate and choose on the inner one, score the test one.

Baselines are aggregates of the fit windows, and boosted trees are grown for all folds side by side; other learners are fitted fold by fold,
a job for each. Calibration, thresholds and scores of all folds and models are one plan. Rows are dealt to folds once and stored by fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import boosting, folds, metrics, models
from tidemark.sources.files import kept

MEASURES = ("accuracy", "accuracy_over_base_rate", "roc_auc", "pr_auc", "brier", "ece", "f1", "log_loss")
PREDICTION = ["date", "ticker", "fold", "model", "prob_raw", "prob", "y_true", "threshold", "is_baseline"]


def parts(rows: DataFrame, f: DataFrame, train: list[str] | None = None, score: list[str] | None = None) -> DataFrame:
    """rows(ticker, date, y, group) with fold and part: fit and inner from the train groups, test from the score groups (all by default)."""
    wanted = lambda names: F.lit(True) if names is None else F.col("group").isin(names)
    return folds.assign(rows.where("y is not null"), f).where(F.when(F.col("part") == "test", wanted(train if score is None else score)).otherwise(wanted(train)))


def deal(rows: DataFrame, f: DataFrame, train: list[str] | None = None, score: list[str] | None = None) -> DataFrame:
    """The rows of `parts`, stored by fold, of folds of which no part is empty."""
    dealt = kept(parts(rows, f, train, score), "walk-forward", ["fold"])
    full = dealt.groupBy("fold").agg(F.countDistinct("part").alias("k")).where(F.col("k") == len(folds.PARTS))
    return dealt.join(F.broadcast(full.select("fold")), "fold", "left_semi")  # a row a fold


def sizes(dealt: DataFrame) -> DataFrame:
    """By fold: n_fit, n_inner and n_test."""
    return dealt.groupBy("fold").agg(*(F.sum((F.col("part") == p).cast("long")).alias(f"n_{p}") for p in folds.PARTS))


def finished(scored: DataFrame, calibrate: str = "isotonic") -> DataFrame:
    """Predictions of the test rows among scored(date, ticker, fold, part, y, model, p, is_baseline): calibrated, with thresholds, on the inner ones."""
    keys = ["fold", "model"]
    raw = scored.withColumn("prob_raw", F.col("p"))
    if calibrate == "isotonic":
        raw = models.isotonic(raw.where("part = 'inner'"), raw, keys)
    chosen = metrics.select_threshold(raw.where("part = 'inner'"), keys).select(*keys, "threshold")
    tested = raw.where("part = 'test'").join(F.broadcast(chosen), keys)  # a row a fold and model
    return tested.select("date", "ticker", "fold", "model", "prob_raw", F.col("p").alias("prob"), F.col("y").alias("y_true"), "threshold", "is_baseline")


def predict(rows: DataFrame, f: DataFrame, train: list[str] | None = None, score: list[str] | None = None, calibrate: str = "isotonic") -> DataFrame:
    """Predictions of the baselines in the test windows: the majority, persistence and always long, from the fit windows alone.

    Folds of which a part is empty have none. Baselines are calibrated as learners are (isotonic or none).
    """
    return baselines(deal(rows, f, train, score), calibrate)


def baselines(dealt: DataFrame, calibrate: str = "isotonic") -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("model"), p.alias("p")) for name, p in models.baselines().items()))).alias("x")
    rates = models.baseline_rates(dealt.where("part = 'fit'"), ["fold"])
    scored = dealt.where("part <> 'fit'").join(F.broadcast(rates), "fold").select("date", "ticker", "fold", "part", "y", F.lit(True).alias("is_baseline"), each).select("*", "x.*").drop("x")
    return finished(scored, calibrate)


def learn(rows: DataFrame, f: DataFrame, columns: list[str], kind: str, train: list[str] | None = None, score: list[str] | None = None, calibrate: str = "isotonic", **params) -> DataFrame:
    """Predictions of a learner: fitted on the fit window, calibrated on the inner one (isotonic, platt or none), with the threshold chosen there."""
    return learned(deal(rows, f, train, score), columns, kind, calibrate, **params)


def learned(dealt: DataFrame, columns: list[str], kind: str, calibrate: str = "isotonic", **params) -> DataFrame:
    """As `learn`, over rows from `deal`."""
    numbers = sorted(r[0] for r in dealt.select("fold").distinct().collect())  # the folds, a few
    if not numbers:
        raise ValueError("no fold has rows in all of its parts")
    if kind in models.BOOSTED:
        model = boosting.fit(dealt.where("part = 'fit'"), columns, ["fold"], models.growth(kind, **params))
        scored = boosting.score(model, dealt.where("part <> 'fit'"))
    else:
        scored = None
        for fold in numbers:
            own = dealt.where(F.col("fold") == fold)
            one = models.fit_predict(own.where("part = 'fit'"), own.where("part <> 'fit'"), columns, kind, **params)
            scored = one if scored is None else scored.unionByName(one)
    named = scored.select("date", "ticker", "fold", "part", "y", "p", F.lit(kind).alias("model"), F.lit(False).alias("is_baseline"))
    if calibrate != "platt":
        return finished(named, calibrate)
    out = None
    for fold in numbers:
        own = named.where(F.col("fold") == fold)
        one = models.platt(own.where("part = 'inner'"), own.withColumn("_raw", F.col("p")))
        out = one if out is None else out.unionByName(one)
    return finished(out, "none").drop("prob_raw").join(out.where("part = 'test'").select("date", "ticker", "fold", F.col("_raw").alias("prob_raw")), ["date", "ticker", "fold"]).select(*PREDICTION)


def fold_metrics(predictions: DataFrame, dealt: DataFrame | None = None) -> DataFrame:
    """By model and fold: all metrics at 0.5, those that change at the chosen threshold (tuned_), and the calibration of the raw probabilities.

    With the rows from `deal`, also n_fit, n_inner and n_test. Predictions are counted once by their distinct probabilities and stored, as
    everything else is computed from those counts.
    """
    keys, y = ["model", "fold"], F.col("y_true")
    known = metrics.usable(predictions.withColumnsRenamed({"prob": "p", "y_true": "y"})).withColumnsRenamed({"p": "prob", "y": "y_true"})
    base = kept(known.groupBy(*keys, "prob", "prob_raw").agg(
        F.count("*").alias("c"), F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.min("date").alias("first"), F.max("date").alias("last"), F.first("threshold").alias("threshold"), F.first("is_baseline").alias("is_baseline")
    ), "counted-predictions")
    by = lambda name: base.groupBy(*keys, F.col(name).alias("p")).agg(F.sum("c").alias("c"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    raw = metrics.evaluate_counts(by("prob_raw"), keys).select(*keys, F.col("ece").alias("ece_uncalibrated"), F.col("brier").alias("brier_uncalibrated"))
    hit, n = F.col("prob") >= F.col("threshold"), lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0.0)).cast("long")
    chosen = base.groupBy(*keys).agg(
        F.first("is_baseline").alias("is_baseline"), F.min("first").alias("test_start"), F.max("last").alias("test_end"), F.first("threshold").alias("tuned_threshold"),
        F.sum("c").alias("n"), n(hit, "pos").alias("tp"), n(hit, "neg").alias("fp"), n(~hit, "pos").alias("fn"), n(~hit, "neg").alias("tn"),
    )
    tuned = metrics.shares(chosen).select(*keys, "is_baseline", "test_start", "test_end", "tuned_threshold", *(F.col(c).alias(f"tuned_{c}") for c in ("accuracy", "precision", "recall", "f1", "positive_rate")))
    out = tuned.join(metrics.evaluate_counts(by("prob"), keys), keys).join(raw, keys)
    return out if dealt is None else out.join(F.broadcast(sizes(dealt)), "fold")


def leaderboard(m: DataFrame) -> DataFrame:
    """Mean and standard error over the folds, by model."""
    known = [c for c in MEASURES if c in m.columns]
    sem = lambda c: (F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_se")
    return m.groupBy("model").agg(F.count("*").alias("folds"), F.first("is_baseline").alias("is_baseline"), *(F.avg(c).alias(c) for c in known), *(sem(c) for c in known))
