"""Learners of the panel as Spark ML estimators whose models are stored and loaded, with a card beside them.

A fitted PanelModel holds the learner, the calibration of the inner window and the threshold chosen there. Trees are stored as a table of
nodes; other learners as Spark ML stores them.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import boosting, folds, metrics, models

STEPS = "array<struct<low:double,high:double,pos:double,c:double>>"


class PanelLearner(Estimator):
    """Fits on rows(y, part, columns): the learner on part `fit`, calibration and threshold on `inner`."""

    def __init__(self, columns: list[str], kind: str = "logistic", card: dict | None = None, **params):
        super().__init__()
        self.columns, self.kind, self.card, self.params_ = columns, kind, card or {}, params

    def _fit(self, rows: DataFrame) -> PanelModel:
        fit, inner = rows.where("part = 'fit' and y is not null"), rows.where("part = 'inner' and y is not null")
        n = fit.count()
        if self.kind in models.BOOSTED:
            learner = boosting.fit(fit, self.columns, growth=models.growth(self.kind, **self.params_))
        else:
            learner = models.pipeline(self.kind, self.columns, max(1, n), **self.params_).fit(fit)
        card = self.card | {"kind": self.kind, "columns": self.columns, "n_fit": n, "n_inner": inner.count()}
        raw = PanelModel(learner, card | {"steps": None, "low": None, "threshold": 0.5})
        scored = raw.transform(inner).withColumn("_one", F.lit(0)).select("_one", "y", F.col("prob_raw").alias("p"))
        steps = models.isotonic_steps(scored, ["_one"]).first()  # one row
        if steps is not None and steps["classes"] == 2:
            card |= {"steps": [list(s) for s in steps["steps"]], "low": min(1 / (steps["n"] + 2), 0.01)}
        else:
            card |= {"steps": None, "low": None}
        calibrated = PanelModel(learner, card | {"threshold": 0.5}).transform(inner).select(F.lit(0).alias("_one"), "y", F.col("prob").alias("p"))
        chosen = metrics.select_threshold(calibrated, ["_one"]).first()
        return PanelModel(learner, card | {"threshold": chosen["threshold"] if chosen else 0.5})


class PanelModel(Model):
    """Adds prob_raw, prob (calibrated) and flagged (prob reaches the threshold)."""

    def __init__(self, learner, card: dict):
        super().__init__()
        self.learner, self.card = learner, card

    def _transform(self, rows: DataFrame) -> DataFrame:
        if isinstance(self.learner, boosting.Boosted):
            raw = boosting.score(self.learner, rows, "prob_raw").drop("margin")
        else:
            raw = self.learner.transform(rows).withColumn("prob_raw", vector_to_array("probability")[1]).select(*rows.columns, "prob_raw")
        p = F.col("prob_raw")
        if self.card["steps"]:
            low = self.card["low"]
            steps = F.from_json(F.lit(json.dumps([dict(zip(("low", "high", "pos", "c"), s)) for s in self.card["steps"]])), STEPS)
            p = F.least(F.greatest(models.stepped(p, steps), F.lit(low)), F.lit(1 - low))
        return raw.withColumn("prob", p).withColumn("flagged", F.col("prob") >= self.card["threshold"])

    def save(self, path: str) -> None:
        """The learner and its card, in a folder that doesn't exist yet. The card comes last, so a folder without one is no model."""
        spark = SparkSession.active()
        if isinstance(self.learner, boosting.Boosted):
            spark.createDataFrame(self.learner.node_rows(), boosting.NODE).coalesce(1).write.parquet(f"{path}/learner")
        else:
            self.learner.save(f"{path}/learner")
        spark.createDataFrame([(json.dumps(self.card),)], "card string").coalesce(1).write.text(f"{path}/card")

    @staticmethod
    def load(path: str) -> PanelModel:
        spark = SparkSession.active()
        card = json.loads(spark.read.text(f"{path}/card").first()[0])
        if card["kind"] in models.BOOSTED:
            nodes = [tuple(r) for r in spark.read.schema(boosting.NODE).parquet(f"{path}/learner").collect()]  # the model itself
            return PanelModel(boosting.from_rows(card["columns"], nodes, models.BOOSTED[card["kind"]]), card)
        return PanelModel(PipelineModel.load(f"{path}/learner"), card)


def serving_parts(rows: DataFrame, inner: int = 120, purge: int = 1, embargo: int = 5) -> DataFrame:
    """rows(date, ...) with part: fit up to the serving split's fit end, inner from its start; the gap between goes."""
    split = folds.serving(folds.sessions(rows), inner, purge, embargo).select("fit_end_date", "inner_start_date")
    part = F.when(F.col("date") <= F.col("fit_end_date"), "fit").when(F.col("date") >= F.col("inner_start_date"), "inner")
    return rows.crossJoin(F.broadcast(split)).withColumn("part", part).where("part is not null").drop("fit_end_date", "inner_start_date")  # one row


def usable(card: dict, version: str, trained_through: str) -> bool:
    """Whether a stored model may serve: made from these features, up to the last session."""
    return card.get("feature_version") == version and card.get("trained_through") == trained_through


def serve(rows: DataFrame, columns: list[str], folder: str, kind: str = "logistic", version: str = "1", **params) -> PanelModel:
    """The stored model of the kind for the panel rows(date, y, columns), fitted and stored first where there is none that may serve."""
    spark = rows.sparkSession
    last = str(rows.agg(F.max("date")).first()[0])
    path = f"{folder}/{kind}-{version}-{last}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/card/_SUCCESS")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        model = PanelModel.load(path)
        if usable(model.card, version, last):
            return model
    model = PanelLearner(columns, kind, {"feature_version": version, "trained_through": last}, **params).fit(serving_parts(rows))
    model.save(path)
    return model
