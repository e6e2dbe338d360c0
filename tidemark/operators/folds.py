"""Purged, embargoed walk-forward folds as data, and their assignment by a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = ("fit", "inner", "test")


def sessions(bars: DataFrame) -> DataFrame:
    """date, pos: the distinct dates and their position. One row a date, so a single partition holds them."""
    return bars.select("date").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def folds(days: DataFrame, init: int = 1512, test: int = 126, step: int = 126, inner: int = 120, purge: int = 1, embargo: int = 5, rolling: int | None = None) -> DataFrame:
    """fold and, for each part, first and last position and date; windows that don't fit are left out and the rest numbered from 0."""
    gap = purge + embargo
    n = days.agg(F.count("*").alias("n"))
    k = n.select("n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n") - init) / step).cast("int")))).alias("k"))
    a = k.select("n", (init + F.col("k") * step).alias("test_start")).withColumn("test_end", F.col("test_start") + test - 1).where("test_end < n")
    b = a.withColumn("inner_end", F.col("test_start") - gap - 1).withColumn("inner_start", F.col("inner_end") - inner + 1).withColumn("fit_end", F.col("inner_start") - gap - 1)
    c = b.withColumn("fit_start", F.lit(0) if rolling is None else F.greatest(F.lit(0), F.col("fit_end") - rolling + 1)).where("inner_start > 0 and fit_end > fit_start")
    out = c.withColumn("fold", (F.row_number().over(Window.orderBy("test_start")) - 1).cast("long"))
    for part in PARTS:
        for end in ("start", "end"):
            d = days.select(F.col("pos").alias(f"{part}_{end}"), F.col("date").alias(f"{part}_{end}_date"))
            out = out.join(d, f"{part}_{end}")
    return out.select("fold", *(F.col(f"{p}_{e}").cast("long").alias(f"{p}_{e}") for p in PARTS for e in ("start", "end")), *(f"{p}_{e}_date" for p in PARTS for e in ("start", "end")))


def search_windows(days: DataFrame, first_test: int, count: int = 3, inner: int = 120, purge: int = 1, embargo: int = 5) -> DataFrame:
    """Windows for choosing parameters that end before the first test session, walking backwards; fits are anchored."""
    gap = purge + embargo
    k = days.sparkSession.range(count).select(F.col("id").alias("k"))
    w = k.withColumn("val_end", first_test - 1 - gap - F.col("k") * inner).withColumn("val_start", F.col("val_end") - inner + 1).withColumn("fit_end", F.col("val_start") - gap - 1)
    return w.where("fit_end > 0").select("k", F.lit(0).cast("long").alias("fit_start"), "fit_end", "val_start", "val_end")


def violations(f: DataFrame, horizon: int = 1) -> DataFrame:
    """Folds whose windows are out of order or closer than the horizon."""
    return f.where((F.col("fit_start") > F.col("fit_end")) | (F.col("inner_start") - F.col("fit_end") <= horizon) | (F.col("inner_start") > F.col("inner_end")) | (F.col("test_start") - F.col("inner_end") <= horizon) | (F.col("test_start") > F.col("test_end")))


def assign(rows: DataFrame, f: DataFrame) -> DataFrame:
    """rows with the fold and part they belong to; a row can be in many folds. The folds, a few rows, are broadcast for the range join."""
    parts = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(f"{p}_start_date").alias("a"), F.col(f"{p}_end_date").alias("b")) for p in PARTS))).alias("x")
    spans = f.select("fold", parts).select("fold", "x.part", "x.a", "x.b")
    return rows.join(F.broadcast(spans), rows.date.between(F.col("a"), F.col("b"))).drop("a", "b")


def evaluated(days: DataFrame, f: DataFrame) -> DataFrame:
    """The sessions that lie in any test window; windows are spread to positions, so the join is on equal keys."""
    tested = f.select(F.explode(F.sequence("test_start", "test_end")).alias("pos")).distinct()
    return days.join(tested, "pos").select("date", "pos")


def serving(days: DataFrame, inner: int = 120, purge: int = 1, embargo: int = 5) -> DataFrame:
    """One row: the windows of a model that serves after the last session. The inner one ends there."""
    n = days.agg(F.count("*").alias("n")).where(F.col("n") > inner + purge + embargo + 1)
    at = n.select((F.col("n") - inner).alias("inner_start"), (F.col("n") - inner - purge - embargo - 1).alias("fit_end"), (F.col("n") - 1).alias("inner_end"))
    for name in ("inner_start", "fit_end", "inner_end"):
        at = at.join(days.select(F.col("pos").alias(name), F.col("date").alias(f"{name}_date")), name)
    return at.select("fit_end", "inner_start", "inner_end", "fit_end_date", "inner_start_date", "inner_end_date")


def holdout(days: DataFrame, share: float = 0.25, shift: float = 0.1) -> DataFrame:
    """date and part: `train` up to the held-out share at the end; `shifted` is train without the first tenth, for a second fit."""
    n = F.count("*").over(Window.partitionBy())
    cut, start = F.floor(n * (1 - share)), F.floor(n * shift)
    return days.select("date", F.when(F.col("pos") >= cut, "holdout").otherwise("train").alias("part"), ((F.col("pos") >= start) & (F.col("pos") < cut)).alias("shifted"))


def label_reach(days: DataFrame, horizon: int) -> DataFrame:
    """The session that a label of each session reaches, the last one at most."""
    w = Window.orderBy("date")
    return days.select("date", F.coalesce(F.lead("date", horizon).over(w), F.max("date").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("reach"))
