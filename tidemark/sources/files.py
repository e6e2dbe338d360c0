"""Readers and writers of bars, panels, runs and artefacts."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of bars, and names that a vendor's payloads use.
BARS = T.StructType([T.StructField("date", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close", "volume"))])
RUNS = "run_id string, config string, config_hash string, target string, experiment string"
DAILY = "map<string,struct<`1. open`:double,`2. high`:double,`3. low`:double,`4. close`:double,`5. adjusted close`:double,`6. volume`:double>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str = "query") -> str:
    """A new folder for what is written and read again: in the folder that the cluster shares, a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='tidemark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df written in the shared folder, in folders by some columns, and read again: it is made once and survives lost executors."""
    folder = scratch(df.sparkSession, name)
    df.write.partitionBy(*by or []).parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.kept_at = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `kept` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def local(df: DataFrame) -> DataFrame:
    """A few rows (folds, sessions) as a relation of their own, so that plans which use them often don't compute them again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def csv_bars(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None, partitioned: bool = False) -> DataFrame:
    """One file for each symbol, named after it, or (partitioned) a folder ticker=SYMBOL; INDEX_ in a name stands for ^. The dates are inclusive."""
    if partitioned:
        read = spark.read.schema(T.StructType([*BARS.fields, T.StructField("ticker", T.StringType())])).option("header", True).csv(folder)
        name = F.col("ticker")
    else:
        read = spark.read.schema(BARS).option("header", True).csv(folder)
        name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return between(read.withColumn("ticker", F.regexp_replace(name, "^INDEX_", "^")), start, end)


def between(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    return bars.where(F.col("date") <= F.lit(end).cast("date")) if end else bars


def parquet_bars(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return between(spark.read.parquet(folder), start, end)


def json_folder(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A file SYMBOL.json for each symbol, as a vendor sends it."""
    raw = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("ticker"), F.col("value").alias("body"))
    return between(json_bars(raw), start, end)


#: Readers by name; each takes (spark, folder, start, end) and gives bars of all its symbols.
PROVIDERS = {"csv": csv_bars, "parquet": parquet_bars, "json": json_folder}


def provider(name: str):
    """The reader of that name."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider: {name} (known: {', '.join(sorted(PROVIDERS))})")
    return PROVIDERS[name]


def no_bars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField("ticker", T.StringType()), *BARS.fields]))


def one_instrument(bars: DataFrame, symbol: str) -> DataFrame:
    """The rows of one instrument, before anything is computed, so that the same plan serves a panel and a single request."""
    return bars.where(F.col("ticker") == symbol)


def json_bars(raw: DataFrame) -> DataFrame:
    """raw(ticker, body): a vendor's nested daily series, exploded into bars."""
    parsed = raw.select("ticker", F.explode(F.from_json(F.get_json_object("body", "$['Time Series (Daily)']"), DAILY)).alias("date", "v"))
    names = zip(("open", "high", "low", "close", "adj_close", "volume"), ("1. open", "2. high", "3. low", "4. close", "5. adjusted close", "6. volume"))
    return parsed.select("ticker", F.col("date").cast("date").alias("date"), *(F.col("v").getField(n).alias(c) for c, n in names))


def coerce(raw: DataFrame) -> DataFrame:
    """Lower-case names, known aliases, adj_close from close where it is missing, doubles; raises on missing columns."""
    alias = {"adjclose": "adj_close", "adj close": "adj_close", "adjusted_close": "adj_close"}
    df = raw.toDF(*(alias.get(c.strip().lower(), c.strip().lower()) for c in raw.columns))
    if "adj_close" not in df.columns and "close" in df.columns:
        df = df.withColumn("adj_close", F.col("close"))
    if missing := [c for c in BARS.names if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    keep = [c for c in df.columns if c not in BARS.names]
    return df.select(*keep, F.col("date").cast("date").alias("date"), *(F.col(c).cast("double").alias(c) for c in BARS.names[1:])).where("date is not null")


def write_panel(panel: DataFrame, path: str, **about: str) -> None:
    """Partitioned by group, so that a choice of groups prunes files; what is known about the panel is a record beside it."""
    panel.write.mode("overwrite").partitionBy("group").option("compression", "zstd").parquet(path)
    record = {"columns": ",".join(panel.columns)} | about
    panel.sparkSession.createDataFrame([record]).coalesce(1).write.mode("overwrite").json(f"{path}.meta")


def read_panel(spark: SparkSession, path: str, groups: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The panel, of some groups or all, with its record; a panel without a record is an error."""
    about = spark.read.json(f"{path}.meta").first().asDict()
    panel = spark.read.parquet(path)
    return (panel if groups is None else panel.where(F.col("group").isin(groups))).select(*about["columns"].split(",")), about


def clear(spark: SparkSession, path: str, ticker: str | None = None) -> None:
    """Empty a table partitioned by ticker, or one ticker's partition of it."""
    old = spark.read.parquet(path)
    empty = old.limit(0).drop("ticker") if ticker else old.limit(0)
    empty.write.mode("overwrite").parquet(f"{path}/ticker={ticker}" if ticker else path)


def compact(predictions: DataFrame) -> DataFrame:
    """Narrow types for publishing."""
    return predictions.select("date", "ticker", F.col("fold").cast("short"), "model", F.col("p").cast("float"), F.col("y").cast("float"))


def save_run(run_id: str, record: dict, predictions: DataFrame, fold_metrics: DataFrame, path: str) -> None:
    """A run's predictions and metrics by run_id, and its record, with the configuration as JSON, at the end of the index."""
    spark = predictions.sparkSession
    for name, df in (("predictions", predictions), ("fold_metrics", fold_metrics)):
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").option("compression", "zstd").parquet(f"{path}/{name}")
    config = json.dumps(record.get("config", {}), sort_keys=True)
    row = {"run_id": run_id, "config": config, "config_hash": hashlib.sha256(config.encode()).hexdigest()[:12], "target": str(record.get("target", "")), "experiment": str(record.get("experiment", ""))}
    append_run(spark.createDataFrame([row], RUNS), f"{path}/index")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The index of runs; without one, no rows."""
    try:
        return read_runs(spark, f"{path}/index", RUNS)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RUNS)


def run_table(spark: SparkSession, path: str, name: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").where(F.col("run_id") == run_id).drop("run_id")


def latest_run(index: DataFrame) -> DataFrame:
    """The last run of each target and experiment; run ids begin with their time."""
    return index.groupBy("target", "experiment").agg(F.max("run_id").alias("run_id"))


def manifest(predictions: DataFrame) -> DataFrame:
    """One row: rows, models, folds, and the first and last session."""
    return predictions.agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.countDistinct("fold").alias("folds"), F.min("date").alias("first"), F.max("date").alias("last"))


def markdown(df: DataFrame, places: int = 4) -> str:
    """A table of a small result, for a report."""
    cell = lambda v: "" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def append_run(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
