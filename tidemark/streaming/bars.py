"""Streams of ticks and bars."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.regime import log_density
from tidemark.sources import versions


def tumbling_bars(ticks: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Bars of a stream of ticks(ts, ticker, price, quantity, seq) by event time; what is later than `late` is dropped."""
    w = ticks.withWatermark("ts", late).groupBy(F.window("ts", width), "ticker")
    bars = w.agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("quantity").alias("volume"))
    return bars.select("ticker", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def upsert_sink(path: str, keys: list[str]):
    """For foreachBatch: merges each batch into the versioned table at path, keeping the last value of a key. A batch that comes again changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        versions.merge(batch, path, keys)

    return merge


def expiring(rows: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """ticker, ts, value and status of a stream of (ticker, ts, value): the newest value of each key, and again as `stale` once event time has passed it by so many seconds.

    The state of a key is its newest value; when it expires it is emitted and dropped, so idle keys cost nothing. A value that comes when it
    is already that old is stale at once. Rows later than `late` may be dropped, as watermarks do.
    """

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            value, ms = state.get
            state.remove()
            yield pd.DataFrame({"ticker": [key[0]], "ts": [pd.Timestamp(ms, unit="ms")], "value": [value], "status": ["stale"]})
            return
        value, ms = state.get if state.exists else (math.nan, -1)
        new = False
        for rows in batches:
            at = rows["ts"].astype("datetime64[ms]").astype("int64")
            k = at.to_numpy().argmax()
            if at.iloc[k] >= ms:
                value, ms, new = float(rows["value"].iloc[k]), int(at.iloc[k]), True
        if not new:
            return
        due, now = ms + seconds * 1000, state.getCurrentWatermarkMs()
        if due > now:
            state.update((value, ms))
            state.setTimeoutTimestamp(due)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"ticker": [key[0]], "ts": [pd.Timestamp(ms, unit="ms")], "value": [value], "status": ["fresh" if due > now else "stale"]})

    out = "ticker string, ts timestamp, value double, status string"
    return rows.select("ticker", "ts", "value").withWatermark("ts", late).groupBy("ticker").applyInPandasWithState(step, out, "value double, ms long", "append", GroupStateTimeout.EventTimeTimeout)


def rate(events: DataFrame, limit: int = 120, seconds: int = 60) -> DataFrame:
    """events(user_id, ts) with the number of the user's events in the last seconds, and whether it passes the limit."""
    from pyspark.sql import Window

    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(t).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("limited", F.col("recent") > limit)


def on_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """A stream of bars without those dated on days that aren't in the static calendar(date)."""
    return bars.join(calendar.select("date"), "date", "left_semi")


def ewm_stream(bars: DataFrame, alpha: float, least: int = 1) -> DataFrame:
    """ticker, date, value and mean of a stream of (ticker, date, value): the exponential mean, its last value and count being the state.

    Rows of a batch are taken in the order of their dates; a missing value keeps the mean.
    """

    def step(key, batches, state: GroupState):
        mean, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(batches).sort_values("date")
        out = []
        for x in rows["value"]:
            if not math.isnan(x):
                mean, n = (x if n == 0 else (1 - alpha) * mean + alpha * x), n + 1
            out.append(mean if n >= least else None)
        state.update((float(mean), n))
        yield pd.DataFrame({"ticker": key[0], "date": rows["date"], "value": rows["value"], "mean": pd.Series(out, rows.index, dtype=float)})

    return bars.select("ticker", "date", "value").groupBy("ticker").applyInPandasWithState(step, "ticker string, date date, value double, mean double", "mean double, n long", "append", GroupStateTimeout.NoTimeout)


def regime_stream(rows: DataFrame, columns: list[str], model: tuple[np.ndarray, ...], key: str = "market") -> DataFrame:
    """key, date, state and posterior of a stream of (key, date, columns): filtered posteriors of a fitted hidden Markov model (regime.fit_hmm).

    The state that is carried from batch to batch is the posterior of the last row, so no row is looked at twice.
    """
    start, moves, means, covs = model
    lm = np.log(np.maximum(moves, 1e-300))

    def step(name, batches, state: GroupState):
        pdf = pd.concat(batches).sort_values("date")
        before = np.array(state.get[0]) if state.exists else None
        out = []
        for row in log_density(pdf[columns].to_numpy(float), means, covs):
            prior = np.log(start + 1e-300) if before is None else np.logaddexp.reduce(before[:, None] + lm, axis=0)
            a = prior + row
            before = a - np.logaddexp.reduce(a)
            out.append(np.exp(before))
        state.update((before.tolist(),))
        yield pd.DataFrame({key: name[0], "date": pdf["date"], "state": [int(p.argmax()) for p in out], "posterior": [p.tolist() for p in out]})

    return rows.select(key, "date", *columns).groupBy(key).applyInPandasWithState(step, f"{key} string, date date, state long, posterior array<double>", "posterior array<double>", "append", GroupStateTimeout.NoTimeout)
