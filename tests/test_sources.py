import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, vendor, versions
from tidemark.streaming import bars as S


def test_csv_folder(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("date,open,high,low,close,adj_close,volume\n2020-01-02,1,2,0.5,1.5,1.5,10\n2020-01-03,1,2,0.5,1.6,1.6,11\n")
    (tmp_path / "INDEX_VIX.csv").write_text("date,open,high,low,close,adj_close,volume\n2020-01-02,9,9,9,9,9,0\n")
    got = files.csv_bars(spark, str(tmp_path), end="2020-01-02").orderBy("ticker").collect()
    assert [(r.ticker, r.close) for r in got] == [("AAA", 1.5), ("^VIX", 9.0)]


def test_coercion(spark):
    raw = spark.createDataFrame([("2020-01-02", 1, 2, 1, 2, 5)], ["Date", "Open", "High", "Low", "Close", "Volume"])
    assert files.coerce(raw).first().adj_close == 2.0
    with pytest.raises(ValueError, match="volume"):
        files.coerce(raw.drop("Volume"))


def test_json_series(spark):
    body = '{"Time Series (Daily)": {"2020-01-02": {"1. open": 1.0, "2. high": 2.0, "3. low": 0.5, "4. close": 1.5, "5. adjusted close": 1.4, "6. volume": 9}}}'
    row = files.json_bars(spark.createDataFrame([("A", body), ("B", None)], "ticker string, body string")).collect()
    assert len(row) == 1 and row[0].date == datetime.date(2020, 1, 2) and row[0].adj_close == 1.4


def test_stream_of_ticks_and_upserts(spark, tmp_path):
    rows = [(datetime.datetime(2020, 1, d, 10, m), "A", 10.0 * d + m, 1.0, d * 100 + m) for d in (1, 2, 6) for m in (0, 5, 9)]
    spark.createDataFrame(rows, "ts timestamp, ticker string, price double, quantity double, seq long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, ticker string, price double, quantity double, seq long").parquet(str(tmp_path / "in"))
    sink = S.upsert_sink(str(tmp_path / "out"), ["ticker", "start"])
    q = S.tumbling_bars(stream).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = versions.read(spark, str(tmp_path / "out"))
    assert sorted((r.open, r.close, r.volume) for r in got.collect()) == [(10.0, 19.0, 3.0), (20.0, 29.0, 3.0), (60.0, 69.0, 3.0)]


def test_rate(spark):
    t = datetime.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, t), (1, t + datetime.timedelta(seconds=59)), (1, t + datetime.timedelta(seconds=61)), (2, t)], "user_id long, ts timestamp")
    assert sorted(r.recent for r in S.rate(ev, 1).collect()) == [1, 1, 2, 2]
    assert S.rate(ev, 1).where(F.col("limited")).count() == 2


def test_providers(spark, tmp_path):
    assert files.provider("csv") is files.csv_bars and files.no_bars(spark).count() == 0
    with pytest.raises(ValueError, match="unknown provider"):
        files.provider("pigeon")
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "A.json").write_text('{"Time Series (Daily)": {"2020-01-02": {"1. open": 1.0, "2. high": 2.0, "3. low": 0.5, "4. close": 1.5, "5. adjusted close": 1.4, "6. volume": 9}}}')
    assert files.provider("json")(spark, str(tmp_path / "j")).first().ticker == "A"
    assert files.provider("json")(spark, str(tmp_path / "j"), "2020-02-01").count() == 0


def test_panel_and_runs_are_stored(spark, tmp_path):
    p = spark.createDataFrame([("A", "dev", 1.0), ("B", "test", 2.0)], "ticker string, group string, x double")
    files.write_panel(p, str(tmp_path / "p"), label="direction")
    back, about = files.read_panel(spark, str(tmp_path / "p"), ["test"])
    assert [r.ticker for r in back.collect()] == ["B"] and about["label"] == "direction" and back.columns == p.columns
    assert files.runs(spark, str(tmp_path / "r")).count() == 0
    for k in (1, 2):
        files.save_run(f"r{k}", {"target": "t", "experiment": "e", "config": {"b": 1, "a": k}}, p, p.where("x = 1"), str(tmp_path / "r"))
    index = files.runs(spark, str(tmp_path / "r"))
    assert index.count() == 2 and files.latest_run(index).first().run_id == "r2" and len({r.config_hash for r in index.collect()}) == 2
    assert files.run_table(spark, str(tmp_path / "r"), "predictions", "r1").count() == 2
    assert files.markdown(p.orderBy("ticker")).splitlines()[2] == "| A | dev | 1.0000 |"
    p.write.partitionBy("ticker").parquet(str(tmp_path / "c"))
    files.clear(spark, str(tmp_path / "c"), "A")
    assert [r.ticker for r in spark.read.parquet(str(tmp_path / "c")).collect()] == ["B"]


def played(spark, tmp_path, rows, schema, make):
    """Rows of each batch in a file of its own, as a stream."""
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    return spark.read.parquet(str(tmp_path / "out"))


def test_exponential_mean_of_a_stream(spark, tmp_path):
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k)
    values = [1.0, 3.0, 2.0, float("nan"), 5.0, 4.0]
    batches = [[("A", day(k), values[k]) for k in part] for part in ((0, 1), (2, 3), (4, 5))]
    days = spark.createDataFrame([(day(k),) for k in range(5)], "date date")
    got = played(spark, tmp_path, batches, "ticker string, date date, value double", lambda s: S.ewm_stream(S.on_sessions(s, days), 0.5, 2))
    assert [r["mean"] for r in got.orderBy("date").collect()] == [None, 2.0, 2.0, 2.0, 3.5]


def test_filtered_regimes_of_a_stream(spark, tmp_path):
    import numpy as np

    from tidemark.operators import regime

    x = np.concatenate([np.random.default_rng(1).normal(0, s, (40, 1)) for s in (0.5, 3.0)])
    model = regime.fit_hmm(x, 2)
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k)
    batches = [[("m", day(k), float(x[k, 0])) for k in range(a, a + 40)] for a in (0, 40)]
    got = played(spark, tmp_path, batches, "market string, date date, v double", lambda s: S.regime_stream(s, ["v"], model)).orderBy("date").collect()
    assert np.allclose([r.posterior for r in got], regime.forward_filter(x, *model)) and len(got) == 80


def test_values_expire(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    batches = [[("A", at(0), 1.0), ("B", at(5), 2.0)], [("A", at(50), 3.0)], [("C", at(100), 4.0)], [("C", at(130), 5.0), ("D", at(20), 9.0)]]
    got = played(spark, tmp_path, batches, "ticker string, ts timestamp, value double", lambda s: S.expiring(s, 60)).collect()
    rows = [(r.ticker, (r.ts - t0).seconds, r.value, r.status) for r in got]
    fresh, stale = [r[:3] for r in rows if r[3] == "fresh"], [r[:3] for r in rows if r[3] == "stale"]
    assert ("A", 0, 1.0) in fresh and ("A", 50, 3.0) in fresh and ("C", 130, 5.0) in fresh
    # B passed its time while others went on; A's first value was replaced in time, its second expired later.
    assert ("B", 5, 2.0) in stale and ("A", 0, 1.0) not in stale and ("A", 50, 3.0) in stale and not any(r[0] == "C" for r in stale)


def test_versions_are_published_whole(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert versions.read(spark, folder) is None
    day = lambda d: datetime.date(2020, 1, d)
    bars = lambda rows: spark.createDataFrame(rows, "ticker string, date date, close double")
    versions.publish(bars([("A", day(2), 1.0), ("B", day(3), 2.0)]), folder)
    broken = bars([("A", day(9), 9.0)]).withColumn("close", F.expr("if(close > 0, raise_error('no'), 0D)"))
    with pytest.raises(Exception, match="no"):
        versions.publish(broken, folder)
    assert sorted(r.close for r in versions.read(spark, folder).collect()) == [1.0, 2.0]
    for _ in range(2):  # a batch that comes again
        versions.merge(bars([("A", day(2), 5.0), ("A", day(6), 6.0)]), folder, ["ticker", "date"])
    assert sorted(r.close for r in versions.read(spark, folder).collect()) == [2.0, 5.0, 6.0]
    assert len(versions.versions(spark, folder)) == versions.KEEP
    by = {r.ticker: r for r in versions.fresh(spark, folder, 3600, "2020-01-06").collect()}
    assert by["A"].fresh and not by["B"].fresh and 0 <= by["A"].age_seconds < 3600 and (by["A"].first, by["A"].last) == (day(2), day(6))
    assert not any(r.fresh for r in versions.fresh(spark, folder, 3600, "2020-01-02", now="2099-01-01").collect())
    path = versions.current(spark, folder).removeprefix("file:")
    with open(f"{path}/part-damaged.parquet", "wb") as f:
        f.write(b"PAR1 half of a file")
    assert versions.set_aside(spark, folder) == ["part-damaged.parquet"] and versions.read(spark, folder).count() == 3


def test_vendor_as_a_data_source(spark, tmp_path):
    """A stub transport, which notes every request: filters reach it, failures are tried again, challenges aren't."""
    notes = str(tmp_path)

    def fetch(symbol, start, end):
        import os
        import uuid

        with open(os.path.join(notes, uuid.uuid4().hex), "w") as f:
            f.write(f"{symbol} {start} {end}")
        if symbol == "flaky.us" and sum("flaky" in open(os.path.join(notes, n)).read() for n in os.listdir(notes)) < 2:
            raise OSError("timed out")
        if symbol == "shut.us":
            return "<!DOCTYPE html><html>requires JavaScript"
        if symbol == "dead.us":
            raise OSError("gone")
        return "Date,Open,High,Low,Close,Volume\n" + "".join(f"2020-01-{d:02d},1,2,0.5,{d},10\n" for d in (6, 2, 3, 3, 9))

    source = vendor.vendor("stub_bars", fetch, form=vendor.suffixed)
    asked = lambda: sorted(p.read_text() for p in tmp_path.iterdir())
    bars = vendor.vendor_bars(spark, source, ["BRK-B", "^VIX", "AAA"], start="2020-01-01", wait=0)
    got = bars.where("ticker in ('BRK-B', '^VIX') and date > date'2020-01-02' and date <= date'2020-01-06' and close > 3").collect()
    assert sorted((r.ticker, r.date.day, r.adj_close) for r in got) == [("BRK-B", 6, 6.0), ("^VIX", 6, 6.0)]
    assert set(asked()) == {"^vix 2020-01-03 2020-01-06", "brk.b.us 2020-01-03 2020-01-06"}
    assert vendor.vendor_bars(spark, source, ["FLAKY"], wait=0).count() == 4
    with pytest.raises(Exception, match="asks for a browser"):
        vendor.vendor_bars(spark, source, ["SHUT"], attempts=3, wait=0).collect()
    assert len([x for x in asked() if x.startswith("shut")]) <= 4  # a try of the task, not three of each
    with pytest.raises(Exception, match="no bars in 2 attempts"):
        vendor.vendor_bars(spark, source, ["DEAD"], wait=0).collect()
    with pytest.raises(Exception, match="not symbols"):
        vendor.vendor_bars(spark, source, ["../etc"]).collect()
