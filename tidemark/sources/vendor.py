"""Vendors of daily bars as Spark data sources: a partition for each symbol, filters on symbols and dates pushed to the requests.

The transport is injected: fetch(symbol, start, end) gives the body of a reply, and may raise. It runs in the tasks, so a vendor's bars are
fetched side by side and never pass through the driver.
"""

from __future__ import annotations

import datetime
import io
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidemark.operators.bars import SYMBOL

# Columns of bars, and what a page that asks for a browser begins with.
COLUMNS = ("open", "high", "low", "close", "adj_close", "volume")
CHALLENGES = ("<!doctype html", "requires javascript")
SCHEMA = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double"
Fetch = Callable[[str, datetime.date | None, datetime.date | None], str]
DAY = datetime.timedelta(days=1)


class VendorError(Exception):
    """A vendor didn't give usable bars."""


def parse_csv(body: str) -> pd.DataFrame:
    """Bars of a CSV body with a header; adjusted closes are the closes where there are none. Repeated dates keep the last row."""
    if any(c in body[:400].lower() for c in CHALLENGES):
        raise VendorError("the vendor asks for a browser")
    if not body.lower().startswith("date"):
        raise ValueError(f"not a table of bars: {body[:60]!r}")
    rows = pd.read_csv(io.StringIO(body))
    rows.columns = [c.strip().lower().replace(" ", "_") for c in rows.columns]
    if "adj_close" not in rows and "close" in rows:
        rows["adj_close"] = rows["close"]
    lacking = [c for c in COLUMNS if c not in rows]
    if lacking:
        raise VendorError(f"columns are missing: {lacking}")
    rows["date"] = pd.to_datetime(rows["date"], errors="coerce").dt.date
    if not len(rows):
        raise ValueError("no rows")
    return rows[rows["date"].notna()].drop_duplicates("date", keep="last").sort_values("date")


class Symbol(InputPartition):
    def __init__(self, symbol: str):
        super().__init__(symbol)


class Reader(DataSourceReader):
    def __init__(self, options, fetch: Fetch, parse: Callable[[str], pd.DataFrame], form: Callable[[str], str]):
        self.fetch, self.parse, self.form = fetch, parse, form
        self.symbols = [s.strip().upper() for s in options.get("symbols", "").split(",") if s.strip()]
        wrong = [s for s in self.symbols if not re.fullmatch(SYMBOL, s)]
        if wrong:
            raise VendorError(f"not symbols: {wrong}")
        read = lambda name: datetime.date.fromisoformat(options[name]) if options.get(name) else None
        self.start, self.end = read("start"), read("end")
        self.attempts, self.wait = int(options.get("attempts", 2)), float(options.get("wait", 0.5))

    def pushFilters(self, filters) -> Iterator:  # noqa: N802
        """Takes equality and membership of symbols and bounds of dates; gives back the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "ticker" and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = [s for s in self.symbols if s in asked]
            elif name == "date" and isinstance(f, EqualTo):
                self.bound(f.value, f.value)
            elif name == "date" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.bound(f.value + DAY * isinstance(f, GreaterThan), None)
            elif name == "date" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.bound(None, f.value - DAY * isinstance(f, LessThan))
            else:
                yield f

    def bound(self, start, end) -> None:
        self.start = max(filter(None, (self.start, start)), default=None)
        self.end = min(filter(None, (self.end, end)), default=None)

    def partitions(self) -> list[Symbol]:
        return [Symbol(s) for s in dict.fromkeys(self.symbols)]

    def read(self, partition: Symbol) -> Iterator[pa.RecordBatch]:
        symbol, last = partition.value, None
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(self.wait * 2 ** (attempt - 1))
            try:
                rows = self.parse(self.fetch(self.form(symbol), self.start, self.end))
                break
            except VendorError:
                raise
            except Exception as e:  # the transport's own errors are of any kind
                last = e
        else:
            raise VendorError(f"{symbol}: no bars in {self.attempts} attempts") from last
        if self.start:
            rows = rows[rows["date"] >= self.start]
        if self.end:
            rows = rows[rows["date"] <= self.end]
        cols = [pa.array([symbol] * len(rows), pa.string()), pa.array(rows["date"].tolist(), pa.date32()), *(pa.array(rows[c].astype(float), pa.float64(), from_pandas=True) for c in COLUMNS)]
        yield pa.RecordBatch.from_arrays(cols, names=["ticker", "date", *COLUMNS])


def suffixed(symbol: str) -> str:
    """The form of symbols of a vendor that writes them in lower case, shares with a suffix and classes with a dot."""
    return symbol.lower() if symbol.startswith("^") else f"{symbol.replace('-', '.').lower()}.us"


def vendor(format_name: str, fetch: Fetch, parse: Callable[[str], pd.DataFrame] = parse_csv, form: Callable[[str], str] = str) -> type[DataSource]:
    """A data source to register with Spark. Options: symbols (comma-separated), start, end, attempts, wait (seconds, doubled each time)."""

    class Vendor(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            return Reader(self.options, fetch, parse, form)

    return Vendor


def vendor_bars(spark: SparkSession, source: type[DataSource], symbols: list[str], start: str | None = None, end: str | None = None, **options) -> DataFrame:
    """Bars of the symbols. Filters on ticker and date that are put on the result reach the requests."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("symbols", ",".join(symbols))
    for name, value in {"start": start, "end": end, **options}.items():
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load()
