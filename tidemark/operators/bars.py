"""Bars: building, cleaning, adjusting, checking and merging them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import is_index, ordered

# What counts as a symbol, and the limits of the validation.
SYMBOL = r"^\^?[A-Z][A-Z0-9]{0,9}(?:[.\-][A-Z0-9]{1,4})?$"
SYMBOL_LENGTH = 16
BENCHMARK = "SPY"
# Names of sectors and the sector that each stands for, and the sectors' funds.
SECTORS = {
    "technology": "technology", "information_technology": "technology", "communication_services": "technology", "financial_services": "financials", "financials": "financials", "healthcare": "healthcare",
    "consumer_cyclical": "consumer_discretionary", "consumer_discretionary": "consumer_discretionary", "consumer_defensive": "consumer_staples", "consumer_staples": "consumer_staples",
    "energy": "energy", "industrials": "industrials", "utilities": "utilities", "basic_materials": "materials", "materials": "materials",
}
FUNDS = {"technology": "XLK", "financials": "XLF", "healthcare": "XLV", "consumer_discretionary": "XLY", "consumer_staples": "XLP", "energy": "XLE", "industrials": "XLI", "utilities": "XLU", "materials": "XLB"}
MAX_RETURN, SLACK, LEAST_ROWS, MISSING_SHARE, ZERO_VOLUME_SHARE = 0.6, 1e-6, 400, 0.02, 0.02


def sector_fund(raw: Column) -> Column:
    """The fund of a sector as a vendor names it; null where the name is unknown (the benchmark may stand for it then)."""
    name = F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit("_"))
    return F.try_element_at(F.create_map(*(F.lit(x) for a, c in SECTORS.items() for x in (a, FUNDS[c]))), name)


def ticks(lineitem: DataFrame) -> DataFrame:
    """Trades from order lines: an instrument for each return flag and status, priced per unit."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.col("l_returnflag").alias("sector"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"), order.alias("seq"))


def to_bars(trades: DataFrame, *keys: str) -> DataFrame:
    """Open, high, low, close and volume by keys; the order within a bar is that of seq."""
    return trades.groupBy(*keys).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.max_by("price", "seq").alias("adj_close"), F.sum("quantity").alias("volume"),
    )


def market_context(trades: DataFrame) -> DataFrame:
    """Benchmark close and volatility level by date."""
    return trades.groupBy("date").agg(F.max_by("price", "seq").alias("bench_close"), F.stddev_samp("price").alias("vix"))


def fine_bars(trades: DataFrame) -> DataFrame:
    """Bars by ticker, sector and date with the seq of their first and last trade, from which `merged` makes the bars of any of these keys."""
    ends = trades.select("ticker", "sector", "date", "price", "quantity", "seq")
    return ends.groupBy("ticker", "sector", "date").agg(
        F.min(F.struct("seq", "price")).alias("first"), F.max(F.struct("seq", "price")).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("quantity").alias("volume"),
    )


def merged(fine: DataFrame, *keys: str) -> DataFrame:
    """The bars that `to_bars` makes by keys, from those of `fine_bars`: trades aren't read or sorted again for every choice of keys."""
    last = F.max("last")["price"]
    return fine.groupBy(*keys).agg(F.min("first")["price"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last.alias("close"), last.alias("adj_close"), F.sum("volume").alias("volume"))


def merged_context(fine: DataFrame, trades: DataFrame) -> DataFrame:
    """The context that `market_context` makes, its closes from `fine_bars`; trades are aggregated by hashing alone, for the volatility."""
    vix = trades.groupBy("date").agg(F.stddev_samp("price").alias("vix")).withColumnRenamed("date", "_date")
    close = merged(fine, "date").select("date", F.col("close").alias("bench_close"))
    return close.join(vix, F.col("date").eqNullSafe(F.col("_date"))).drop("_date")


def keep_last(rows: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """Of the rows with equal keys the one with the greatest `newest`, aggregated before the shuffle."""
    return _one_of(rows, keys, F.max_by, newest)


def keep_first(rows: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    return _one_of(rows, keys, F.min_by, newest)


def _one_of(rows: DataFrame, keys: list[str], pick, by: Column) -> DataFrame:
    kept = rows.groupBy(*keys).agg(pick(F.struct(*(c for c in rows.columns if c not in keys)), by).alias("_kept"))
    return kept.select(*keys, "_kept.*").select(*rows.columns)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that only one side has."""
    return a.exceptAll(b).union(b.exceptAll(a)).distinct()


def names(*parts: DataFrame) -> DataFrame:
    """The distinct instruments of all parts."""
    first, *rest = (p.select("ticker") for p in parts)
    for p in rest:
        first = first.union(p)
    return first.distinct()


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, the fresh one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return keep_last(both, keys, F.col("_new")).drop("_new")


def normalise_symbol(symbol: Column) -> Column:
    """Trimmed upper-case symbol, null where it isn't one."""
    s = F.upper(F.trim(symbol))
    return F.when((F.length(s) <= SYMBOL_LENGTH) & s.rlike(SYMBOL), s)


def weekdays(dates: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Every weekday from the first date to the last, without holidays(date)."""
    span = dates.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    return days if holidays is None else days.join(holidays, "date", "left_anti")


def numbered_days(calendar: DataFrame) -> DataFrame:
    """date, open and n for each day of the calendar's span: whether it is a session, and how many sessions there are up to it."""
    span = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null").select(F.explode(F.sequence(F.date_sub("a", 7), F.date_add("b", 7))).alias("date"))
    days = span.join(calendar.select("date", F.lit(1).alias("open")), "date", "left").fillna(0, ["open"])
    return days.withColumn("n", F.sum("open").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))  # one row a date


def adjust(bars: DataFrame) -> DataFrame:
    """Prices times the last known adj_close / close; 1 before the first."""
    factor = F.coalesce(F.last(F.try_divide("adj_close", "close"), True).over(ordered().rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    return bars.withColumn("adj_factor", factor).select("ticker", "date", *((F.col(c) * F.col("adj_factor")).alias(c) for c in ("open", "high", "low", "close")), "volume", "adj_factor")


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar days, between an instrument's first and last bar, without a bar. Spans are spread to dates, so all joins are on equal keys."""
    spans = bars.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    due = spans.select("ticker", F.explode(F.sequence("a", "b")).alias("date")).join(calendar, "date", "left_semi").select("ticker", "date")
    return due.join(bars.select("ticker", "date"), ["ticker", "date"], "left_anti")


def unexpected_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    return bars.select("ticker", "date").join(calendar, "date", "left_anti")


def validate(bars: DataFrame, calendar: DataFrame, latest: Column | None = None) -> DataFrame:
    """A report by instrument: counts of each kind of fault, the sessions it is behind `latest`, and a status.

    One aggregation over the bars, tagged by their day of the calendar; the sessions due between first and last bar come from the numbers of
    those two days. Changes are taken from the last known price. Index symbols have no volume and may jump.
    """
    prices = [F.col(c) for c in ("open", "high", "low", "close", "adj_close")]
    days = numbered_days(calendar)
    last_known = F.last("adj_close", True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    known = bars.join(days.select("date", F.col("open").alias("session")), "date", "left").withColumn("known", last_known)
    change = F.abs(F.try_divide("known", F.lag("known").over(ordered())) - 1)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    nulls = sum((p.isNull().cast("int") for p in prices[1:]), prices[0].isNull().cast("int"))
    finite = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in [*prices, F.col("volume")]]
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    counted = known.withColumn("change", change).groupBy("ticker").agg(
        F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        (F.count("*") - F.countDistinct("date")).alias("duplicates"),
        sum((n(p <= 0) for p in prices[1:]), n(prices[0] <= 0)).alias("not_positive"),
        n(nulls == len(prices)).alias("no_prices"), n((nulls > 0) & (nulls < len(prices))).alias("some_prices"),
        n(F.col("high") < F.col("low")).alias("inverted"),
        n((F.col("high") < top - SLACK) | (F.col("low") > bottom + SLACK)).alias("outside"),
        n(F.col("change") > MAX_RETURN).alias("jumps"), F.max(F.when(F.col("change") > MAX_RETURN, F.col("change"))).alias("worst_jump"),
        F.avg(F.when(F.coalesce("volume", F.lit(0.0)) <= 0, 1.0).otherwise(0.0)).alias("zero_volume"),
        n(F.coalesce("session", F.lit(0)) == 0).alias("unexpected"), F.countDistinct(F.when(F.col("session") == 1, F.col("date"))).alias("present"),
        F.max(F.greatest(*(f.cast("int") for f in finite))).alias("finite"),
    )
    at = lambda name: days.select(F.col("date").alias(f"{name}_date"), F.col("n").alias(f"{name}_n"), F.col("open").alias(f"{name}_open"))
    spans = counted.join(at("first"), "first_date", "left").join(at("last"), "last_date", "left")
    due = F.col("last_n") - F.col("first_n") + F.col("first_open")
    end = calendar.agg(F.max("date").alias("latest")) if latest is None else calendar.select(latest.alias("latest")).limit(1)
    stale = days.join(end, F.col("date") == F.col("latest")).select(F.col("n").alias("end_n"))
    joined = spans.crossJoin(F.broadcast(stale)).withColumns({"missing": due - F.col("present"), "stale": F.greatest(F.lit(0), F.col("end_n") - F.col("last_n"))})  # one row
    share, index = F.col("missing") / F.col("rows"), is_index(F.col("ticker"))
    bad = (F.col("duplicates") > 0) | (F.col("not_positive") > 0) | (F.col("no_prices") > 0) | (F.col("inverted") > 0) | (share > MISSING_SHARE) | (F.col("rows") < LEAST_ROWS) | (F.col("finite") == 0)
    odd = (F.col("some_prices") + F.col("outside") + F.col("unexpected") + F.col("missing") + F.col("stale") > 0) | (~index & ((F.col("jumps") > 0) | (F.col("zero_volume") > ZERO_VOLUME_SHARE)))
    report = ["ticker", "rows", "first_date", "last_date", "duplicates", "not_positive", "no_prices", "some_prices", "inverted", "outside", "jumps", "worst_jump", "zero_volume", "missing", "unexpected", "stale"]
    return joined.select(*report, F.when(bad, "error").when(odd, "warning").otherwise("ok").alias("status"))
