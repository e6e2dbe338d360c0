"""Column builders for trailing windows of a pooled bar table.

Every builder takes columns and gives a lazy Column over ``Window.partitionBy(key).orderBy(time)``, so one shuffle by instrument
serves a whole feature panel. Windows are ROWS frames; a value needs as many non-null observations as its window is long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = math.sqrt(252)


def ordered(key: str = "ticker", time: str = "date"):
    return Window.partitionBy(key).orderBy(time)


def trailing(n: int, key: str = "ticker", time: str = "date"):
    return ordered(key, time).rowsBetween(-(n - 1), 0)


def gate(value: Column, seen: Column, n: int, least: int | None = None) -> Column:
    """The value where the last n rows hold at least `least` (n by default) observations."""
    return F.when(F.count(seen).over(trailing(n)) >= (least or n), value)


def lag(s: Column, k: int = 1) -> Column:
    return F.lag(s, k).over(ordered())


def lead(s: Column, k: int = 1) -> Column:
    return F.lead(s, k).over(ordered())


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def log_return(s: Column, k: int = 1) -> Column:
    return F.ln(ratio(s, lag(s, k)))


def simple_return(s: Column, k: int = 1) -> Column:
    return ratio(s, lag(s, k)) - 1


def sma(s: Column, n: int) -> Column:
    return gate(F.avg(s).over(trailing(n)), s, n)


def std(s: Column, n: int) -> Column:
    return gate(F.stddev_samp(s).over(trailing(n)), s, n)


def rolling_min(s: Column, n: int) -> Column:
    return gate(F.min(s).over(trailing(n)), s, n)


def rolling_max(s: Column, n: int) -> Column:
    return gate(F.max(s).over(trailing(n)), s, n)


def rolling_sum(s: Column, n: int) -> Column:
    return gate(F.sum(s).over(trailing(n)), s, n)


#: Rows of an instrument that one scaled running sum covers, at most.
BLOCK = 2048


def with_ewm(df: DataFrame, **means: tuple[Column, float, int]) -> DataFrame:
    """df with recursive exponential means, name=(values, alpha, least): y = (1 - alpha) y' + alpha x from the first observation on.

    Missing values (nulls and NaN) are passed over and keep the mean before them; it is null before `least` observations. The recursion is
    linear, so it is a running sum of values divided by powers of q = 1 - alpha, multiplied by such a power again. Powers would run over,
    so an instrument's rows are cut into blocks; what a block carries into the next is a fold over the few blocks before it. All means
    share two orders of the rows, by instrument and by block within it, which need no other shuffle than that by instrument.
    """
    block = max(1, min(BLOCK, *(int(-600 / math.log(1 - alpha)) for _, alpha, _ in means.values())))
    power = lambda n, k: F.pow(F.lit(1 - means[n][1]), k)
    own = Window.partitionBy("ticker", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    every = ordered().rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({f"_x_{n}": F.when(~F.isnan(x.cast("double")), x.cast("double")) for n, (x, _, _) in means.items()} | {"_block": F.floor((F.row_number().over(ordered()) - 1) / block)})
    rows = rows.withColumns({f"_k_{n}": F.count(f"_x_{n}").over(own) for n in means} | {f"_seen_{n}": F.count(f"_x_{n}").over(every) for n in means} | {"_last": F.lead("_block").over(ordered()) != F.col("_block")})

    def local(n: str) -> Column:
        x, k = F.col(f"_x_{n}"), F.col(f"_k_{n}")
        weight = F.when(F.col(f"_seen_{n}") == 1, 1.0).otherwise(means[n][1])  # the first observation starts the mean
        return power(n, k) * F.coalesce(F.sum(weight * x * power(n, -k)).over(own), F.lit(0.0))

    rows = rows.withColumns({f"_y_{n}": local(n) for n in means})
    # At the end of a block: the part that it makes itself, and what it leaves of all that came before.
    end = F.when(F.col("_last"), F.struct(*(F.col(f"{c}_{n}").alias(f"{c[1:]}_{n}") for c in ("_y", "_k") for n in means)))
    rows = rows.withColumn("_ends", F.collect_list(end).over(ordered().rowsBetween(Window.unboundedPreceding, -1)))

    def whole(n: str) -> Column:
        carried = F.aggregate("_ends", F.lit(0.0), lambda y, e: e[f"y_{n}"] + y * power(n, e[f"k_{n}"]))
        return F.when(F.col(f"_seen_{n}") >= means[n][2], F.col(f"_y_{n}") + carried * power(n, F.col(f"_k_{n}")))

    return rows.withColumns({n: whole(n) for n in means}).drop("_block", "_last", "_ends", *(f"{c}_{n}" for c in ("_x", "_k", "_seen", "_y") for n in means))


def ema(s: Column, span: int) -> tuple[Column, float, int]:
    return s, 2 / (span + 1), span


def wilder(s: Column, n: int) -> tuple[Column, float, int]:
    return s, 1 / n, n


def true_range(high: Column, low: Column, close: Column) -> Column:
    before = lag(close)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def realised_volatility(r: Column, n: int) -> Column:
    return std(r, n) * YEAR


def parkinson(high: Column, low: Column, n: int) -> Column:
    x = F.pow(F.ln(ratio(high, low)), F.lit(2.0))
    return F.sqrt(gate(F.avg(x).over(trailing(n)), x, n) / (4 * math.log(2))) * YEAR


def is_index(symbol: Column) -> Column:
    """Whether a symbol names an index, which has no shares and no volume."""
    return symbol.startswith("^")


def downside(r: Column) -> Column:
    """Losses; gains and missing returns count as zero."""
    return F.when(r < 0, r).otherwise(0.0)


def efficiency_ratio(s: Column, n: int, step: Column) -> Column:
    """step: the absolute change of s, as a column of its own."""
    return ratio(F.abs(s - lag(s, n)), F.when(F.count(step).over(trailing(n)) >= n, F.sum(step).over(trailing(n))))


def price_position(s: Column, n: int) -> Column:
    low, high = rolling_min(s, n), rolling_max(s, n)
    return ratio(s - low, high - low)


def zscore(s: Column, n: int) -> Column:
    return ratio(s - sma(s, n), std(s, n))


def _both(a: Column, b: Column) -> tuple[Column, Column]:
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def beta(a: Column, m: Column, n: int) -> Column:
    a, m = _both(a, m)
    return gate(ratio(F.covar_samp(a, m).over(trailing(n)), F.var_samp(m).over(trailing(n))), a, n)


def corr(a: Column, b: Column, n: int) -> Column:
    a, b = _both(a, b)
    w = trailing(n)
    return gate(ratio(F.covar_samp(a, b).over(w), F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)), a, n)


def direction(r: Column) -> Column:
    """1 for a gain, 0 for a loss or no change, null stays null."""
    return F.when(r.isNotNull(), (r > 0).cast("double"))
