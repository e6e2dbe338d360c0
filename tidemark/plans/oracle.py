"""DuckDB SQL for the queries that SQL can express, written apart from the Spark plans."""

from __future__ import annotations

import math
import re

ORACLE_SQL: dict[str, str] = {}

CTE = {
    "li": "SELECT l_returnflag || l_linestatus AS ticker, l_returnflag AS sector, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p, l_quantity AS q, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem",
    "bars": "SELECT ticker, date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, arg_max(p, k) AS adj_close, sum(q) AS volume FROM li GROUP BY 1, 2",
    "ctx": "SELECT date, arg_max(p, k) AS bench_close, stddev_samp(p) AS vix FROM li GROUP BY 1",
    "sect": "SELECT sector, date, arg_max(p, k) AS sector_close FROM li GROUP BY 1, 2",
    "rets": """SELECT *, ln(close / lag(close) OVER w) AS ret_1d, CASE WHEN volume > 0 THEN volume END AS vol_pos, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, abs(close - lag(close) OVER w) AS step
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "days": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM bars)",
    "cal": "SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series((SELECT min(date) FROM bars), (SELECT max(date) FROM bars), INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6",
    "book": """SELECT b.ticker, b.date, d.pos // 400 AS fold, b.ret_1d, b.ret, CASE WHEN b.ret > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS y
      FROM (SELECT ticker, date, ln(close / lag(close) OVER w) AS ret_1d, lead(close) OVER w / close - 1 AS ret FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) b JOIN days d USING (date) WHERE b.ret IS NOT NULL""",
    "rates": "SELECT fold + 1 AS fold, avg(y) AS m, avg(y) FILTER (WHERE ret_1d > 0) AS up, avg(y) FILTER (WHERE ret_1d IS NULL OR ret_1d <= 0) AS down FROM book GROUP BY 1",
    "preds": """SELECT ticker, date, fold, ret_1d, ret, y, u.model, round(u.p, 6) AS p FROM book JOIN rates USING (fold), LATERAL (VALUES
      ('signal', CASE WHEN ret_1d IS NULL THEN 0.5 ELSE 1 / (1 + exp(-ret_1d)) END), ('majority', m), ('persistence', CASE WHEN ret_1d IS NULL THEN 0.5 WHEN ret_1d > 0 THEN up ELSE down END)) u(model, p)""",
    "sig": "SELECT *, abs(p - 0.5) AS confidence, CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END AS correct FROM preds WHERE model = 'signal'",
    "states": "SELECT date, CASE WHEN down < -0.9 THEN 2 WHEN down < -0.6 THEN 1 ELSE 0 END::BIGINT AS state FROM (SELECT date, bench_close / max(bench_close) OVER (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - 1 AS down FROM ctx)",
    "conf": "SELECT model, fold, count(*) AS n, sum((p >= 0.5 AND y = 1)::INT)::BIGINT AS tp, sum((p >= 0.5 AND y = 0)::INT)::BIGINT AS fp, sum((p < 0.5 AND y = 1)::INT)::BIGINT AS fn, sum((p < 0.5 AND y = 0)::INT)::BIGINT AS tn FROM preds GROUP BY 1, 2",
    "fm": """SELECT model, fold, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, avg(y) AS base_rate, avg((p - y) ** 2) AS brier,
      avg(-(y * ln(least(greatest(p, 1e-9), 1 - 1e-9)) + (1 - y) * ln(1 - least(greatest(p, 1e-9), 1 - 1e-9)))) AS log_loss FROM preds GROUP BY 1, 2""",
}
NEEDS = {"bars": "li", "ctx": "li", "sect": "li", "rets": "bars", "days": "bars", "cal": "bars", "book": "bars days", "rates": "book", "preds": "book rates", "sig": "preds", "states": "ctx", "conf": "preds", "fm": "preds"}


def put(name: str, needs: str, sql: str, more: dict[str, str] | None = None) -> None:
    """more: further relations, in order, after those needed."""
    seen: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, "").split():
            add(x)
        if n not in seen:
            seen.append(n)

    for n in needs.split():
        add(n)
    with_ = [f"{n} AS ({CTE[n]})" for n in seen] + [f"{n} AS ({s})" for n, s in (more or {}).items()]
    ORACLE_SQL[name] = (f"WITH {', '.join(with_)} " if with_ else "") + sql


EXACT = {"open", "high", "low", "close", "adj_close", "volume", "price", "quantity", "change", "true_range"}


def R(names: str) -> str:
    """Rounded columns, but for those that are the same doubles in any engine; adding zero turns -0.0 into 0.0."""
    return ", ".join(n if n in EXACT else f"round({n}, 6) + 0.0 AS {n}" for n in names.split())


W = "OVER (PARTITION BY ticker ORDER BY date)"


def ov(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gate(e: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) {ov(n)} >= {n} THEN {e} {ov(n)} END)"


def sma(x, n):
    return gate(f"avg({x})", x, n)


def std(x, n):
    return gate(f"stddev_samp({x})", x, n)


def div(a, b):
    return f"({a}) / nullif({b}, 0)"


def ewm(x: str, alpha: float, least: int) -> str:
    k = math.ceil(41.5 / -math.log(1 - alpha))
    values = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= {least} THEN list_reduce({values}, lambda a, v: a * {1 - alpha!r} + v * {alpha!r}) END)"


def ema(x, span):
    return ewm(x, 2 / (span + 1), span)


def indicators(name: str, needs: str, **cols: str) -> None:
    inner = ", ".join(f"{e} AS {n}" for n, e in cols.items())
    put(name, needs, f"SELECT ticker, date, {R(' '.join(cols))} FROM (SELECT ticker, date, {inner} FROM {needs.split()[-1]})")


YEAR = "sqrt(252.0)"
OHLC = "open high low close adj_close volume"

put("scan_bars", "bars", f"SELECT ticker, date, {R(OHLC)} FROM bars")
put("bars_dedupe_last", "li", f"SELECT ticker, date, {R('price quantity')} FROM (SELECT ticker, date, p AS price, q AS quantity FROM li QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY k DESC) = 1)")
put("calendar_sessions", "cal", "SELECT date FROM cal")
put("sessions", "days", "SELECT date, pos FROM days")
put("json_series_explode", "bars", f"SELECT ticker, date, {R(OHLC)} FROM bars")
put("scan_csv", "bars", f"SELECT ticker, date, {R(OHLC)} FROM bars")
put("predictions", "preds", f"SELECT ticker, date, fold, model, {R('ret_1d ret y p')} FROM preds")
put("tumbling_bars", "", f"""SELECT ticker, epoch(h)::BIGINT AS start, {R('open high low close volume')} FROM (SELECT event_type AS ticker, date_trunc('hour', ts) AS h, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)""")
put("ticker_normalise", "", r"""SELECT p_partkey, CASE WHEN length(s) <= 16 AND regexp_matches(s, '^\^?[A-Z][A-Z0-9]{0,9}(?:[.\-][A-Z0-9]{1,4})?$') THEN s END AS symbol
  FROM (SELECT p_partkey, upper(replace(CASE WHEN p_partkey % 7 = 0 THEN '^' ELSE '' END || replace(p_brand, '#', '.'), 'Brand', 'brd')) AS s FROM part)""")
put("date_slice", "bars", f"SELECT ticker, date, {R(OHLC)} FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
put("drop_non_sessions", "bars", f"SELECT ticker, date, {R('close')} FROM bars WHERE isodow(date) < 6")
MISSING = "SELECT s.ticker, cal.date FROM (SELECT ticker, min(date) AS a, max(date) AS b FROM bars GROUP BY 1) s JOIN cal ON cal.date BETWEEN s.a AND s.b WHERE NOT EXISTS (SELECT 1 FROM bars x WHERE x.ticker = s.ticker AND x.date = cal.date)"
put("missing_sessions", "bars cal", MISSING)
put("unexpected_sessions", "bars", "SELECT ticker, date FROM bars WHERE isodow(date) >= 6")
put("adjust_actions", "bars", f"SELECT ticker, date, {R('open high low close volume adj_factor')} FROM (SELECT ticker, date, open * f AS open, high * f AS high, low * f AS low, close * f AS close, volume, f AS adj_factor FROM g)", {
    "h": "SELECT *, CASE WHEN day(date) = 1 THEN NULL WHEN date < DATE '1998-01-01' THEN close / 2 ELSE close END AS a FROM bars",
    "g": "SELECT *, coalesce(last_value(a / close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS f FROM h",
})
n = lambda cond: f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)::BIGINT"
put("validate_bars", "bars cal", """SELECT ticker, rows, first_date, last_date, duplicates, not_positive, no_prices, some_prices, inverted, outside, jumps, round(worst_jump, 6) + 0.0 AS worst_jump, round(zero_volume, 6) + 0.0 AS zero_volume, missing, unexpected, stale,
  CASE WHEN duplicates > 0 OR not_positive > 0 OR no_prices > 0 OR inverted > 0 OR missing / rows > 0.02 OR rows < 400 THEN 'error'
    WHEN some_prices + outside + unexpected + missing + stale > 0 OR (ticker NOT LIKE '^%' AND (jumps > 0 OR zero_volume > 0.02)) THEN 'warning' ELSE 'ok' END AS status
  FROM c LEFT JOIN (SELECT ticker AS t2, count(*) AS miss FROM m GROUP BY 1) ON t2 = ticker, LATERAL (SELECT coalesce(miss, 0) AS missing, (SELECT count(*) FROM cal WHERE cal.date > c.last_date) AS stale)""", {
    "fw": """SELECT CASE WHEN ticker = 'NF' THEN '^NF' ELSE ticker END AS ticker, date, CASE WHEN day(date) <> 8 THEN open END AS open, CASE WHEN day(date) <> 8 THEN high END AS high, CASE WHEN day(date) <> 8 THEN low END AS low,
      CASE WHEN day(date) = 9 THEN -close WHEN day(date) NOT IN (7, 8) THEN close END AS close, CASE WHEN day(date) <> 8 THEN adj_close END AS adj_close, CASE WHEN day(date) = 10 THEN 0.0 ELSE volume END AS volume FROM bars""",
    "m": MISSING.replace("bars", "fw"),
    "k": "SELECT *, last_value(adj_close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM fw",
    "h": "SELECT *, abs(known / lag(known) OVER (PARTITION BY ticker ORDER BY date) - 1) AS change, (open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (adj_close IS NULL)::INT AS nulls FROM k",
    "c": f"""SELECT ticker, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(*) - count(DISTINCT date) AS duplicates, ({' + '.join(n(f'{x} <= 0') for x in ('open', 'high', 'low', 'close', 'adj_close'))}) AS not_positive, {n('nulls = 5')} AS no_prices, {n('nulls BETWEEN 1 AND 4')} AS some_prices,
      {n('high < low')} AS inverted, {n('high < greatest(open, close) - 1e-6 OR low > least(open, close) + 1e-6')} AS outside, {n('change > 0.6')} AS jumps, max(CASE WHEN change > 0.6 THEN change END) AS worst_jump, avg(CASE WHEN coalesce(volume, 0) <= 0 THEN 1.0 ELSE 0.0 END) AS zero_volume, {n('isodow(date) >= 6')} AS unexpected FROM h GROUP BY 1""",
})
put("keep_first_bars", "li", f"SELECT ticker, date, {R('price quantity')} FROM (SELECT ticker, date, p AS price, q AS quantity FROM li QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY k) = 1)")
put("symmetric_difference", "bars", "SELECT ticker, date FROM bars WHERE year(date) <> 1996")
put("universe", "bars", """SELECT "group", sector, count(*) AS size, string_agg(ticker, ',' ORDER BY ticker) AS members FROM (SELECT DISTINCT ticker, CASE WHEN ticker IN ('AF', 'AO', 'NF') THEN 'dev' WHEN ticker = 'NO' THEN 'val' WHEN ticker = 'RF' THEN 'test' ELSE 'unassigned' END AS "group",
  CASE WHEN ticker IN ('AF', 'AO', 'NF', 'NO', 'RF') THEN substr(ticker, 1, 1) ELSE 'unknown' END AS sector FROM bars WHERE year(date) <> 1995) GROUP BY 1, 2""")
put("calendar_holidays", "cal bars", "SELECT date FROM cal WHERE date NOT IN (SELECT date FROM bars WHERE month(date) = 12 AND day(date) = 25)")
put("upsert_bars", "bars", f"SELECT ticker, date, {R('close volume')} FROM (SELECT ticker, date, CASE WHEN year(date) >= 2000 THEN close * 2 ELSE close END AS close, volume FROM bars)")
put("warmup_drop", "bars", f"SELECT ticker, date, {R('close')} FROM (SELECT * FROM bars QUALIFY row_number() {W} > 253)")
put("run_store", "fm", f"SELECT model, fold, {R('accuracy base_rate brier log_loss')} FROM fm WHERE model = 'signal'")
put("run_manifest", "preds", "SELECT count(*) AS rows, (SELECT string_agg(model, ',' ORDER BY model) FROM (SELECT DISTINCT model FROM preds)) AS models, count(DISTINCT fold) AS folds, min(date) AS first, max(date) AS last FROM preds")
put("coverage", "preds", "SELECT ticker, min(date) AS first, max(date) AS last, count(*) AS rows, count(DISTINCT fold) AS folds, count(DISTINCT model) AS models FROM preds GROUP BY 1")
put("rate_window", "", "SELECT event_id, user_id, recent, recent > 3 AS limited FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events)")

indicators("log_return", "bars", log_return_1=f"ln(close / lag(close) {W})", log_return_5=f"ln(close / lag(close, 5) {W})")
indicators("simple_return", "bars", simple_return=f"close / lag(close) {W} - 1")
indicators("sma", "bars", sma_20=sma("close", 20))
indicators("ema", "bars", ema_12=ema("close", 12))
indicators("wilder", "bars", wilder_14=ewm("close", 1 / 14, 14))
indicators("true_range", "rets", true_range="tr")
indicators("atr", "rets", atr_14=ewm("tr", 1 / 14, 14))
indicators("realised_vol", "rets", vol_20=std("ret_1d", 20) + f" * {YEAR}")
PARK = "sqrt(" + gate("avg(ln(high / low) ** 2)", "high", 20) + f" / (4 * ln(2.0))) * {YEAR}"
indicators("parkinson_vol", "bars", parkinson_20=PARK)
DOWN = gate("stddev_samp(CASE WHEN ret_1d < 0 THEN ret_1d ELSE 0.0 END)", "close", 20) + f" * {YEAR}"
indicators("downside_vol", "rets", downside_20=DOWN)
EFF = div(f"abs(close - lag(close, 20) {W})", gate("sum(step)", "step", 20))
indicators("efficiency_ratio", "rets", efficiency_ratio_20=EFF)


def position(k):
    return div(f"close - {gate('min(close)', 'close', k)}", f"({gate('max(close)', 'close', k)} - {gate('min(close)', 'close', k)})")


indicators("price_position", "bars", price_position_60=position(60))
indicators("rolling_zscore", "bars", zscore_20=div(f"close - {sma('close', 20)}", std("close", 20)))
indicators("ret_lags", "rets", **{f"lag{k}": f"lag(ret_1d, {k}) {W}" for k in range(1, 6)})
UP = gate("avg(CASE WHEN ret_1d > 0 THEN 1.0 ELSE 0.0 END)", "close", 20)
indicators("up_day_ratio", "rets", up_day_ratio_20=UP)
HIGH, LOW = f"close / {gate('max(close)', 'close', 252)} - 1", f"close / {gate('min(close)', 'close', 252)} - 1"
indicators("drawdown_252", "bars", drawdown_252=HIGH, advance_252=LOW)
indicators("forward_return", "bars", fwd_ret_1d=f"lead(close) {W} / close - 1", fwd_ret_5d=f"lead(close, 5) {W} / close - 1")
indicators("forward_return_open", "bars", fwd_ret_open_5d=f"lead(close, 5) {W} / lead(open) {W} - 1")


def corr(a, b, k):
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"(CASE WHEN count({x}) {ov(k)} >= {k} THEN covar_samp({x}, {y}) {ov(k)} / nullif(stddev_samp({x}) {ov(k)} * stddev_samp({y}) {ov(k)}, 0) END)"


def beta(a, b, k):
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"(CASE WHEN count({x}) {ov(k)} >= {k} THEN covar_samp({x}, {y}) {ov(k)} / nullif(var_samp({y}) {ov(k)}, 0) END)"


indicators("rolling_corr", "rets", corr_20=corr("ret_1d", "vol_pos", 20))
FILL = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
GAPPED = f"SELECT ticker, date, last_value(c.bench_close IGNORE NULLS) {FILL} AS bench_close, last_value(c.vix IGNORE NULLS) {FILL} AS vix FROM bars LEFT JOIN (SELECT * FROM ctx WHERE day(date) % 5 < 2) c USING (date)"
put("asof_bounded", "bars ctx", f"SELECT ticker, date, {R('bench_close vix')} FROM g", {"g": GAPPED})
put("context_gaps", "bars ctx sect", """SELECT ticker, sum((NOT EXISTS (SELECT 1 FROM ctx c WHERE c.date = bars.date AND c.bench_close IS NOT NULL AND day(c.date) % 5 < 2))::INT)::BIGINT AS gaps,
  sum((NOT EXISTS (SELECT 1 FROM ctx c WHERE c.date = bars.date AND c.vix IS NOT NULL AND day(c.date) % 5 < 2))::INT)::BIGINT AS vix_gaps,
  sum((NOT EXISTS (SELECT 1 FROM sect s WHERE s.date = bars.date AND s.sector = substr(bars.ticker, 1, 1) AND day(s.date) % 3 < 2))::INT)::BIGINT AS sector_gaps FROM bars GROUP BY 1""")
put("ewma_vol", "rets", f"SELECT ticker, date, {R('ewma_vol')} FROM (SELECT ticker, date, sqrt({ewm('sq', 1 - 0.94, 60)}) AS ewma_vol FROM s)", {"s": "SELECT *, ret_1d ** 2 AS sq FROM rets"})
OSC = {
    "o1": f"SELECT *, close - lag(close) {W} AS ch FROM rets",
    "o2": f"SELECT *, CASE WHEN ch IS NOT NULL THEN greatest(ch, 0.0) END AS gain, CASE WHEN ch IS NOT NULL THEN greatest(-ch, 0.0) END AS loss, {ema('close', 12)} - {ema('close', 26)} AS macd_line FROM o1",
    "o3": f"SELECT *, {ewm('gain', 1 / 14, 14)} AS g, {ewm('loss', 1 / 14, 14)} AS l, {ewm('macd_line', 0.2, 9)} AS macd_signal FROM o2",
    "o4": "SELECT *, CASE WHEN g IS NOT NULL THEN CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END END AS rsi_14, macd_line - macd_signal AS macd_hist FROM o3",
}
put("rsi", "rets", f"SELECT ticker, date, {R('rsi_14')} FROM o4", OSC)
put("macd", "rets", f"SELECT ticker, date, {R('macd_line macd_signal macd_hist')} FROM o4", OSC)
indicators("features_returns", "rets", **{f"ret_{k}d": f"ln(close / lag(close, {k}) {W})" for k in (1, 3, 5, 10, 20)}, **{f"ret_1d_lag{k}": f"lag(ret_1d, {k}) {W}" for k in range(1, 6)})
MOM = {f"px_to_sma_{k}": f"close / {sma('close', k)} - 1" for k in (10, 20, 50, 200)} | {f"sma_ratio_{a}_{b}": f"{sma('close', a)} / {sma('close', b)} - 1" for a, b in ((20, 50), (50, 200))}
MOM |= {"mom_12_1": f"ln(lag(close, 21) {W} / lag(close, 252) {W})", "price_position_252": position(252), "rsi": "rsi_14 / 100", "macd_norm": "macd_line / close", "macd_hist_norm": "macd_hist / close"}
put("features_momentum", "rets", f"SELECT ticker, date, {R(' '.join(k for k in MOM if k != 'rsi'))}, round(rsi, 6) + 0.0 AS rsi_14 FROM (SELECT ticker, date, {', '.join(f'{e} AS {k}' for k, e in MOM.items())} FROM o4)", OSC)
V = {k: f"{std('ret_1d', k)} * {YEAR}" for k in (5, 20, 60)}
indicators("features_volatility", "rets", vol_5=V[5], vol_20=V[20], vol_60=V[60], vol_ratio_5_20=div(V[5], V[20]), vol_ratio_20_60=div(V[20], V[60]), parkinson_vol_20=PARK, downside_vol_ratio_20=div(DOWN, V[20]), standardised_move=div("ret_1d", std("ret_1d", 20)), atr_14_norm=f"{ewm('tr', 1 / 14, 14)} / close")
indicators("features_volume", "rets", rel_volume_20=div("vol_pos", sma("vol_pos", 20)), volume_z_20=div(f"vol_pos - {sma('vol_pos', 20)}", std("vol_pos", 20)), dollar_volume_ratio_20=div("close * vol_pos", sma("close * vol_pos", 20)), price_volume_corr_20=corr("ret_1d", "vol_pos", 20))
indicators("features_trend", "rets", efficiency_ratio_20=EFF, dist_high_252=HIGH, dist_low_252=LOW, up_day_ratio_20=UP)
MKT = {
    "m0": f"SELECT r.*, last_value(c.bench_close IGNORE NULLS) {FILL} AS bc, last_value(c.vix IGNORE NULLS) {FILL} AS vx, last_value(s.sector_close IGNORE NULLS) {FILL} AS sc FROM rets r LEFT JOIN ctx c USING (date) LEFT JOIN sect s ON s.sector = substr(r.ticker, 1, 1) AND s.date = r.date",
    "m1": f"SELECT *, ln(bc / lag(bc) {W}) AS bench_ret_1d, ln(close / lag(close, 5) {W}) AS r5, ln(bc / lag(bc, 5) {W}) AS bench_ret_5d, ln(sc / lag(sc, 5) {W}) AS sector_ret_5d FROM m0",
    "m2": f"""SELECT ticker, date, bench_ret_1d, bench_ret_5d, ln(bc / lag(bc, 20) {W}) AS bench_ret_20d, {std('bench_ret_1d', 20)} * {YEAR} AS bench_vol_20, bc / {sma('bc', 50)} - 1 AS bench_px_to_sma_50, {beta('ret_1d', 'bench_ret_1d', 60)} AS beta_60,
      {corr('ret_1d', 'bench_ret_1d', 60)} AS corr_bench_60, r5, vx AS vix_level, {div(f"vx - {sma('vx', 60)}", std('vx', 60))} AS vix_z_60, ln(vx / lag(vx, 5) {W}) AS vix_chg_5d, sector_ret_5d FROM m1""",
    "m3": "SELECT *, r5 - beta_60 * bench_ret_5d AS resid_ret_5d, r5 - sector_ret_5d AS rel_sector_ret_5d FROM m2",
}
put("features_market", "rets ctx sect", f"SELECT ticker, date, {R('bench_ret_1d bench_ret_5d bench_ret_20d bench_vol_20 bench_px_to_sma_50 beta_60 corr_bench_60 resid_ret_5d vix_level vix_z_60 vix_chg_5d sector_ret_5d rel_sector_ret_5d')} FROM m3", MKT)
put("rolling_beta", "rets ctx sect", f"SELECT ticker, date, {R('beta_60')} FROM m3", MKT)
indicators("features_calendar", "bars", **{f"dow_{d}": f"(isodow(date) = {k})::INT::DOUBLE" for k, d in enumerate(("tue", "wed", "thu", "fri"), 2)}, month_sin="sin(2 * pi() / 12 * month(date))", month_cos="cos(2 * pi() / 12 * month(date))", days_to_month_end="(last_day(date) - date) / 31.0")


def way(x):
    return f"CASE WHEN {x} IS NOT NULL THEN ({x} > 0)::INT::DOUBLE END"


TGT = {
    "b": "SELECT date, " + ", ".join(f"lead(bench_close, {h}) OVER (ORDER BY date) / bench_close - 1 AS b{h}" for h in (1, 5)) + " FROM ctx",
    "t0": "SELECT ticker, date, b1, b5, " + ", ".join(f"lead(close, {h}) {W} / close - 1 AS fwd_ret_{h}d, lead(close, {h}) {W} / lead(open) {W} - 1 AS fwd_ret_open_{h}d" for h in (1, 5)) + " FROM bars LEFT JOIN b USING (date)",
    "t": "SELECT *, " + ", ".join(f"{way(f'fwd_ret_{h}d')} AS direction_{h}d, {way(f'fwd_ret_open_{h}d')} AS direction_open_{h}d, fwd_ret_{h}d - b{h} AS fwd_excess_ret_{h}d, {way(f'(fwd_ret_{h}d - b{h})')} AS excess_direction_{h}d" for h in (1, 5)) + " FROM t0",
}
put("targets", "bars ctx", f"SELECT ticker, date, {R(' '.join(f'{x}_{h}d' for h in (1, 5) for x in ('fwd_ret', 'fwd_ret_open', 'direction', 'direction_open', 'fwd_excess_ret', 'excess_direction')))} FROM t", TGT)
put("label_direction", "bars ctx", "SELECT ticker, date, direction_1d, direction_5d FROM t", TGT)
put("excess_return", "bars ctx", f"SELECT ticker, date, {R('fwd_excess_ret_1d')} FROM t", TGT)
put("excess_direction", "bars ctx", "SELECT ticker, date, excess_direction_5d FROM t", TGT)
put("label_coverage", "bars ctx", "SELECT ticker, count(direction_5d) AS labelled, count(*) - count(direction_5d) AS unlabelled, round(avg(direction_5d), 6) + 0.0 AS base_rate FROM t GROUP BY 1", TGT)
KAP = {
    "sq": "SELECT *, ret_1d ** 2 AS sq FROM rets",
    "sc": f"SELECT ticker, date, lead(close, 5) {W} / close - 1 AS ret, sqrt({ewm('sq', 1 - 0.94, 60)}) AS sigma FROM sq",
    "kp": "SELECT ticker, greatest(0.05, least(1.5, quantile_cont(abs(ret) / (sigma * sqrt(5.0)), 1.0 / 3))) AS kappa FROM sc WHERE ret IS NOT NULL AND sigma IS NOT NULL AND date < DATE '1999-01-01' GROUP BY 1",
}
ONE = {"sc": f"SELECT ticker, date, lead(close) {W} / close - 1 AS ret FROM rets"}
put("kappa", "rets", f"SELECT ticker, {R('kappa')} FROM kp", KAP)
put("ternary_vol", "rets", "SELECT ticker, date, CASE WHEN ret IS NULL OR sigma IS NULL OR kappa IS NULL THEN NULL WHEN ret > kappa * sigma * sqrt(5.0) THEN 1 WHEN ret < -kappa * sigma * sqrt(5.0) THEN -1 ELSE 0 END::BIGINT AS label FROM sc LEFT JOIN kp USING (ticker) WHERE date >= DATE '1999-01-01'", KAP)
put("ternary_quantile", "rets", "SELECT ticker, date, CASE WHEN ret > hi THEN 1 WHEN ret < lo THEN -1 ELSE 0 END::BIGINT AS label FROM sc JOIN q USING (ticker) WHERE ret IS NOT NULL", ONE | {"q": "SELECT ticker, quantile_cont(ret, 1.0 / 3) AS lo, quantile_cont(ret, 2.0 / 3) AS hi FROM sc WHERE ret IS NOT NULL AND year(date) < 1999 GROUP BY 1"})
LABELS = " ".join(f"{x}_{h}d" for h in (1, 5) for x in ("fwd_ret", "fwd_ret_open", "direction", "direction_open", "fwd_excess_ret", "excess_direction"))
FEATURES = ("returns", "momentum", "volatility", "volume", "trend", "market", "calendar")
# Each group's own statement, joined; the warm-up rows go at the end.
ORACLE_SQL["panel_build"] = f"""WITH {', '.join(f'g_{g} AS ({ORACLE_SQL[f"features_{g}"]})' for g in FEATURES)}, g_targets AS ({ORACLE_SQL["targets"]}), g_sigma AS ({ORACLE_SQL["ewma_vol"]}),
  k AS (SELECT ticker, date, row_number() {W} AS k FROM g_calendar)
  SELECT * EXCLUDE (k, ewma_vol), ewma_vol AS ewma_sigma, CASE WHEN ticker IN ('AF', 'AO', 'NF') THEN 'dev' WHEN ticker = 'NO' THEN 'val' WHEN ticker = 'RF' THEN 'test' ELSE 'unassigned' END AS "group",
    CASE WHEN ticker = 'RO' THEN 'unknown' ELSE 'sector ' || substr(ticker, 1, 1) END AS sector
  FROM {' JOIN '.join(f'g_{g} USING (ticker, date)' if n else f'g_{g}' for n, g in enumerate(FEATURES))} JOIN g_targets USING (ticker, date) JOIN g_sigma USING (ticker, date) JOIN k USING (ticker, date) WHERE k > 253"""
put("label_rows", "bars ctx", "SELECT ticker, date, direction_5d FROM t WHERE direction_5d IS NOT NULL", TGT)
put("panel_subset", "rets", f"SELECT ticker, date, {R('ret_1d')}, CASE WHEN ticker = 'NO' THEN 'val' ELSE 'dev' END AS \"group\" FROM rets WHERE ticker IN ('AF', 'AO', 'NF', 'NO')")
AUDITED = "(SELECT unnest([" + ", ".join(f"'{n}'" for n in (
    [f"ret_{n}d" for n in (1, 3, 5, 10, 20)] + [f"ret_1d_lag{k}" for k in range(1, 6)] + [f"px_to_sma_{n}" for n in (10, 20, 50, 200)] + [f"vol_{n}" for n in (5, 20, 60)] + [f"dow_{x}" for x in ("tue", "wed", "thu", "fri")]
    + "sma_ratio_20_50 sma_ratio_50_200 mom_12_1 price_position_252 rsi_14 macd_norm macd_hist_norm atr_14_norm vol_ratio_5_20 vol_ratio_20_60 parkinson_vol_20 downside_vol_ratio_20 standardised_move rel_volume_20 volume_z_20 dollar_volume_ratio_20 price_volume_corr_20".split()
    + "efficiency_ratio_20 dist_high_252 dist_low_252 up_day_ratio_20 bench_ret_1d bench_ret_5d bench_ret_20d bench_vol_20 bench_px_to_sma_50 beta_60 corr_bench_60 resid_ret_5d vix_level vix_z_60 vix_chg_5d sector_ret_5d rel_sector_ret_5d month_sin month_cos days_to_month_end".split()
)) + "]) AS feature) f"
put("scan_panel", "rets", f"SELECT ticker, date, {R('ret_1d')}, 'dev' AS \"group\" FROM rets WHERE ticker IN ('AF', 'AO', 'NF')")
ORACLE_SQL["live_features"] = f"SELECT ticker, date, ret_1d, rsi_14, beta_60, vol_20, px_to_sma_50 FROM ({ORACLE_SQL['panel_build']}) WHERE ticker = 'NO' ORDER BY date DESC LIMIT 5"
put("audit_compare", "bars", f"SELECT f.feature, c.n AS n_rows, 0::BIGINT AS n_diff FROM {AUDITED}, (SELECT count(*) AS n FROM bars) c")
SPOTS = "SELECT date FROM days WHERE pos IN (SELECT DISTINCT floor(300 + (n - 31 - 300) * k / 5)::BIGINT FROM (SELECT count(*) AS n FROM days), range(6) t(k))"
for _name in ("audit_perturbation", "audit_truncation"):
    put(_name, "bars days", f"SELECT f.feature, c.date AS cutoff, c.n AS n_rows, 0::BIGINT AS n_diff FROM {AUDITED}, (SELECT date, count(*) AS n FROM bars WHERE date IN ({SPOTS}) GROUP BY 1) c")
put("audit_target", "bars", "SELECT date AS cutoff, count(*) AS n_rows, 0::BIGINT AS n_changed, 0::BIGINT AS n_deaf FROM bars WHERE date IN (DATE '1996-06-14', DATE '1998-03-02') GROUP BY 1")
put("audit_positions", "days", "SELECT pos, date FROM days WHERE pos IN (SELECT DISTINCT floor(300 + (n - 31 - 300) * k / 5)::BIGINT FROM (SELECT count(*) AS n FROM days), range(6) t(k))")


def fold_ctes(init, test, inner, gap=6):
    return {
        "fk": f"SELECT unnest(generate_series(0, greatest(0, (nn - {init}) // {test} + 1))) AS k, nn FROM (SELECT count(*) AS nn FROM days)",
        "fa": f"SELECT nn, {init} + k * {test} AS ts, {init} + k * {test} + {test} - 1 AS te FROM fk",
        "fb": f"SELECT ts, te, ts - {gap} - 1 AS ie, ts - {gap} - 1 - {inner} + 1 AS isx, ts - {gap} - 1 - {inner} + 1 - {gap} - 1 AS fe FROM fa WHERE te < nn",
        "ff": "SELECT row_number() OVER (ORDER BY ts) - 1 AS fold, 0::BIGINT AS fit_start, fe::BIGINT AS fit_end, isx::BIGINT AS inner_start, ie::BIGINT AS inner_end, ts::BIGINT AS test_start, te::BIGINT AS test_end FROM fb WHERE isx > 0 AND fe > 0",
    }


FOLDS = fold_ctes(400, 120, 60)
ENDS = [f"{p}_{e}" for p in ("fit", "inner", "test") for e in ("start", "end")]
put("folds", "days", f"SELECT fold, {', '.join(ENDS)}, {', '.join(f'(SELECT date FROM days WHERE pos = {x}) AS {x}_date' for x in ENDS)} FROM ff", FOLDS)
put("fold_violations", "days", "SELECT fold, fit_end, fit_end AS inner_start FROM ff WHERE fold = 1", FOLDS)
ASSIGN = FOLDS | {
    "sp": " UNION ALL ".join(f"SELECT fold, '{p}' AS part, {p}_start AS a, {p}_end AS b FROM ff" for p in ("fit", "inner", "test")),
    "asg": "SELECT b.ticker, b.date, sp.fold, sp.part FROM bars b JOIN days USING (date) JOIN sp ON pos BETWEEN sp.a AND sp.b",
}
put("fold_assign", "bars days", "SELECT fold, part, ticker, count(*) AS rows, min(date) AS first, max(date) AS last FROM asg GROUP BY 1, 2, 3", ASSIGN)
put("heldout_split", "bars days", "SELECT fold, part, count(*) AS rows, count(DISTINCT ticker) AS tickers FROM asg WHERE (part = 'test') <> (ticker IN ('AF', 'AO', 'NF')) GROUP BY 1, 2", ASSIGN)
put("evaluated_sessions", "days", "SELECT DISTINCT d.date, d.pos FROM days d JOIN ff ON d.pos BETWEEN test_start AND test_end", FOLDS)
put("serving_split", "days", """SELECT n - 67 AS fit_end, n - 60 AS inner_start, n - 1 AS inner_end, (SELECT date FROM days WHERE pos = n - 67) AS fit_end_date, (SELECT date FROM days WHERE pos = n - 60) AS inner_start_date, (SELECT date FROM days WHERE pos = n - 1) AS inner_end_date
  FROM (SELECT count(*) AS n FROM days)""")
put("holdout_split", "days", "SELECT date, CASE WHEN pos >= floor(n * 0.75) THEN 'holdout' ELSE 'train' END AS part, pos >= floor(n * 0.1) AND pos < floor(n * 0.75) AS shifted FROM days, (SELECT count(*) AS n FROM days)")
put("label_reach", "days", "SELECT a.date, b.date AS reach FROM days a JOIN days b ON b.pos = least(a.pos + 5, (SELECT max(pos) FROM days))")
put("search_windows", "", "SELECT k, 0::BIGINT AS fit_start, ve - 60 - 6 AS fit_end, ve - 59 AS val_start, ve AS val_end FROM (SELECT k::BIGINT AS k, (400 - 1 - 6 - k * 60)::BIGINT AS ve FROM range(3) t(k)) WHERE ve - 66 > 0")

CONF = """accuracy, base_rate, precision, recall, positive_rate, f1, accuracy_over_base_rate"""
put("confusion", "conf", f"SELECT model, fold, n, tp, fp, fn, tn, {R(CONF.replace(',', ''))} FROM c2", C2 := {
    "c2": """SELECT *, (tp + tn) / n AS accuracy, (tp + fn) / n AS base_rate, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, (tp + fp) / n AS positive_rate,
      coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + tn) / n - greatest((tp + fn) / n, 1 - (tp + fn) / n) AS accuracy_over_base_rate FROM conf""",
})


def auc(keys: str, source: str) -> dict[str, str]:
    return {
        "rk": f"SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY p) + (count(*) OVER (PARTITION BY {keys}, p) - 1) / 2.0 AS rk FROM {source}",
        "auc": f"SELECT {keys}, (sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS roc_auc FROM rk GROUP BY {keys}",
    }


AP = {
    "ps": "SELECT model, fold, p, count(*) AS c, sum(y) AS pos FROM preds GROUP BY 1, 2, 3",
    "cv": "SELECT *, sum(pos) OVER w AS tp, sum(c) OVER w AS seen FROM ps WINDOW w AS (PARTITION BY model, fold ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "ap": "SELECT model, fold, sum(pos * tp / seen) / nullif(sum(pos), 0) AS pr_auc FROM cv GROUP BY 1, 2",
}


def bins(keys: str, source: str, value: str, k: int, op: str) -> dict[str, str]:
    """op: which interior edges count for a value."""
    shares = ", ".join(repr(j / k) for j in range(k + 1))
    group, on = (f"GROUP BY {keys}", f"USING ({keys})") if keys else ("", "ON true")
    head = f"{keys}, " if keys else ""
    return {
        "eg": f"SELECT {head}list_sort(list_distinct(quantile_cont({value}, [{shares}]))) AS e FROM {source} {group}",
        "bn": f"SELECT s.*, len(list_filter(e[2:len(e) - 1], lambda x: x {op} s.{value}))::BIGINT AS bin FROM {source} s JOIN eg {on}",
    }


REL = bins("model, fold", "preds", "p", 10, "<=") | {"rl": "SELECT model, fold, bin, avg(p) AS mean_p, avg(y) AS mean_y, count(*) AS n FROM bn GROUP BY 1, 2, 3", "ec": "SELECT model, fold, sum(abs(mean_p - mean_y) * n) / sum(n) AS ece, max(abs(mean_p - mean_y)) AS mce FROM rl GROUP BY 1, 2"}
put("roc_auc", "preds", f"SELECT model, fold, {R('roc_auc')} FROM auc", auc("model, fold", "preds"))
put("average_precision", "preds", f"SELECT model, fold, {R('pr_auc')} FROM ap", AP)
put("brier_logloss", "fm", f"SELECT model, fold, {R('brier log_loss')} FROM fm")
put("ece", "preds", f"SELECT model, fold, {R('ece mce')} FROM ec", REL)
put("reliability", "preds", f"SELECT model, fold, bin, {R('mean_p mean_y')}, n FROM rl", REL)
put("evaluate", "conf fm", f"SELECT model, fold, n, tp, fp, fn, tn, {', '.join(f'round(c2.{x}, 6) + 0.0 AS {x}' for x in CONF.replace(' ', '').split(','))}, {R('roc_auc pr_auc brier log_loss ece mce')} FROM c2 JOIN auc USING (model, fold) JOIN ap USING (model, fold) JOIN fm USING (model, fold) JOIN ec USING (model, fold)", C2 | auc("model, fold", "preds") | AP | REL)
put("select_threshold", "preds", f"SELECT model, fold, CASE WHEN flat THEN 0.5 ELSE threshold END AS threshold, CASE WHEN NOT flat THEN {'round(score, 6) + 0.0'} END AS score FROM b QUALIFY row_number() OVER (PARTITION BY model, fold ORDER BY score DESC NULLS LAST, threshold) = 1", {
    "g": "SELECT k / 100.0::DOUBLE AS threshold FROM range(5, 96) t(k)",
    "s": "SELECT model, fold, threshold, sum(CASE WHEN p >= threshold THEN y ELSE 0 END) AS tp, sum(CASE WHEN p >= threshold THEN 1 - y ELSE 0 END) AS fp, sum(y) AS np, sum(1 - y) AS nn, min(p) = max(p) AS same FROM preds, g GROUP BY 1, 2, 3",
    "b": "SELECT *, np = 0 OR nn = 0 OR same AS flat, round((tp / nullif(np, 0) + (nn - fp) / nullif(nn, 0)) / 2, 12) AS score FROM s",
})
EVALUATED = C2 | auc("model, fold", "preds") | AP | REL | {
    "em": "SELECT model, fold, c2.accuracy, c2.accuracy_over_base_rate, roc_auc, pr_auc, fm.brier, ece, c2.f1, fm.log_loss FROM c2 JOIN auc USING (model, fold) JOIN ap USING (model, fold) JOIN fm USING (model, fold) JOIN ec USING (model, fold)",
}
MEASURES = "accuracy accuracy_over_base_rate roc_auc pr_auc brier ece f1 log_loss"
BOARD = {"lb": "SELECT model, count(*) AS folds, model <> 'signal' AS is_baseline, " + ", ".join(f"avg({x}) AS {x}, stddev_samp({x}) / sqrt(count({x})) AS {x}_se" for x in MEASURES.split()) + " FROM em GROUP BY 1"}
put("leaderboard", "conf fm", f"SELECT model, folds, is_baseline, {R(MEASURES + ' ' + ' '.join(f'{x}_se' for x in MEASURES.split()))} FROM lb", EVALUATED | BOARD)
RANKS = {
    "d": "SELECT a.model, round(a.brier - b.brier, 12) AS d FROM fm a JOIN fm b USING (fold) WHERE a.model <> 'majority' AND b.model = 'majority'",
    "q": "SELECT *, rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2.0 AS r FROM d",
    "z": "SELECT model, count(*) AS folds, sum((d > 0)::INT)::BIGINT AS wins, avg(d) AS mean_diff, sum(CASE WHEN d > 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END) AS w_minus FROM q GROUP BY 1",
}
# The p-value by going through all patterns of signs of the differences that aren't zero.
PATTERNS = {
    "h": "SELECT model, count(*) AS folds, list(CASE WHEN d <> 0 THEN 2 * r END) FILTER (WHERE d <> 0) AS r, sum(CASE WHEN d = 0 THEN r / 2 ELSE 0 END) AS still FROM q GROUP BY 1",
    "pv": """SELECT z.model, CASE WHEN z.folds < 3 THEN NULL WHEN h.r IS NULL THEN 1.0 ELSE least(1.0, 2.0 * len(list_filter(range(1 << len(h.r)), lambda s:
      list_sum(list_transform(range(len(h.r)), lambda k: ((s >> k) & 1) * h.r[k + 1])) <= 2 * (least(w_plus, w_minus) - still) + 1e-9)) / (1 << len(h.r))) END::DOUBLE AS p FROM z JOIN h USING (model)""",
}
AREAS = RANKS | {"d": "SELECT a.model, round(a.roc_auc - b.roc_auc, 12) AS d FROM em a JOIN em b USING (fold) WHERE b.model = 'majority' AND a.roc_auc IS NOT NULL AND b.roc_auc IS NOT NULL"} | PATTERNS | {
    "adj": "SELECT model, p, CASE WHEN p IS NOT NULL THEN least(1.0, min(x) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS p_adj FROM (SELECT *, row_number() OVER (ORDER BY p NULLS LAST, model) AS k, p * count(p) OVER () / row_number() OVER (ORDER BY p NULLS LAST, model) AS x FROM pv)",
}
put("leaderboard_tests", "conf fm", f"SELECT model, lb.folds, is_baseline, {R('roc_auc brier')}, wins, {R('mean_diff')}, round(least(w_plus, w_minus), 6) + 0.0 AS w, {R('p p_adj')} FROM lb LEFT JOIN z USING (model) LEFT JOIN adj USING (model)", EVALUATED | BOARD | AREAS)
put("wilcoxon_p", "fm", f"SELECT model, z.folds, round(least(w_plus, w_minus), 6) + 0.0 AS w, {R('p')} FROM z JOIN pv USING (model)", RANKS | PATTERNS)
WALK = FOLDS | {
    "sp": " UNION ALL ".join(f"SELECT fold, '{p}' AS part, {p}_start AS a, {p}_end AS b FROM ff" for p in ("fit", "inner", "test")),
    "wb": "SELECT b.ticker, b.date, pos, b.ret_1d, b.y, CASE WHEN ticker IN ('AF', 'AO', 'NF') THEN 'dev' WHEN ticker = 'NO' THEN 'val' ELSE 'test' END AS grp FROM book b JOIN days USING (date)",
}


def walk(train: str, score: str) -> dict[str, str]:
    return WALK | {
        "w0": f"SELECT wb.*, sp.fold, sp.part FROM wb JOIN sp ON pos BETWEEN sp.a AND sp.b WHERE CASE WHEN part = 'test' THEN {score} ELSE {train} END",
        "wr": "SELECT fold, avg(y) AS m, avg(y) FILTER (WHERE ret_1d > 0) AS up, avg(y) FILTER (WHERE ret_1d IS NULL OR ret_1d <= 0) AS down FROM w0 WHERE part = 'fit' GROUP BY 1",
        "wp": "SELECT w0.*, u.model, u.p FROM w0 JOIN wr USING (fold), LATERAL (VALUES ('majority', m), ('persistence', CASE WHEN ret_1d IS NULL THEN 0.5 WHEN ret_1d > 0 THEN up ELSE down END), ('always_long', 1 - 1e-6)) u(model, p) WHERE part <> 'fit'",
        # The monotone fit at each inner score: the largest over lower ends of the smallest mean over upper ends.
        "wk": "SELECT model, fold, p, sum(y) AS pos, count(*) AS c, sum(count(*)) OVER (PARTITION BY model, fold) AS n, sum(sum(y)) OVER (PARTITION BY model, fold) AS np FROM wp WHERE part = 'inner' GROUP BY 1, 2, 3",
        "wm": "SELECT i.model, i.fold, i.p AS a, j.p AS b, sum(m.pos) / sum(m.c) AS mean FROM wk i JOIN wk j ON i.model = j.model AND i.fold = j.fold AND i.p <= j.p JOIN wk m ON m.model = i.model AND m.fold = i.fold AND m.p BETWEEN i.p AND j.p GROUP BY 1, 2, 3, 4",
        "wi": "SELECT model, fold, p, max(least) AS f FROM (SELECT wk.model, wk.fold, wk.p, wm.a, min(mean) AS least FROM wk JOIN wm ON wm.model = wk.model AND wm.fold = wk.fold AND wm.a <= wk.p AND wm.b >= wk.p GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3",
        "wq": """SELECT wp.*, k.n, k.np, (SELECT arg_max(f, wi.p) FROM wi WHERE wi.model = wp.model AND wi.fold = wp.fold AND wi.p <= wp.p) AS f0, (SELECT max(wi.p) FROM wi WHERE wi.model = wp.model AND wi.fold = wp.fold AND wi.p <= wp.p) AS p0,
          (SELECT arg_min(f, wi.p) FROM wi WHERE wi.model = wp.model AND wi.fold = wp.fold AND wi.p >= wp.p) AS f1, (SELECT min(wi.p) FROM wi WHERE wi.model = wp.model AND wi.fold = wp.fold AND wi.p >= wp.p) AS p1
          FROM wp JOIN (SELECT DISTINCT model, fold, n, np FROM wk) k ON k.model = wp.model AND k.fold = wp.fold""",
        "wf": "SELECT *, p AS raw, CASE WHEN f0 IS NULL THEN f1 WHEN f1 IS NULL OR p0 = p1 THEN f0 ELSE f0 + (f1 - f0) * (p - p0) / (p1 - p0) END AS fit, least(1.0 / (n + 2), 0.01) AS low FROM wq",
        "wz": "SELECT * EXCLUDE (p), CASE WHEN np = 0 OR np = n THEN raw ELSE least(greatest(fit, low), 1 - low) END AS p FROM wf",
        "wg": "SELECT k / 100.0::DOUBLE AS threshold FROM range(5, 96) t(k)",
        "ws": "SELECT model, fold, threshold, sum(CASE WHEN p >= threshold THEN y ELSE 0 END) AS tp, sum(CASE WHEN p >= threshold THEN 1 - y ELSE 0 END) AS fp, sum(y) AS np, sum(1 - y) AS nn, min(p) = max(p) AS same FROM wz, wg WHERE part = 'inner' GROUP BY 1, 2, 3",
        "wc": "SELECT model, fold, CASE WHEN np = 0 OR nn = 0 OR same THEN 0.5 ELSE threshold END AS threshold FROM ws QUALIFY row_number() OVER (PARTITION BY model, fold ORDER BY round((tp / nullif(np, 0) + (nn - fp) / nullif(nn, 0)) / 2, 12) DESC NULLS LAST, threshold) = 1",
        "preds": "SELECT wz.date, wz.ticker, wz.fold, wz.model, raw, p, y, threshold FROM wz JOIN wc USING (model, fold) WHERE part = 'test'",
        "nf": "SELECT fold, sum((part = 'fit')::INT)::BIGINT AS n_fit, sum((part = 'inner')::INT)::BIGINT AS n_inner, sum((part = 'test')::INT)::BIGINT AS n_test FROM w0 GROUP BY 1",
        "conf": CTE["conf"], "fm": CTE["fm"],
    }


def tuned() -> dict[str, str]:
    return {
        "tc": "SELECT model, fold, min(date) AS test_start, max(date) AS test_end, any_value(threshold) AS tuned_threshold, count(*) AS n, sum((p >= threshold AND y = 1)::INT)::BIGINT AS tp, sum((p >= threshold AND y = 0)::INT)::BIGINT AS fp, sum((p < threshold AND y = 1)::INT)::BIGINT AS fn, sum((p < threshold AND y = 0)::INT)::BIGINT AS tn FROM preds GROUP BY 1, 2",
        "rb": "SELECT model, fold, avg((raw - y) ** 2) AS brier_uncalibrated FROM preds GROUP BY 1, 2",
        "rx": "SELECT * REPLACE (raw AS p) FROM preds",
        "tt": "SELECT model, fold, test_start, test_end, tuned_threshold, (tp + tn) / n AS tuned_accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS tuned_precision, coalesce(tp / nullif(tp + fn, 0), 0) AS tuned_recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS tuned_f1, (tp + fp) / n AS tuned_positive_rate FROM tc",
    }


def raw_bins() -> dict[str, str]:
    """The relations of REL over the raw probabilities, under names of their own."""
    own = {"eg": "raw_eg", "bn": "raw_bn", "rl": "raw_rl", "ec": "raw_ec", "preds": "rx"}
    return {own[n]: re.sub(r"\b(eg|bn|rl|preds)\b", lambda m: own[m[1]], sql) for n, sql in REL.items()}


put("walk_forward", "book days", f"SELECT date, ticker, fold, model, {R('prob_raw prob y_true threshold')}, true AS is_baseline FROM (SELECT date, ticker, fold, model, raw AS prob_raw, p AS prob, y AS y_true, threshold FROM preds)", walk("true", "true"))
for _name, _train, _score in (("walk_forward_metrics", "true", "true"), ("walk_forward_held_out", "grp = 'dev'", "grp = 'test'")):
    put(_name, "book days", f"""SELECT model, fold, true AS is_baseline, test_start, test_end, {R('tuned_threshold')}, n, tp, fp, fn, tn, {', '.join(f'round(c2.{x}, 6) + 0.0 AS {x}' for x in CONF.replace(' ', '').split(','))}, {R('roc_auc pr_auc brier log_loss ece mce tuned_accuracy tuned_precision tuned_recall tuned_f1 tuned_positive_rate')},
      round(raw_ec.ece, 6) + 0.0 AS ece_uncalibrated, {R('brier_uncalibrated')}, n_fit, n_inner, n_test
      FROM c2 JOIN auc USING (model, fold) JOIN ap USING (model, fold) JOIN fm USING (model, fold) JOIN ec USING (model, fold) JOIN tt USING (model, fold) JOIN rb USING (model, fold) JOIN raw_ec USING (model, fold) JOIN nf USING (fold)""".replace("round(ece, 6)", "round(ec.ece, 6)").replace("round(mce, 6)", "round(ec.mce, 6)"), walk(_train, _score) | C2 | auc("model, fold", "preds") | AP | REL | tuned() | raw_bins())
put("performance", "fm", f"SELECT model, folds, {R('accuracy log_loss')}, first_fold FROM (SELECT model, count(*) AS folds, avg(accuracy) AS accuracy, avg(log_loss) AS log_loss, min(fold) AS first_fold FROM fm GROUP BY 1)")
put("paired_folds", "fm", f"SELECT model, fold, {R('value value_ref')} FROM (SELECT a.model, fold, a.accuracy AS value, b.accuracy AS value_ref FROM fm a JOIN fm b USING (fold) WHERE a.model <> 'majority' AND b.model = 'majority')")
put("wilcoxon_w", "fm", f"SELECT model, folds, wins, {R('mean_diff w_plus w_minus')}, round(least(w_plus, w_minus), 6) + 0.0 AS w FROM z", {
    "d": "SELECT a.model, round(a.brier - b.brier, 12) AS d FROM fm a JOIN fm b USING (fold) WHERE a.model <> 'majority' AND b.model = 'majority'",
    "q": "SELECT *, rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2.0 AS r FROM d",
    "z": "SELECT model, count(*) AS folds, sum((d > 0)::INT)::BIGINT AS wins, avg(d) AS mean_diff, sum(CASE WHEN d > 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END) AS w_minus FROM q GROUP BY 1",
})
put("bh_adjust", "", f"SELECT model, {R('p p_adj')} FROM (SELECT model, p, least(1.0, min(q) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM b)", {
    "a": "SELECT o_orderpriority AS model, round(avg((o_totalprice % 7) / 70), 8) AS p FROM orders GROUP BY 1",
    "b": "SELECT *, row_number() OVER (ORDER BY p, model) AS k, p * count(*) OVER () / row_number() OVER (ORDER BY p, model) AS q FROM a",
})
put("latest_run", "", f"SELECT target, experiment, run_id, {R('score')} FROM (SELECT o_orderstatus AS target, o_orderpriority AS experiment, max(o_orderkey) AS run_id, arg_max(o_totalprice, o_orderkey) AS score FROM orders GROUP BY 1, 2)")
put("top_contributions", "rets", f"SELECT ticker, date, feature, {R('value')}, rank FROM r", {
    "x": "SELECT ticker, date, u.feature, round(u.value, 6) AS value FROM rets, LATERAL (VALUES ('a', ret_1d), ('b', high / low - 1.5), ('c', open / close - 1)) u(feature, value) WHERE ret_1d IS NOT NULL",
    "r": "SELECT *, row_number() OVER (PARTITION BY ticker, date, sign(value) ORDER BY abs(value) DESC, feature) AS rank FROM x WHERE value <> 0 QUALIFY rank <= 2",
})
put("importance_stability", "book", f"SELECT feature, appearances, {R('mean_rank std_rank')} FROM (SELECT feature, sum((r <= 3)::INT)::BIGINT AS appearances, avg(r) AS mean_rank, stddev_pop(r) AS std_rank FROM q GROUP BY 1)", {
    "a": "SELECT fold, ticker AS feature, round(avg(abs(ret_1d)), 9) AS value FROM book GROUP BY 1, 2",
    "q": "SELECT *, row_number() OVER (PARTITION BY fold ORDER BY value DESC, feature) AS r FROM a WHERE value IS NOT NULL",
})

put("error_breakdown", "sig", f"SELECT outcome, n, {R('mean_p mean_confidence')}, round(n / sum(n) OVER (), 6) + 0.0 AS share FROM (SELECT CASE WHEN p >= 0.5 THEN CASE WHEN y = 1 THEN 'TP' ELSE 'FP' END WHEN y = 1 THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS n, avg(p) AS mean_p, avg(confidence) AS mean_confidence FROM sig GROUP BY 1)")
put("confidence_deciles", "sig", f"SELECT bin, n, {R('mean_confidence accuracy base_rate')} FROM (SELECT bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(correct) AS accuracy, avg(y) AS base_rate FROM bn GROUP BY 1)", bins("", "sig", "confidence", 10, "<"))
put("perf_by_bucket", "sig", f"SELECT bin, n, {R('mean_value accuracy base_rate roc_auc')} FROM (SELECT bin, count(*) AS n, avg(ret_1d) AS mean_value, avg(correct) AS accuracy, avg(y) AS base_rate FROM bn GROUP BY 1) JOIN auc USING (bin)", {"sg": "SELECT * FROM sig WHERE ret_1d IS NOT NULL"} | bins("", "sg", "ret_1d", 5, "<") | auc("bin", "bn"))
put("perf_by_ticker", "sig", f"SELECT ticker, n, {R('accuracy base_rate roc_auc')} FROM (SELECT ticker, count(*) AS n, avg(correct) AS accuracy, avg(y) AS base_rate FROM sig GROUP BY 1) JOIN auc USING (ticker)", auc("ticker", "sig"))
DAILY = {"dl": "SELECT date, avg(correct) AS accuracy, count(*) AS n FROM sig GROUP BY 1"}
put("daily_accuracy", "sig", f"SELECT date, {R('accuracy')}, n FROM dl", DAILY)
put("rolling_accuracy", "sig", f"SELECT date, {R('rolling_accuracy')} FROM (SELECT date, CASE WHEN count(*) OVER w >= 30 THEN avg(accuracy) OVER w END AS rolling_accuracy FROM dl WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))", DAILY)
put("high_conf_errors", "sig", f"SELECT ticker, date, {R('p y confidence')} FROM sig WHERE correct = 0 AND confidence >= (SELECT quantile_cont(confidence, 0.9) FROM sig)")
FLIPS = {
    "px": f"SELECT date, close / {sma('close', 50)} - 1 AS px FROM rets",
    "tr": "SELECT date, round(avg(px), 9) AS value FROM px GROUP BY 1 HAVING avg(px) IS NOT NULL",
    "fl": "SELECT date AS flip FROM (SELECT date, sign(value) AS s, lag(sign(value)) OVER (ORDER BY date) AS b FROM tr) WHERE b IS NOT NULL AND s <> b",
    "nr": "SELECT sig.*, EXISTS (SELECT 1 FROM fl WHERE sig.date BETWEEN flip - 2 AND flip + 2) AS near FROM sig",
}
put("trend_flips", "rets", "SELECT flip FROM fl", {k: FLIPS[k] for k in ("px", "tr", "fl")})
put("near_reversal", "rets sig", "SELECT ticker, date, near FROM nr", FLIPS)
put("reversal_stats", "rets sig", f"SELECT near, n, {R('accuracy')} FROM (SELECT near, count(*) AS n, avg(correct) AS accuracy FROM nr GROUP BY 1)", FLIPS)
put("auc_by_regime", "preds states", f"SELECT a.model, a.state, round(a.roc_auc, 6) + 0.0 AS roc_auc, round(a.roc_auc - m.roc_auc, 6) + 0.0 AS lift FROM auc a LEFT JOIN auc m ON m.state = a.state AND m.model = 'majority'", {"pr": "SELECT p.*, s.state FROM preds p JOIN states s USING (date)"} | auc("model, state", "pr"))
put("predictions_regime", "sig states", f"SELECT ticker, date, {R('p y')}, state FROM sig LEFT JOIN states USING (date)")
put("ui_accuracy_by_regime", "sig states", f"SELECT state, n, {R('accuracy base_rate')} FROM (SELECT state, count(*) AS n, avg(correct) AS accuracy, avg(y) AS base_rate FROM sig JOIN states USING (date) GROUP BY 1)")
put("ui_confidence_buckets", "sig", f"SELECT bucket, n, {R('accuracy')} FROM (SELECT least(9, floor(round(confidence * 40, 6)))::BIGINT AS bucket, count(*) AS n, avg(correct) AS accuracy FROM sig GROUP BY 1) WHERE n >= 20")
put("ui_confident_stats", "sig", f"SELECT ticker, side, n, {R('accuracy')} FROM (SELECT ticker, side, count(*) AS n, avg(correct) AS accuracy FROM (SELECT ticker, correct, 'top' AS side FROM z WHERE k <= m UNION ALL SELECT ticker, correct, 'bottom' FROM z WHERE k > n - m) GROUP BY 1, 2)", {
    "y": "SELECT ticker, correct, row_number() OVER (PARTITION BY ticker ORDER BY confidence DESC, date) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM sig", "z": "SELECT *, greatest(1, floor(n * 0.1 + 1e-9)) AS m FROM y",
})
put("ui_rolling_accuracy", "sig", f"SELECT ticker, date, {R('accuracy')} FROM (SELECT ticker, date, row_number() {W} - 1 AS k, avg(correct) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS accuracy FROM sig) WHERE k >= 60 AND (k - 60) % 5 = 0")

BREADTH = {"br": f"SELECT date, avg(CASE WHEN px > 0 THEN 1.0 ELSE 0.0 END) AS breadth_above_sma50 FROM (SELECT date, close / {sma('close', 50)} - 1 AS px FROM rets) GROUP BY 1"}
put("breadth", "rets", f"SELECT date, {R('breadth_above_sma50')} FROM br", BREADTH)


def mk(e, x, k):
    w = f"OVER (ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {w} >= {k} THEN {e} {w} END)"


REG = "mkt_ret_20 mkt_ret_60 mkt_vol_20 mkt_vol_ratio_20_60 mkt_drawdown_252 vix_z_60 breadth_above_sma50"
put("regime_features", "rets ctx", f"SELECT date, {R(REG)} FROM g JOIN br USING (date) WHERE {' AND '.join(f'{x} IS NOT NULL' for x in REG.split())}", BREADTH | {
    "cr": "SELECT *, ln(bench_close / lag(bench_close) OVER (ORDER BY date)) AS r FROM ctx",
    "g": f"""SELECT date, ln(bench_close / lag(bench_close, 20) OVER (ORDER BY date)) AS mkt_ret_20, ln(bench_close / lag(bench_close, 60) OVER (ORDER BY date)) AS mkt_ret_60, {mk('stddev_samp(r)', 'r', 20)} * {YEAR} AS mkt_vol_20,
      {mk('stddev_samp(r)', 'r', 20)} / nullif({mk('stddev_samp(r)', 'r', 60)}, 0) AS mkt_vol_ratio_20_60, bench_close / {mk('max(bench_close)', 'bench_close', 252)} - 1 AS mkt_drawdown_252,
      (vix - {mk('avg(vix)', 'vix', 60)}) / nullif({mk('stddev_samp(vix)', 'vix', 60)}, 0) AS vix_z_60 FROM cr""",
})
TL = {
    "c1": "SELECT date, state, CASE WHEN state = lag(state) OVER (ORDER BY date) THEN 0 ELSE 1 END AS ch FROM states",
    "c3": "SELECT *, sum(ch) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run FROM c1",
    "tl": "SELECT run, any_value(state) AS state, min(date) AS start, max(date) AS \"end\", count(*) AS sessions FROM c3 GROUP BY 1",
}
put("regime_timeline", "states", 'SELECT run, state, start, "end", sessions FROM tl', TL)
put("run_lengths", "states", f"SELECT state, runs, shortest, {R('mean_sessions')} FROM (SELECT state, count(*) AS runs, min(sessions) AS shortest, avg(sessions) AS mean_sessions FROM tl GROUP BY 1)", TL)
put("regime_switches", "states", f"SELECT runs, sessions, shortest, {R('median per_year')} FROM (SELECT count(*) AS runs, sum(sessions)::BIGINT AS sessions, min(sessions) AS shortest, quantile_cont(sessions, 0.5) AS median, count(*) / (sum(sessions) / 252.0) AS per_year FROM tl)", TL)
put("state_shares", "states", "SELECT state, n, round(n / sum(n) OVER (), 6) + 0.0 AS share FROM (SELECT state, count(*) AS n FROM states GROUP BY 1)")
put("expected_durations", "states", f"SELECT state, {R('expected_sessions')} FROM (SELECT state, 1 / greatest(1 - sum((state = nx)::INT) / count(*), 1e-9) AS expected_sessions FROM (SELECT state, lead(state) OVER (ORDER BY date) AS nx FROM states) WHERE nx IS NOT NULL GROUP BY 1)")
put("transition_matrix", "states", 'SELECT state, "next", n, round(n / sum(n) OVER (PARTITION BY state), 6) + 0.0 AS p FROM (SELECT state, "next", count(*) AS n FROM (SELECT state, lead(state) OVER (ORDER BY date) AS "next" FROM states) WHERE "next" IS NOT NULL GROUP BY 1, 2)')
DESC = {
    "mr": "SELECT date, vix, ln(bench_close / lag(bench_close) OVER (ORDER BY date)) AS ret FROM ctx",
    "ds": f"SELECT state, count(*) AS sessions, avg(ret) AS mean_ret, avg(ret) * 252 AS annual_return, stddev_samp(ret) * {YEAR} AS annual_vol, avg(vix) AS mean_vix, count(*) / sum(count(*)) OVER () AS share FROM states JOIN mr USING (date) GROUP BY 1",
}
put("describe_states", "states", f"SELECT state, sessions, {R('mean_ret annual_return annual_vol mean_vix share')} FROM ds", DESC)
put("state_labels", "states", """SELECT state, CASE WHEN r > 0.66 THEN 'high volatility' WHEN r < 0.34 THEN 'low volatility' ELSE 'moderate volatility' END || ', ' || CASE WHEN mean_ret > 0.005 THEN 'rising' WHEN mean_ret < -0.005 THEN 'falling' ELSE 'flat' END AS label
  FROM (SELECT *, (rank() OVER (ORDER BY annual_vol) + (count(*) OVER (PARTITION BY annual_vol) - 1) / 2.0) / count(*) OVER () AS r FROM ds)""", DESC)
put("state_order", "states", "SELECT state, row_number() OVER (ORDER BY annual_vol, state) - 1 AS state_order FROM ds", DESC)
put("argmax_state", "", "SELECT event_id, (CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END)::BIGINT AS state FROM (SELECT event_id, value % 3 AS a, value % 5 AS b, value % 7 AS c FROM events)")
put("matched_agreement", "states", "SELECT state, other, count(*) AS n FROM (SELECT state, lag(state, 5) OVER (ORDER BY date) AS other FROM states) WHERE other IS NOT NULL GROUP BY 1, 2")
put("ui_regime_totals", "states", "SELECT state, sessions, episodes, round(sessions / sum(sessions) OVER (), 6) + 0.0 AS share FROM (SELECT state, sum(sessions)::BIGINT AS sessions, count(*) AS episodes FROM tl GROUP BY 1)", TL)


def wts(ret: str) -> dict[str, str]:
    return {
        "gr": "SELECT d.date, t.ticker FROM (SELECT DISTINCT date FROM sig) d, (SELECT DISTINCT ticker FROM sig) t",
        "dn": f"SELECT gr.date, gr.ticker, coalesce({ret}, 0) AS ret, CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS s FROM gr LEFT JOIN sig USING (date, ticker)",
        "wt": "SELECT *, coalesce(s / nullif(sum(s) OVER (PARTITION BY date), 0), 0) AS weight FROM dn",
        "ch": f"SELECT *, abs(weight - coalesce(lag(weight) {W}, 0)) AS change FROM wt",
        "sm": "SELECT date, sum(weight * ret) AS gross, sum(change) AS traded, sum((weight > 0)::INT)::BIGINT AS positions, sum(weight * ret) - sum(change) * 5.0 * 1e-4 AS net FROM ch GROUP BY 1",
    }


def stats(keys: str) -> dict[str, str]:
    part = f"PARTITION BY {keys} " if keys else ""
    head, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return {
        "eq": f"SELECT *, exp(sum(ln(1 + net)) OVER ({part}ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM src",
        "dd": f"SELECT *, equity / max(equity) OVER ({part}ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM eq",
        "st": f"SELECT {head}avg(net) * 252 AS annual_return, stddev_samp(net) * {YEAR} AS annual_vol, coalesce(avg(net) * 252 / nullif(stddev_samp(net) * {YEAR}, 0), 0) AS sharpe, min(drawdown) AS max_drawdown, avg((net > 0)::INT) AS hit_rate, avg(traded) AS turnover, avg(positions) AS mean_positions FROM dd {group}",
    }


STATS = "annual_return annual_vol sharpe max_drawdown hit_rate turnover mean_positions"
SMALL = wts("ln(1 + ret) / 100")
put("weights", "sig", f"SELECT date, ticker, {R('weight')} FROM wt SEMI JOIN sig USING (date, ticker)", {k: wts("ret")[k] for k in ("gr", "dn", "wt")})
put("simulate", "sig", f"SELECT date, {R('gross traded')}, positions, {R('net')} FROM sm", wts("ret"))
put("turnover", "sig", f"SELECT date, {R('traded')} FROM sm", wts("ret"))
EQ = {
    "src": "SELECT date, ret / 100 AS net, 0 AS traded, 0 AS positions FROM (SELECT date, ln(bench_close / lag(bench_close) OVER (ORDER BY date)) AS ret FROM ctx) WHERE ret IS NOT NULL",
} | {k: v for k, v in stats("").items() if k != "st"}
put("equity_curve", "ctx", f"SELECT date, {R('equity')} FROM eq", EQ)
put("max_drawdown", "ctx", "SELECT round(min(drawdown), 6) + 0.0 AS max_drawdown FROM dd", EQ)
put("backtest_metrics", "sig", f"SELECT {R(STATS)} FROM st", SMALL | {"src": "SELECT * FROM sm"} | stats(""))
put("cost_sweep", "sig", f"SELECT bps, {R(STATS)} FROM st", SMALL | {"src": "SELECT date, gross, traded, positions, b.bps, gross - traded * b.bps * 1e-4 AS net FROM sm, (VALUES (0.0::DOUBLE), (5.0), (10.0), (20.0)) b(bps)"} | stats("bps"))
put("break_even", "sig", "SELECT round(greatest(0.0, coalesce(avg(gross) / nullif(avg(traded) * 1e-4, 0), 0)), 6) + 0.0 AS break_even_bps FROM sm", SMALL)
put("buy_and_hold", "book", f"SELECT date, {R('ret')} FROM (SELECT date, avg(ret) AS ret FROM book GROUP BY 1)")
put("snapshot", "bars", f"SELECT ticker, date, {R('close change change_pct')} FROM (SELECT ticker, date, close, close - b AS change, close / b - 1 AS change_pct FROM (SELECT *, lag(close) {W} AS b FROM bars) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)")
put("tail_n", "bars", f"SELECT ticker, date, {R('close')} FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 60")
put("history", "rets", f"SELECT ticker, date, {R('close volume sma_20 sma_50 vol_20')} FROM h WHERE k <= 250", {"h": f"SELECT ticker, date, close, volume, {sma('close', 20)} AS sma_20, {sma('close', 50)} AS sma_50, {std('ret_1d', 20)} * {YEAR} AS vol_20, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM rets"})
put("config_hash", "", """SELECT r_regionkey, substr(sha256('{"name":"' || r_name || '","region":' || r_regionkey || '}'), 1, 12) AS config_hash FROM region""")
SECTORS = "technology information_technology communication_services financial_services financials healthcare consumer_cyclical consumer_discretionary consumer_defensive consumer_staples energy industrials utilities basic_materials materials".split()
FUNDS = "XLK XLK XLK XLF XLF XLV XLY XLY XLP XLP XLE XLI XLU XLB XLB".split()
put("sector_resolve", "", f"SELECT c_custkey, coalesce(etf, 'SPY') AS sector, etf IS NULL AS proxy FROM (SELECT c_custkey, list_extract([{', '.join(f"'{x}'" for x in FUNDS)}], (CASE WHEN c_custkey % 18 < 15 THEN c_custkey % 18 + 1 END)::BIGINT) AS etf FROM customer)")

put("feature_registry", "bars", f"""SELECT feature, g.grp AS "group", lookback::INT AS lookback, true AS scale_free, (SELECT sum(greatest(n - g.warm, 0)) FROM (SELECT ticker, count(*) AS n FROM bars GROUP BY 1))::BIGINT AS n_rows
  FROM (VALUES {', '.join([f"('ret_{n}d', {n + 1}, 'price')" for n in (1, 3, 5, 10, 20)] + [f"('ret_1d_lag{k}', {k + 2}, 'price')" for k in range(1, 6)] + [f"('{n}', {k}, 'volume')" for n, k in (("rel_volume_20", 20), ("volume_z_20", 20), ("dollar_volume_ratio_20", 20), ("price_volume_corr_20", 21))] + [f"('{n}', {k}, 'trend')" for n, k in (("efficiency_ratio_20", 21), ("dist_high_252", 252), ("dist_low_252", 252), ("up_day_ratio_20", 21))])}) f(feature, lookback, grp)
  JOIN (VALUES ('price', 21), ('volume', 21), ('trend', 252)) g(grp, warm) USING (grp)""")
