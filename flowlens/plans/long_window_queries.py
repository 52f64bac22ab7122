"""Price queries with all windows (5 to 240 days), the low levels 0 to 4 and the 25 conditions on market states.

The queries of the same names without ``_full`` show the same operators with the three short windows.  Series here
are by brand, as the events' targets are, so that events meet a price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prices, stats
from . import flow_queries as Q
from . import views as V

SHORT, LONG = (5, 10, 20), (60, 120, 240)
CONDITIONS = (
    {f"above{n}": f"above{n}" for n in SHORT} | {f"below{n}": f"below{n}" for n in prices.WINDOWS} | {f"up{n}": f"up{n}" for n in SHORT} | {f"down{n}": f"down{n}" for n in SHORT}
    | {"above all": "position = '111'"} | {f"low {k}": f"low >= {k}" for k in (1, 2, 3)} | {"low 4": "low = 4", "bull": "bull", "bear": "bear"} | {f"slope {x}": f"slope = '{x}'" for x in ("up", "flat", "down")}
)
_MAS = [f"ma{n}" for n in prices.WINDOWS]
#: An event's states count only if all of these are there.
_NEEDED = [*_MAS, "prev_close", *(f"prev_ma{n}" for n in SHORT), "ma20_back"]


def series(s: SparkSession, d: str) -> DataFrame:
    rows = V.table(s, d, "lineitem").join(V.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("series")), "l_partkey")
    # Whole cents, so that averages don't depend on the order of rows.
    cents = F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint"))
    return rows.groupBy("series", F.to_date("l_shipdate").alias("date")).agg((F.floor(cents / F.sum(F.col("l_quantity").cast("bigint")) + 0.5)).cast("double").alias("close"))


def features(s: SparkSession, d: str) -> DataFrame:
    return prices.price_lags(prices.moving_averages(series(s, d)), SHORT)


def states(s: SparkSession, d: str) -> DataFrame:
    return prices.ma_states(features(s, d), SHORT, prices.LOWS)


def events(s: SparkSession, d: str) -> DataFrame:
    return V.events(s, d).select(F.col("target").alias("series"), "day", "event_id")


def stated_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Outcomes with their day's states, null where a window or lag isn't full yet."""
    full = states(s, d).dropna(subset=_NEEDED).drop("close", "prev_close", *_NEEDED).withColumnsRenamed({"series": "target", "date": "day"})
    return V.outcomes(s, d).join(full, ["target", "day"], "left")


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: stats.rounded(F.col(c), 4) for c in _NEEDED if c in df.columns and c != "prev_close"})


QUERIES = {
    "w1_moving_averages_full": lambda s, d: _shown(prices.moving_averages(series(s, d))),
    "w2_price_lags_full": lambda s, d: _shown(features(s, d)),
    "w3_ma_states_full": lambda s, d: states(s, d).drop(*_NEEDED),
    "w4_calendar_complete_full": lambda s, d: prices.calendar_complete(events(s, d), series(s, d), series(s, d).select("date").distinct()),
    "j5_attach_price_features_full": lambda s, d: _shown(prices.attach_price_features(events(s, d), states(s, d))),
    "a7_condition_stats_full": lambda s, d: stats.condition_stats(stated_outcomes(s, d), {k: F.expr(v) for k, v in CONDITIONS.items()}),
}

_SERIES = "series AS (SELECT p_brand AS series, l_shipdate::DATE AS date, floor(sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::DOUBLE / sum(l_quantity::BIGINT)::DOUBLE + 0.5) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
_AVERAGES = ", ".join(f"CASE WHEN count(close) OVER w{n} = {n} THEN avg(close) OVER w{n} END AS ma{n}" for n in prices.WINDOWS)
_FRAMES = ", ".join(f"w{n} AS (PARTITION BY series ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in prices.WINDOWS)
_LAGS = ", ".join(f"lag(ma{n}) OVER o AS prev_ma{n}" for n in SHORT)
_FEATURES = f"{_SERIES}, mas AS (SELECT *, {_AVERAGES} FROM series WINDOW {_FRAMES}), feats AS (SELECT *, lag(close) OVER o AS prev_close, {_LAGS}, lag(ma20, 5) OVER o AS ma20_back FROM mas WINDOW o AS (PARTITION BY series ORDER BY date))"
_FLAGS = ", ".join(f"close > ma{n} AS above{n}, close < ma{n} AS below{n}, close > ma{n} AND prev_close <= prev_ma{n} AS up{n}, close < ma{n} AND prev_close >= prev_ma{n} AS down{n}" for n in SHORT)
_LOW = "CASE WHEN NOT (close < ma5 AND close < ma10 AND close < ma20) THEN 0 WHEN close < ma5 AND close < ma10 AND close < ma20 THEN 1 + CASE WHEN close < ma60 THEN 1 + CASE WHEN close < ma120 THEN 1 + CASE WHEN close < ma240 THEN 1 ELSE 0 END ELSE 0 END ELSE 0 END ELSE 0 END AS low"
_STATES = f"{_FEATURES}, states AS (SELECT *, {_FLAGS}, " + ", ".join(f"close < ma{n} AS below{n}" for n in LONG) + f", ma5 > ma10 AND ma10 > ma20 AS bull, ma5 < ma10 AND ma10 < ma20 AS bear, (close > ma5)::INT::VARCHAR || (close > ma10)::INT::VARCHAR || (close > ma20)::INT::VARCHAR AS position, {_LOW}, CASE WHEN ma20_back IS NULL OR ma20 IS NULL THEN NULL WHEN abs((ma20 - ma20_back) / abs(ma20_back)) <= 0.001 THEN 'flat' WHEN ma20 > ma20_back THEN 'up' ELSE 'down' END AS slope FROM feats)"
_LONG_ROUND = ", ".join(f"floor({c} * 1e4 + 0.5) / 1e4 AS {c}" for c in _NEEDED if c != "prev_close")
_MA_ROUND = ", ".join(f"floor({c} * 1e4 + 0.5) / 1e4 AS {c}" for c in _MAS)
_EV = "ev AS (SELECT target AS series, day, event_id FROM events)"
_STATED = "stated AS (SELECT o.*, x.* EXCLUDE (series, date, close, " + ", ".join(_NEEDED) + ") FROM coded o LEFT JOIN (SELECT * FROM states WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _NEEDED) + ") x ON x.series = o.target AND x.date = o.day)"
_CONDED = "conded AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS condition FROM stated WHERE {v}" for k, v in CONDITIONS.items()) + ")"
_GRID = "grid AS (SELECT b.broker, c.condition, k.code FROM (SELECT DISTINCT broker FROM outcomes) b, (VALUES " + ", ".join(f"('{k}')" for k in CONDITIONS) + ") c(condition), (VALUES ('ALL'), ('A'), ('B'), ('C'), ('D'), ('E')) k(code))"

ORACLE_SQL = {
    "w1_moving_averages_full": f"WITH {_FEATURES} SELECT series, date, close, {_MA_ROUND} FROM mas",
    "w2_price_lags_full": f"WITH {_FEATURES} SELECT series, date, close, prev_close, {_LONG_ROUND} FROM feats",
    "w3_ma_states_full": f"WITH {_STATES} SELECT * EXCLUDE ({', '.join(_NEEDED)}) FROM states",
    "w4_calendar_complete_full": f"WITH {V.EVENTS}, {_SERIES}, {_EV}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM series)), gaps AS (SELECT k.series, c.date, c.pos FROM (SELECT DISTINCT series FROM series) k CROSS JOIN cal c WHERE NOT EXISTS (SELECT 1 FROM series s WHERE s.series = k.series AND s.date = c.date)), e AS (SELECT DISTINCT ev.series, ev.day, c.pos FROM ev LEFT JOIN cal c ON c.date = ev.day), m AS (SELECT e.series, e.day, e.pos, string_agg(strftime(g.date, '%Y-%m-%d'), ',' ORDER BY g.pos) AS said FROM e LEFT JOIN gaps g ON g.series = e.series AND g.pos BETWEEN e.pos - 239 AND e.pos GROUP BY ALL) SELECT series, day, CASE WHEN pos IS NULL THEN 'Missing: not a market day' WHEN pos < 239 THEN 'Missing: too early' WHEN said IS NOT NULL THEN 'Missing: ' || array_to_string(string_split(said, ',')[1:5], ',') ELSE 'OK' END AS status FROM m",
    "j5_attach_price_features_full": f"WITH {V.EVENTS}, {_STATES}, {_EV} SELECT ev.series, ev.day, event_id, states.* EXCLUDE (series, date) REPLACE ({_LONG_ROUND}), CASE WHEN close IS NULL THEN 'Missing: no price' ELSE 'OK' END AS ma_status FROM ev LEFT JOIN states ON states.series = ev.series AND states.date = ev.day",
    "a7_condition_stats_full": f"WITH {V.OUTCOMES}, {Q._CODED}, {_STATES}, {_STATED}, {_CONDED}, {_GRID} {Q._COND_STATS}",
}
