"""Queries of the trade-to-statistics chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fifo, stats, trades
from ..sources.tables import resume_checkpoint, shared_path, stored
from . import views as V

CONDITIONS = {
    "all": "true", "early year": "month(day) <= 6", "late year": "month(day) > 6", "monday": "weekday(day) = 0", "friday": "weekday(day) = 4",
    "net buyer": "net_qty > 0", "net seller": "net_qty < 0", "large": "amount >= 75000", "small": "amount < 75000", "many": "qty >= 60",
}
_SQL_CONDITIONS = {k: v.replace("weekday(day)", "(isodow(day) - 1)") for k, v in CONDITIONS.items()}
POSITIONS = ["000", "001", "010", "011", "100", "101", "110", "111"]
_POSITION = "concat(" + ", ".join(f"cast(cast({x} as int) as string)" for x in ("net_qty > 20", "qty > 40", "amount > 75000")) + ")"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_stats(V.outcomes(spark, sf_dir), ["broker"])


def _profiles(s: SparkSession, d: str) -> DataFrame:
    done = V.outcomes(s, d)
    return stats.branch_profiles(done, stats.condition_stats(done, {k: F.expr(v) for k, v in CONDITIONS.items()}), 5)


def _exit_days(s: SparkSession, d: str) -> DataFrame:
    found, sales = V.matched(s, d)
    return fifo.exit_days(found, sales)


def _resumed(s: SparkSession, d: str) -> DataFrame:
    """The history in three runs, each from the one before's checkpoint: the sales matched to each event's lots."""
    facts = stored(V.facts(s, d), "facts")
    events = stored(trades.build_events(facts, V.MIN_SINGLE, V.BOUNDS), "events")
    path = None
    for a, z in (("1900-01-01", "1994-12-31"), ("1995-01-01", "1996-06-30"), ("1996-07-01", "2100-12-31")):
        old, path = path, shared_path(s, "checkpoint")
        part = f"day between '{a}' and '{z}'"
        found = resume_checkpoint(old, events.where(part), V.sales(facts.where(part)), path)
    sold = found.select("broker", "event_id", F.explode("allocations").alias("a"))
    return sold.select("broker", F.col("a.lot_no").alias("code"), "event_id", "a.lot_no", "a.sale_day", "a.qty", F.bround("a.revenue", 6).alias("revenue"), F.bround("a.cost", 6).alias("cost"))


QUERIES = {
    "flagship_branch_class_stats": flagship,
    "j3_keep_tracked": lambda s, d: trades.keep_tracked(V.raw_trades(s, d), V.table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("broker"), F.col("s_name").alias("label"))).groupBy("label").agg(F.count("*").alias("n"), F.sum("buy").alias("buy")),
    "p26_valid_trades": lambda s, d: trades.valid_trades(V.raw_trades(s, d).withColumn("price", F.when(F.col("code") % 10 == 0, "壞值").otherwise(F.col("price").cast("string"))).withColumn("buy", F.when(F.col("code") % 7 == 0, -1).otherwise(F.col("buy")))).groupBy("valid").agg(F.count("*").alias("n"), F.sum("sell").alias("sell")),
    "p27_exclude_securities": lambda s, d: trades.exclude_securities(V.table(s, d, "part").select(F.lpad((F.col("p_partkey") * 7919 % 99_991 * 5).cast("string"), 6, "0").alias("code"), "p_type", "p_name"), "code", ["ECONOMY", "BRASS"]),
    "a1_compact_daily": lambda s, d: trades.compact_daily(V.raw_trades(s, d)),
    "a2_representative_text": lambda s, d: trades.representative_text(V.table(s, d, "part"), ["p_brand"], "p_type"),
    "a3_build_events": lambda s, d: V.events(s, d).drop("lots"),
    "a4_sale_rows": lambda s, d: trades.sale_rows(V.facts(s, d)),
    "p17_instrument_rows": lambda s, d: trades.instrument_rows(V.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("code"), "o_orderkey"), "code").select("o_orderkey"),
    "j6_fifo_match": lambda s, d: V.allocations(s, d).withColumns({c: F.bround(c, 6) for c in ("revenue", "cost")}),
    "j6_resume_match": _resumed,
    "w6_exit_days": _exit_days,
    "a5_event_outcomes": lambda s, d: V.outcomes(s, d).withColumns({c: F.bround(c, 4) for c in ("revenue", "sold_cost")}),
    "a6_summarise_outcomes": lambda s, d: stats.summarise_outcomes(V.outcomes(s, d), ["broker", "target"]),
    "a7_condition_stats": lambda s, d: stats.condition_stats(V.outcomes(s, d), {k: F.expr(v) for k, v in CONDITIONS.items()}),
    "a8_position_stats": lambda s, d: stats.position_stats(V.outcomes(s, d).withColumn("position", F.expr(_POSITION)), "position", POSITIONS),
    "a9_branch_profiles": _profiles,
    "a10_integrity_report": lambda s, d: stats.integrity_report(V.facts(s, d), V.table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct(), V.table(s, d, "orders").select(F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("reason")), 3),
    "a34_stock_master": lambda s, d: trades.stock_master(V.table(s, d, "orders"), "o_custkey", "o_orderpriority", "o_orderdate"),
    "a39_names_by_code": lambda s, d: trades.names_by_code(V.table(s, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey").select("o_custkey", F.array_join("names", "|").alias("names")),
    "a38_window_flows": lambda s, d: trades.window_flows(V.facts(s, d), 250),
    "o2_union_events": lambda s, d: trades.union_events([(V.table(s, d, "orders"), {"id": "o_orderkey", "amount": "o_totalprice", "status": "o_orderstatus"}), (V.table(s, d, "supplier"), {"id": "s_suppkey", "amount": "s_acctbal"})]),
    "o4_distinct_keys": lambda s, d: trades.distinct_keys(V.raw_trades(s, d), ["broker", "target"]),
    "o5_unprocessed_days": lambda s, d: trades.unprocessed_days(_calendar(s, d), _status(s, d)),
    "o7_expected_days": lambda s, d: trades.expected_days(_calendar(s, d), "1997-01-01", "1999-06-30"),
    "t4_reprocess_queue": lambda s, d: trades.reprocess_days(_calendar(s, d), _status(s, d), 30),
}


def _calendar(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()


def _status(s: SparkSession, d: str) -> DataFrame:
    days = _calendar(s, d).where("dayofmonth(day) <= 20")
    return days.withColumn("status", F.when(F.dayofmonth("day") % 7 == 0, "failed").when(F.dayofmonth("day") % 5 == 0, "empty").when(F.dayofmonth("day") % 3 == 0, "success"))


_CODED = "coded AS (SELECT o.*, c.code FROM outcomes o, (VALUES ('ALL'), ('A'), ('B'), ('C'), ('D'), ('E')) c(code) WHERE c.code = 'ALL' OR c.code = o.event)"
_CONDED = "conded AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS condition FROM coded WHERE {v}" for k, v in _SQL_CONDITIONS.items()) + ")"
_GRID = "grid AS (SELECT b.broker, c.condition, k.code FROM (SELECT DISTINCT broker FROM outcomes) b, (VALUES " + ", ".join(f"('{k}')" for k in CONDITIONS) + ") c(condition), (VALUES ('ALL'), ('A'), ('B'), ('C'), ('D'), ('E')) k(code))"
_COND_STATS = f"SELECT g.broker, g.condition, g.code, {V.SUMMARY} FROM grid g LEFT JOIN conded x ON g.broker = x.broker AND g.condition = x.condition AND g.code = x.code GROUP BY ALL"
_CAL = "calendar AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem), status AS (SELECT day, CASE WHEN day(day) % 7 = 0 THEN 'failed' WHEN day(day) % 5 = 0 THEN 'empty' WHEN day(day) % 3 = 0 THEN 'success' END AS status FROM calendar WHERE day(day) <= 20)"

ORACLE_SQL = {
    "flagship_branch_class_stats": f"WITH {V.OUTCOMES}, {_CODED} SELECT broker, code, {V.SUMMARY} FROM coded GROUP BY broker, code",
    "j3_keep_tracked": f"WITH {V.RAW} SELECT s_name AS label, count(*) AS n, sum(buy)::BIGINT AS buy FROM raw JOIN supplier ON broker = s_suppkey AND s_acctbal > 0 GROUP BY s_name",
    "p26_valid_trades": f"WITH {V.RAW} SELECT code % 10 <> 0 AND code % 7 <> 0 AS valid, count(*) AS n, sum(sell)::BIGINT AS sell FROM raw GROUP BY ALL",
    "p27_exclude_securities": "SELECT * FROM (SELECT lpad((p_partkey * 7919 % 99991 * 5)::VARCHAR, 6, '0') AS code, p_type, p_name FROM part) WHERE NOT starts_with(code, '00') AND NOT regexp_matches(p_type || ' ' || p_name, 'ECONOMY|BRASS')",
    "a1_compact_daily": f"WITH {V.FACTS} SELECT * EXCLUDE (target) FROM facts",
    "a2_representative_text": "SELECT p_brand, p_type FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, length(p_type), p_type) AS r FROM part GROUP BY p_brand, p_type) WHERE r = 1",
    "a3_build_events": f"WITH {V.EVENTS} SELECT * FROM events",
    "a4_sale_rows": f"WITH {V.FACTS} SELECT broker, code, day, sell_qty, sell_amt FROM facts WHERE sell_qty > 0",
    "p17_instrument_rows": "SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderkey::VARCHAR, '^\\d{5,6}$') AND NOT starts_with(o_orderkey::VARCHAR, '00')",
    "j6_fifo_match": f"WITH {V.ALLOCATIONS} SELECT * REPLACE (round_even(revenue, 6) AS revenue, round_even(cost, 6) AS cost) FROM allocations",
    "j6_resume_match": f"WITH {V.ALLOCATIONS} SELECT * REPLACE (round_even(revenue, 6) AS revenue, round_even(cost, 6) AS cost) FROM allocations",
    "w6_exit_days": f"WITH {V.OUTCOMES} SELECT * FROM exits",
    "a5_event_outcomes": f"WITH {V.OUTCOMES} SELECT * REPLACE (round_even(revenue, 4) AS revenue, round_even(sold_cost, 4) AS sold_cost) FROM outcomes",
    "a6_summarise_outcomes": f"WITH {V.OUTCOMES} SELECT broker, target, {V.SUMMARY} FROM outcomes GROUP BY broker, target",
    "a7_condition_stats": f"WITH {V.OUTCOMES}, {_CODED}, {_CONDED}, {_GRID} {_COND_STATS}",
    "a8_position_stats": f"WITH {V.OUTCOMES}, {_CODED}, pos AS (SELECT *, (net_qty > 20)::INT::VARCHAR || (qty > 40)::INT::VARCHAR || (amount > 75000)::INT::VARCHAR AS position FROM coded), grid AS (SELECT b.broker, p.position, k.code FROM (SELECT DISTINCT broker FROM outcomes) b, (VALUES " + ", ".join(f"('{p}')" for p in POSITIONS) + f") p(position), (VALUES ('ALL'), ('A'), ('B'), ('C'), ('D'), ('E')) k(code)) SELECT g.broker, g.position, g.code, {V.SUMMARY} FROM grid g LEFT JOIN pos x ON g.broker = x.broker AND g.position = x.position AND g.code = x.code GROUP BY ALL",
    "a9_branch_profiles": f"WITH {V.OUTCOMES}, {_CODED}, {_CONDED}, {_GRID}, cs AS ({_COND_STATS}), best AS (SELECT *, row_number() OVER (PARTITION BY broker ORDER BY win_rate DESC, n_resolved DESC, n_events DESC, condition) AS r FROM cs WHERE code = 'ALL' AND n_resolved >= 5) SELECT o.broker, o.n_events, o.profile_ret, b.condition AS best_condition, b.win_rate AS best_win_rate FROM (SELECT broker, count(*) AS n_events, floor(sum(floor(coalesce(ret, 0.0) * 100 + 0.5)::BIGINT * amount)::DOUBLE / nullif(sum(amount) FILTER (ret IS NOT NULL), 0)::DOUBLE / 100 * 1e4 + 0.5) / 1e4 AS profile_ret FROM outcomes GROUP BY broker) o LEFT JOIN best b ON o.broker = b.broker AND b.r = 1",
    "a10_integrity_report": f"WITH {V.FACTS}, reasons AS (SELECT o_orderpriority AS reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY o_orderpriority) SELECT 'rows' AS item, count(*)::BIGINT AS value FROM facts UNION ALL SELECT 'days', count(DISTINCT day) FROM facts UNION ALL SELECT 'brokers', count(DISTINCT broker) FROM facts UNION ALL SELECT 'missing days', count(*) FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders EXCEPT SELECT day FROM facts) UNION ALL SELECT * FROM (SELECT CASE WHEN r <= 3 THEN 'reason ' || reason ELSE 'reason other' END AS item, sum(n)::BIGINT AS value FROM reasons GROUP BY CASE WHEN r <= 3 THEN 'reason ' || reason ELSE 'reason other' END)",
    "a34_stock_master": "SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority DESC) AS r FROM orders) WHERE r = 1",
    "a39_names_by_code": "SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY k) AS names FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY o_custkey",
    "a38_window_flows": f"WITH {V.FACTS}, days AS (SELECT DISTINCT day FROM facts ORDER BY day DESC LIMIT 250) SELECT target, broker, sum(buy_amt)::BIGINT AS buy_amt, sum(sell_amt)::BIGINT AS sell_amt, sum(net_amt)::BIGINT AS net_amt, count(DISTINCT day) AS days FROM facts WHERE day IN (SELECT day FROM days) GROUP BY ALL",
    "o2_union_events": "SELECT o_orderkey AS id, o_totalprice AS amount, o_orderstatus AS status FROM orders UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier",
    "o4_distinct_keys": f"WITH {V.RAW} SELECT DISTINCT broker, target FROM raw",
    "o5_unprocessed_days": f"WITH {_CAL} SELECT day FROM calendar WHERE day NOT IN (SELECT day FROM status WHERE status IS NOT NULL)",
    "o7_expected_days": f"WITH {_CAL} SELECT day FROM calendar WHERE day BETWEEN DATE '1997-01-01' AND DATE '1999-06-30'",
    "t4_reprocess_queue": f"WITH {_CAL}, late AS (SELECT day FROM calendar ORDER BY day DESC LIMIT 30) SELECT * FROM (SELECT c.day, CASE WHEN s.status = 'failed' THEN 0 WHEN s.status IS NULL THEN 1 WHEN s.status = 'empty' AND l.day IS NOT NULL THEN 2 END AS priority FROM calendar c LEFT JOIN status s USING (day) LEFT JOIN late l USING (day)) WHERE priority IS NOT NULL",
}
