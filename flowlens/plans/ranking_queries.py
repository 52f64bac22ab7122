"""Published rankings, the day's sells, integrity counts and checkpoints in full, on rows whose figures are partly missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity, report, stats
from ..sources import tables as T
from . import flow_queries as Q
from . import rule_queries as R
from . import views as V

YEAR = "1999-01-01"


def _ranking(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return V.table(s, d, "orders").select(
        F.col("o_custkey").alias("target"), F.when(F.col("o_orderstatus") == "F", "buy").otherwise("sell").alias("kind"), F.when(k % 5000 != 7, k % 40 + 1).alias("rank"), F.when(k % 3 == 0, 0).when(k % 3 == 1, F.floor(F.col("o_totalprice") / 10)).alias("rank_amt"),
        F.floor("o_totalprice").alias("buy_amt"), F.when(k % 7 > 0, F.col("o_custkey") * 100).alias("sell_amt"), F.when(k % 4 == 0, 5000).alias("net_buy"), F.when(k % 5 == 0, 6000).alias("net_sell"), (k % 5).alias("n_same"), (k % 2 * 3).alias("n_brokers"),
    )


def _month(s: SparkSession, d: str, ranked: bool) -> DataFrame:
    part, price, size = V.table(s, d, "part"), F.floor("p_retailprice"), F.col("p_size")
    rank = F.when(size % 6 > 0, F.col("p_partkey") % 300 + 1) if ranked else F.lit(None).cast("bigint")
    rows = part.select(F.col("p_partkey").alias("target"), rank.alias("rank"), F.when(size % 3 == 1, -5).when(size % 3 == 2, price * 10).alias("net_cost"), F.when(size % 4 > 0, price * 20).otherwise(0).alias("cost"))
    again = rows.where("target % 5 = 0").withColumns({"rank": F.col("rank") + 1000, "cost": F.col("cost") + 1})
    detail = V.table(s, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("broker"), F.floor("l_extendedprice").alias("amount"))
    return report.month_ranking(rows.unionByName(again), detail).withColumn("form", F.lit("ranked" if ranked else "plain"))


def _admitted(s: SparkSession, d: str) -> DataFrame:
    c = F.col("code")
    facts = V.stored(V.facts(s, d), "facts")
    sold = facts.where("sell_qty > 0").groupBy(F.trunc("day", "year").alias("day"), "broker", "code", "target").agg(F.sum("sell_amt").alias("amount"), F.sum("sell_qty").alias("sold"))
    sells = sold.select("day", "broker", "code", F.when(c % 10 > 0, F.col("target")).alias("target"), F.concat(F.lit("n"), (c % 9).cast("string")).alias("name"), F.lit("sold").alias("status"), F.when(c % 6 == 0, "A").when(c % 6 == 1, "").alias("event"), "amount", F.when(c % 3 > 0, F.col("sold")).otherwise(0).alias("qty"), (F.col("sold") * 1500).alias("shares"), F.when(c % 4 > 0, (c % 50 + 1).cast("double")).alias("price"), F.when(c % 5 == 0, (c % 30 - 15).cast("double")).alias("ret"), F.when(c % 7 == 0, F.col("amount") - 50).alias("cost"))
    lookup = facts.where("buy_qty > 0 and code % 2 = 0").groupBy("broker", "code").agg(F.when(c % 4 == 0, "B").otherwise("x").alias("event"), F.min("target").alias("target"), F.when(c % 8 == 0, 2.5).alias("ret"), F.sum("buy_amt").alias("cost"), F.when(c % 3 > 0, (c % 20 + 1).cast("double")).alias("buy_avg"))
    return report.admitted_sells(sells, lookup, YEAR, 60_000)


def _integrity(s: SparkSession, d: str) -> DataFrame:
    n = F.dayofmonth("day")
    status = Q._status(s, d).select("day", "status", (n * 100).alias("raw_rows"), (n * 10).alias("compact_rows"), (n * 9).alias("unique_rows"), F.when(n > 3, n % 4).alias("invalid_rows"))
    b = F.col("broker")
    events = R.recognised(s, d).withColumns({"ma_status": F.when(b % 3 == 0, "OK").otherwise("Missing"), "reason": F.when(b % 5 > 0, F.concat(F.lit("r"), (b % 13).cast("string"), F.lit("："), b.cast("string"))).when(b % 2 == 0, " ")})
    return stats.integrity_counts(status, Q._calendar(s, d), events)


def _targets(s: SparkSession, d: str) -> DataFrame:
    k, nation = F.col("c_custkey"), V.table(s, d, "nation").select("n_nationkey", "n_name")
    rows = V.table(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return identity.resolve_targets(rows.select("c_custkey", F.when(k % 2 == 0, F.col("n_nationkey").cast("string")).alias("code"), F.when(k % 3 > 0, F.col("n_name")).alias("name")), nation.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name")))


def _checkpoint(s: SparkSession, d: str) -> DataFrame:
    path = T.shared_path(s, "checkpoint")
    events, sales = V.matched(s, d)
    T.write_checkpoint(events.withColumn("lots", F.transform("lots", lambda x: F.struct(x["code"].alias("code"), x["qty"].alias("qty"), F.when(x["code"] % 2 == 0, x["qty"]).otherwise(0).alias("remaining")))), path, sales)
    return s.read.parquet(path).select("event_id", F.size("lots").alias("n_lots"), F.size("open_lots").alias("n_open"), F.size("allocations").alias("n_sales"), F.aggregate("allocations", F.lit(0).cast("bigint"), lambda a, x: a + x["qty"]).alias("sold"))


QUERIES = {
    "a37_stated_ranking": lambda s, d: report.stated_ranking(_ranking(s, d), "buy").unionByName(report.stated_ranking(_ranking(s, d), "sell")),
    "a41_month_ranking": lambda s, d: _month(s, d, True).unionByName(_month(s, d, False)),
    "a44_admitted_sells": _admitted,
    "a44_shown_sells": lambda s, d: report.shown_sells(_admitted(s, d), 60_000),
    "a10_integrity_counts": _integrity,
    "p30_resolve_targets_full": _targets,
    "s3_write_checkpoint_full": _checkpoint,
}

_RANKED = """SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY rank, rank_amt DESC, buy_amt DESC, sell_amt DESC, net_buy DESC, net_sell DESC, n_same DESC, n_brokers DESC) AS r FROM filled WHERE kind = '{0}') WHERE r = 1 ORDER BY rank, rank_amt DESC, target LIMIT 15"""
_MONTH = """SELECT * EXCLUDE (r), '{1}' AS form FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {0}) AS r FROM (SELECT target, {2} AS rank, net_cost, cost, n_brokers, top_broker FROM m)) WHERE r = 1 ORDER BY {0}, target LIMIT 15"""
_ADMITTED = f"""{V.FACTS}, sold AS (SELECT date_trunc('year', day)::DATE AS day, broker, code, target, sum(sell_amt)::BIGINT AS amount, sum(sell_qty)::BIGINT AS sold FROM facts WHERE sell_qty > 0 GROUP BY ALL),
  look AS (SELECT broker, code, CASE WHEN code % 4 = 0 THEN 'B' ELSE 'x' END AS event, min(target) AS target, CASE WHEN code % 8 = 0 THEN 2.5::DOUBLE END AS ret, sum(buy_amt)::BIGINT AS cost, CASE WHEN code % 3 > 0 THEN (code % 20 + 1)::DOUBLE END AS buy_avg FROM facts WHERE buy_qty > 0 AND code % 2 = 0 GROUP BY broker, code),
  x AS (SELECT s.day, s.broker, s.code, coalesce(CASE WHEN s.code % 10 > 0 THEN s.target END, l.target) AS target, 'n' || (s.code % 9) AS name, 'sold' AS status, s.amount, CASE WHEN s.code % 3 > 0 THEN s.sold ELSE s.sold * 1500 // 1000 END AS qty, l.event IS NOT NULL AS known, CASE WHEN s.code % 6 = 0 THEN 'A' WHEN l.event = 'B' THEN 'B' ELSE 'single' END AS ev, CASE WHEN s.code % 5 = 0 THEN (s.code % 30 - 15)::DOUBLE END AS ret0, l.ret AS ret1, CASE WHEN s.code % 7 = 0 THEN s.amount - 50 END AS cost0, l.cost AS cost1, l.buy_avg, CASE WHEN s.code % 4 > 0 THEN (s.code % 50 + 1)::DOUBLE END AS price
    FROM sold s LEFT JOIN look l ON l.broker = s.broker AND l.code = s.code WHERE s.day = DATE '{YEAR}' AND s.amount > 0),
  y AS (SELECT *, sum(amount) FILTER (NOT known) OVER (PARTITION BY broker, target) AS together, known AND buy_avg > 0 AND qty > 0 AND NOT coalesce(cost0 > 0, false) AS by_lots FROM x),
  admitted AS (SELECT day, broker, code, target, name, status, amount, qty::BIGINT AS qty, CASE WHEN known THEN ev ELSE 'single' END AS event, coalesce(ret0, ret1, CASE WHEN by_lots AND price > 0 THEN floor((price - buy_avg) / buy_avg * 100 * 1e4 + 0.5) / 1e4 END) AS ret, CASE WHEN cost0 > 0 THEN cost0 WHEN by_lots THEN (buy_avg * qty * 1000)::BIGINT WHEN cost1 > 0 THEN cost1 END::BIGINT AS cost FROM y WHERE known OR (target IS NOT NULL AND together >= 60000))"""

ORACLE_SQL = {
    "a37_stated_ranking": f"WITH r AS (SELECT o_custkey AS target, CASE WHEN o_orderstatus = 'F' THEN 'buy' ELSE 'sell' END AS kind, CASE WHEN o_orderkey % 5000 <> 7 THEN o_orderkey % 40 + 1 ELSE 0 END AS rank, CASE WHEN o_orderkey % 3 = 1 THEN floor(o_totalprice / 10)::BIGINT END AS stated, floor(o_totalprice)::BIGINT AS buy_amt, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey * 100 ELSE 0 END AS sell_amt, CASE WHEN o_orderkey % 4 = 0 THEN 5000 END AS nb, CASE WHEN o_orderkey % 5 = 0 THEN 6000 END AS ns, o_orderkey % 5 AS n_same, CASE WHEN o_orderkey % 2 = 1 THEN 3 ELSE o_orderkey % 5 END AS n_brokers FROM orders), nets AS (SELECT *, coalesce(nb, buy_amt - sell_amt) AS net_buy, coalesce(ns, sell_amt - buy_amt) AS net_sell FROM r), filled AS (SELECT target, kind, rank, coalesce(nullif(stated, 0), CASE kind WHEN 'buy' THEN net_buy ELSE net_sell END) AS rank_amt, buy_amt, sell_amt, net_buy, net_sell, n_same, n_brokers FROM nets) SELECT * FROM ({_RANKED.format('buy')}) UNION ALL SELECT * FROM ({_RANKED.format('sell')})",
    "a41_month_ranking": "WITH q AS (SELECT p_partkey AS target, CASE WHEN p_size % 6 > 0 THEN p_partkey % 300 + 1 END AS rank, CASE WHEN p_size % 3 = 2 THEN floor(p_retailprice)::BIGINT * 10 END AS net, CASE WHEN p_size % 4 > 0 THEN floor(p_retailprice)::BIGINT * 20 ELSE 0 END AS cost FROM part), rows2 AS (SELECT * FROM q UNION ALL SELECT target, rank + 1000, net, cost + 1 FROM q WHERE target % 5 = 0), b AS (SELECT l_partkey AS target, l_suppkey AS broker, sum(floor(l_extendedprice)::BIGINT) AS amount FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL), d AS (SELECT target, sum(amount) AS detail, count(*) AS n, arg_max(broker, amount * 1000000000 - broker) AS top_broker FROM b GROUP BY target), m0 AS (SELECT r.target, coalesce(rank, 0) AS rank, coalesce(net, detail)::BIGINT AS net_cost, cost, coalesce(n, 0) AS n_brokers, top_broker FROM rows2 r LEFT JOIN d USING (target)), m AS (SELECT * REPLACE (CASE WHEN cost > 0 THEN cost ELSE net_cost END AS cost) FROM m0 WHERE net_cost > 0)"
    + f" SELECT * FROM ({_MONTH.format('rank, net_cost DESC, cost DESC', 'ranked', 'rank')}) UNION ALL SELECT * FROM ({_MONTH.format('net_cost DESC, cost DESC', 'plain', '0')})",
    "a44_admitted_sells": f"WITH {_ADMITTED} SELECT * FROM admitted",
    "a44_shown_sells": f"WITH {_ADMITTED}, imp AS (SELECT *, CASE WHEN ret > -95 THEN floor(amount::DOUBLE / (1 + ret / 100) + 0.5)::BIGINT END AS implied FROM admitted), z AS (SELECT broker, status, target, sum(amount)::BIGINT AS amount, sum(cost) AS c, sum(amount) FILTER (cost IS NOT NULL) AS a, sum(implied) AS ic, sum(amount) FILTER (implied IS NOT NULL) AS ia, string_agg(DISTINCT name, '、' ORDER BY name) AS items FROM imp GROUP BY ALL) SELECT broker, status, target, amount, items, floor(CASE WHEN c > 0 THEN (a - c)::DOUBLE / c::DOUBLE * 100 WHEN ic > 0 THEN (ia - ic)::DOUBLE / ic::DOUBLE * 100 END * 100 + 0.5) / 100 AS ret FROM z WHERE amount >= 30000",
    "a10_integrity_counts": f"""WITH {V.OUTCOMES}, {R._REC}, {Q._CAL}, days AS (SELECT day, status, CASE WHEN day(day) <= 20 THEN day(day) END AS n FROM calendar LEFT JOIN status USING (day)),
      e AS (SELECT *, CASE WHEN broker % 3 = 0 THEN 'OK' ELSE 'Missing' END AS ma_status, CASE WHEN broker % 5 > 0 THEN 'r' || (broker % 13) ELSE 'no reason' END AS reason FROM rec),
      why AS (SELECT reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, reason) AS r FROM e WHERE ma_status = 'Missing' GROUP BY reason)
      SELECT unnest(['expected days', 'success days', 'failed days', 'empty days', 'unprocessed days', 'complete', 'first day', 'last day', 'raw rows', 'compact rows', 'unique rows', 'invalid rows']) AS item, unnest([count(*)::VARCHAR, count(*) FILTER (status = 'success')::VARCHAR, count(*) FILTER (status = 'failed')::VARCHAR, count(*) FILTER (status = 'empty')::VARCHAR, count(*) FILTER (status IS NULL)::VARCHAR, (count(*) FILTER (status = 'failed' OR status IS NULL) = 0)::VARCHAR, (min(day) FILTER (status = 'success'))::VARCHAR, (max(day) FILTER (status = 'success'))::VARCHAR, sum(n * 100)::BIGINT::VARCHAR, sum(n * 10)::BIGINT::VARCHAR, sum(n * 9)::BIGINT::VARCHAR, (sum(n % 4) FILTER (n > 3))::BIGINT::VARCHAR]) AS value FROM days
      UNION ALL SELECT unnest(['events', 'states complete', 'states missing', 'closed', 'not closed', 'resolved', 'pending', 'market', 'settled', 'first event', 'last event']), unnest([count(*)::VARCHAR, count(*) FILTER (ma_status = 'OK')::VARCHAR, count(*) FILTER (ma_status = 'Missing')::VARCHAR, count(*) FILTER (status = 'closed')::VARCHAR, count(*) FILTER (status <> 'closed')::VARCHAR, count(*) FILTER (recog_status <> 'pending')::VARCHAR, count(*) FILTER (recog_status = 'pending')::VARCHAR, count(*) FILTER (recog_status = 'market')::VARCHAR, count(*) FILTER (recog_status IN ('settled', 'lapsed'))::VARCHAR, min(day)::VARCHAR, max(day)::VARCHAR]) FROM e
      UNION ALL SELECT CASE WHEN r <= 10 THEN 'reason ' || reason ELSE 'reason other' END, sum(n)::BIGINT::VARCHAR FROM why GROUP BY 1 UNION ALL SELECT 'events of ' || broker, count(*)::VARCHAR FROM e GROUP BY broker""",
    "p30_resolve_targets_full": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 > 0 THEN n_nationkey::VARCHAR END AS code, CASE WHEN c_custkey % 3 > 0 OR c_custkey % 2 = 0 THEN n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "s3_write_checkpoint_full": f"WITH {V.ALLOCATIONS}, a AS (SELECT event_id, count(*) AS n, sum(qty)::BIGINT AS q FROM allocations GROUP BY event_id) SELECT e.event_id, (SELECT count(*) FROM elots l WHERE l.event_id = e.event_id) AS n_lots, (SELECT count(*) FROM elots l WHERE l.event_id = e.event_id AND l.lot_no % 2 = 0) AS n_open, coalesce(a.n, 0) AS n_sales, coalesce(a.q, 0)::BIGINT AS sold FROM events e LEFT JOIN a USING (event_id)",
}
