"""The given tables in the roles of the model: Spark frames, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fifo, trades
from ..sources.tables import lots_of, stored

#: Class bounds and the single-instrument threshold at the scale of the given amounts.
BOUNDS, MIN_SINGLE = (50_000, 60_000, 75_000, 90_000, 105_000), 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the trades, by their number, which the file's footers state."""
    rows = table(spark, sf_dir, "lineitem")
    return trades.parts_for(rows, rows.count())


def raw_trades(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """(broker, code, target, name, day, price, buy, sell), by code in ``parts`` partitions if that is given."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("target"), F.col("p_name").alias("name"))
    qty = F.col("l_quantity").cast("bigint")
    sold = F.col("l_returnflag") == "R"
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("broker"), F.col("l_partkey").alias("code"), F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.when(sold, 0).otherwise(qty).cast("bigint").alias("buy"), F.when(sold, qty).otherwise(0).cast("bigint").alias("sell")
    )
    return (rows.repartition(parts, "code") if parts else rows).join(part, "code")


RAW = """raw AS (
  SELECT l_suppkey AS broker, l_partkey AS code, p_brand AS target, p_name AS name, l_shipdate::DATE AS day, l_extendedprice / l_quantity AS price,
    CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::BIGINT END AS buy, CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT ELSE 0 END AS sell
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact fact with its target."""
    return trades.compact_daily(raw_trades(spark, sf_dir, parts(spark, sf_dir)), of_code=("target",))


FACTS = (
    RAW
    + """, facts AS (
  SELECT code, broker, day, any_value(target) AS target, max(name) AS name, sum(buy)::BIGINT AS buy_qty, sum(sell)::BIGINT AS sell_qty,
    sum(round_even(price * buy, 0)::BIGINT)::BIGINT AS buy_amt, sum(round_even(price * sell, 0)::BIGINT)::BIGINT AS sell_amt,
    (sum(buy) - sum(sell))::BIGINT AS net_qty, (sum(round_even(price * buy, 0)::BIGINT) - sum(round_even(price * sell, 0)::BIGINT))::BIGINT AS net_amt
  FROM raw GROUP BY code, broker, day)"""
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.build_events(facts(spark, sf_dir), MIN_SINGLE, BOUNDS, parts=parts(spark, sf_dir))


EVENTS = (
    FACTS
    + """, lots AS (SELECT broker, target, day, code, sum(buy_qty)::BIGINT AS qty, sum(buy_amt)::BIGINT AS amount, sum(net_qty)::BIGINT AS net FROM facts WHERE buy_qty > 0 GROUP BY ALL),
  events AS (
  SELECT broker, target, day, sum(amount)::BIGINT AS amount, sum(qty)::BIGINT AS qty, sum(net)::BIGINT AS net_qty, concat_ws('|', broker, target, day) AS event_id,
    CASE WHEN sum(amount) >= 105000 THEN 'E' WHEN sum(amount) >= 90000 THEN 'D' WHEN sum(amount) >= 75000 THEN 'C' WHEN sum(amount) >= 60000 THEN 'B' ELSE 'A' END AS event
  FROM lots GROUP BY broker, target, day HAVING max(amount) >= 50000)"""
)


def sales(of: DataFrame) -> DataFrame:
    """(broker, code, day, sell_qty, sell_amt)."""
    return of.where("sell_qty > 0").groupBy("broker", "code", "day").agg(F.sum("sell_qty").alias("sell_qty"), F.sum("sell_amt").alias("sell_amt"))


def matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(events with lots, allocations by branch and instrument), from one pass over the trades: facts and events are tables that the later steps read."""
    n = parts(spark, sf_dir)
    compact = stored(facts(spark, sf_dir).drop("name"), "facts")
    found = stored(trades.build_events(compact, MIN_SINGLE, BOUNDS, parts=n), "events")
    sold = compact.where("sell_qty > 0").select("broker", "code", "day", "sell_qty", "sell_amt")  # facts have a row per branch, instrument and day
    return found, fifo.fifo_match(lots_of(found), sold, ["broker", "code"], n)


def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir)[1]


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, sold = matched(spark, sf_dir)
    n = parts(spark, sf_dir)
    return stored(fifo.event_outcomes(found.drop("lots"), sold, n), "outcomes")


#: Brute first-in-first-out in SQL: every unit of stock and sale as intervals, matched by a running minimum.
ALLOCATIONS = (
    EVENTS
    + """, elots AS (SELECT l.broker, l.code, e.event_id, l.day AS event_day, l.code AS lot_no, l.qty, l.amount,
    sum(l.qty) OVER (PARTITION BY l.broker, l.code ORDER BY l.day, e.event_id ROWS UNBOUNDED PRECEDING) AS hi
    FROM lots l JOIN events e ON l.broker = e.broker AND l.target = e.target AND l.day = e.day),
  sales AS (SELECT broker, code, day, sum(sell_qty)::BIGINT AS sell_qty, sum(sell_amt)::BIGINT AS sell_amt FROM facts WHERE sell_qty > 0 GROUP BY ALL),
  avail AS (SELECT s.broker, s.code, s.day, s.sell_qty, s.sell_amt, coalesce((SELECT sum(l.qty) FROM elots l WHERE l.broker = s.broker AND l.code = s.code AND l.event_day < s.day), 0) AS a,
    sum(s.sell_qty) OVER (PARTITION BY s.broker, s.code ORDER BY s.day ROWS UNBOUNDED PRECEDING) AS s FROM sales s),
  m AS (SELECT *, s + least(0, min(a - s) OVER (PARTITION BY broker, code ORDER BY day ROWS UNBOUNDED PRECEDING)) AS hi2 FROM avail),
  m2 AS (SELECT *, coalesce(lag(hi2) OVER (PARTITION BY broker, code ORDER BY day), 0) AS lo2 FROM m),
  allocations AS (SELECT l.broker, l.code, l.event_id, l.lot_no, x.day AS sale_day, (least(x.hi2, l.hi) - greatest(x.lo2, l.hi - l.qty))::BIGINT AS qty,
    (least(x.hi2, l.hi) - greatest(x.lo2, l.hi - l.qty))::DOUBLE * x.sell_amt / x.sell_qty AS revenue, (least(x.hi2, l.hi) - greatest(x.lo2, l.hi - l.qty))::DOUBLE * l.amount / l.qty AS cost
    FROM elots l JOIN m2 x ON l.broker = x.broker AND l.code = x.code WHERE x.hi2 > x.lo2 AND x.hi2 > l.hi - l.qty AND x.lo2 < l.hi)"""
)

OUTCOMES = (
    ALLOCATIONS
    + """, daily AS (SELECT event_id, sale_day, sum(qty) AS q FROM allocations GROUP BY ALL),
  run AS (SELECT d.event_id, d.sale_day, sum(d.q) OVER (PARTITION BY d.event_id ORDER BY d.sale_day) AS done, e.qty AS orig FROM daily d JOIN events e USING (event_id)),
  exits AS (SELECT event_id, min(sale_day) AS first_reduce, min(CASE WHEN done >= orig THEN sale_day END) AS exit_day FROM run GROUP BY ALL),
  sums AS (SELECT event_id, sum(qty)::BIGINT AS sold, sum(revenue) AS revenue, sum(cost) AS sold_cost FROM allocations GROUP BY ALL),
  outcomes AS (SELECT e.broker, e.target, e.day, e.amount, e.qty, e.net_qty, e.event_id, e.event, coalesce(s.sold, 0)::BIGINT AS sold, coalesce(s.revenue, 0.0) AS revenue, coalesce(s.sold_cost, 0.0) AS sold_cost,
    x.first_reduce, x.exit_day, (e.qty - coalesce(s.sold, 0))::BIGINT AS remaining, CASE WHEN e.qty = coalesce(s.sold, 0) THEN 'closed' WHEN s.sold > 0 THEN 'reduced' ELSE 'open' END AS status,
    CASE WHEN s.sold_cost > 0 THEN round_even((s.revenue - s.sold_cost) / s.sold_cost * 100, 2) END AS ret, (coalesce(x.exit_day, x.first_reduce) - e.day)::INT AS hold_days
    FROM events e LEFT JOIN sums s USING (event_id) LEFT JOIN exits x USING (event_id))"""
)

#: What the summary aggregates are in SQL.
SUMMARY = """count(event_id) AS n_events, count(*) FILTER (status = 'closed') AS n_closed, count(*) FILTER (status = 'reduced') AS n_reduced, count(*) FILTER (status = 'open') AS n_open,
  count(ret) AS n_resolved, count(event_id) - count(ret) AS n_pending, count(*) FILTER (ret > 0) AS n_win, count(*) FILTER (ret < 0) AS n_loss, count(*) FILTER (ret = 0) AS n_tie,
  round_even(count(*) FILTER (ret > 0) * 100 / nullif(count(ret), 0), 2) AS win_rate, round_even(avg(hold_days) FILTER (ret IS NOT NULL), 2) AS mean_hold, median(hold_days) FILTER (ret IS NOT NULL) AS median_hold,
  floor(sum(floor(ret * 100 + 0.5)::BIGINT)::DOUBLE / nullif(count(ret), 0) / 100 * 1e4 + 0.5) / 1e4 AS mean_ret, round_even(median(ret), 4) AS median_ret, floor(sum(amount * floor(ret * 100 + 0.5)::BIGINT)::DOUBLE / nullif(sum(amount) FILTER (ret IS NOT NULL), 0)::DOUBLE / 100 * 1e4 + 0.5) / 1e4 AS weighted_ret,
  max(ret) AS max_ret, min(ret) AS min_ret, sum(amount)::BIGINT AS amount, min(day) AS first_day, max(day) AS last_day,
  CASE WHEN count(ret) < 15 THEN 'tiny' WHEN count(ret) < 30 THEN 'small' WHEN count(ret) < 60 THEN 'fair' ELSE 'solid' END AS grade"""
