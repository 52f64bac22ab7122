"""Queries of the report, spot and monitor operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monitor, report, spot
from . import views as V

DAY = "2000-06-30"


def sells(s: SparkSession, d: str) -> DataFrame:
    return V.facts(s, d).where("sell_qty > 0").select("broker", "target", "code", "day", "sell_amt", "sell_qty")


def feed(s: SparkSession, d: str) -> DataFrame:
    rows = V.table(s, d, "lineitem").select(F.col("l_suppkey").alias("broker"), (F.col("l_partkey") % 40).alias("stock"), F.to_date("l_shipdate").alias("day"), F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_quantity") * 1000).cast("bigint").alias("buy_shares"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 1000).otherwise(0).cast("bigint").alias("sell_shares"))
    month = rows.groupBy("stock", F.trunc("day", "month").alias("day"), "broker").agg(F.sum("buy_shares").alias("buy_shares"), F.sum("sell_shares").alias("sell_shares"))
    return spot.ordered_feed(month.withColumns({"net": F.col("buy_shares") - F.col("sell_shares"), "close": (F.col("stock") + 10).cast("double"), "volume": F.lit(1_000_000)})).where("pos < 30")


_FEED = "f0 AS (SELECT l_partkey % 40 AS stock, date_trunc('month', l_shipdate)::DATE AS day, l_suppkey AS broker, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity * 1000 END)::BIGINT AS buy_shares, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity * 1000 ELSE 0 END)::BIGINT AS sell_shares FROM lineitem GROUP BY ALL), f1 AS (SELECT *, (stock + 10)::DOUBLE AS close, row_number() OVER (PARTITION BY stock, day ORDER BY buy_shares - sell_shares DESC, broker) - 1 AS pos FROM f0), feed AS (SELECT stock, day, broker, CASE WHEN pos < 15 THEN 'buy' ELSE 'sell' END AS list, (CASE WHEN pos < 15 THEN pos + 1 ELSE pos - 14 END)::INT AS list_rank, (buy_shares - sell_shares) / 1000 AS net_lots, buy_shares * close AS buy_amt, sell_shares * close AS sell_amt, (buy_shares - sell_shares) * close AS net_amt, floor(abs(buy_shares - sell_shares) / 1000000::DOUBLE * 100 * 1e4 + 0.5) / 1e4 AS turnover, CASE WHEN buy_shares > sell_shares THEN 'buy' WHEN buy_shares < sell_shares THEN 'sell' ELSE 'flat' END AS side FROM f1 WHERE pos < 30)"


def top_feed(s: SparkSession, d: str) -> DataFrame:
    return spot.project_top(feed(s, d))


def probes(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("mark"), (F.col("event_type") == "error").alias("failed"), "value")


def probe_log(s: SparkSession, d: str) -> DataFrame:
    e = V.table(s, d, "events")
    return e.select(F.col("event_id").alias("probe_id"), F.col("ts").alias("probe_time"), F.to_date("ts").alias("target_date"), (F.col("event_type") == "error").cast("int").alias("failed"), (F.col("value") > 3).alias("is_complete"), F.floor(F.col("value") * 100).cast("bigint").alias("raw_rows"))


_LOG = "log AS (SELECT event_id AS probe_id, ts AS probe_time, ts::DATE AS target_date, (event_type = 'error')::INT AS failed, value > 3 AS is_complete, floor(value * 100)::BIGINT AS raw_rows FROM events), last AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY target_date ORDER BY probe_time DESC, probe_id DESC) AS r FROM log) WHERE r = 1)"


def detail(s: SparkSession, d: str) -> DataFrame:
    """Open-position detail: cost, P&L and what of it can be estimated."""
    return V.facts(s, d).where("buy_amt > 0").select("target", "broker", "code", F.col("buy_amt").alias("cost"), F.when(F.col("code") % 3 > 0, F.col("net_qty") * 100).alias("pnl"), F.when(F.col("code") % 3 > 0, F.col("buy_amt")).alias("estimable"))


def window_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows with copies among them, returns and instrument lists."""
    rows = V.facts(s, d).select("broker", "target", "day", "buy_amt", "sell_amt", ((F.col("code") % 41) - 20).cast("double").alias("ret"), F.concat_ws("、", (F.col("code") % 7).cast("string"), (F.col("code") % 5).cast("string")).alias("items"))
    return rows.union(rows.where("day < '1997-01-01'"))


_WROWS = "wrows AS (SELECT broker, target, day, buy_amt, sell_amt, (code % 41 - 20)::DOUBLE AS ret, (code % 7) || '、' || (code % 5) AS items FROM facts)"


def snapshots(s: SparkSession, d: str) -> DataFrame:
    o = V.table(s, d, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("updated"), F.when(F.col("o_orderkey") % 5 == 0, "draft").otherwise(F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lit("01_120000"))).alias("run_id"), F.to_date("o_orderdate").alias("stat_date"), F.col("o_orderpriority").alias("scope"), F.col("o_totalprice").alias("amount"))


_SNAP = "snap AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS updated, CASE WHEN o_orderkey % 5 = 0 THEN 'draft' ELSE strftime(o_orderdate, '%Y%m') || '01_120000' END AS run_id, o_orderdate::DATE AS stat_date, o_orderpriority AS scope, o_totalprice AS amount FROM orders)"


def _lookup(s: SparkSession, d: str) -> DataFrame:
    return report.sell_event_by_priority(V.events(s, d).drop("lots"), ["broker", "target"])


def _cons(s: SparkSession, d: str) -> DataFrame:
    return report.consensus_map(V.facts(s, d))


def _sell_actions(s: SparkSession, d: str) -> DataFrame:
    return sells(s, d).select("broker", "target", F.col("sell_amt").alias("amount"), F.when(F.col("code") % 2 == 0, F.col("sell_amt") - 100).alias("cost"), ((F.col("code") % 150) - 100).cast("double").alias("ret"), (F.col("code") % 9).cast("string").alias("item"), F.lit("plain").alias("status"))


_NET = "net AS (SELECT target, broker, sum(net_amt)::BIGINT AS net FROM facts GROUP BY ALL), cons AS (SELECT target, count(*) FILTER (net > 0) AS n_buy, count(*) FILTER (net < 0) AS n_sell, coalesce(sum(net) FILTER (net > 0), 0)::BIGINT AS buy_amt, coalesce(-sum(net) FILTER (net < 0), 0)::BIGINT AS sell_amt FROM net GROUP BY target)"
_LOOK = "look AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY broker, target ORDER BY event, day DESC, event_id DESC) AS r FROM events WHERE event <> 'E') WHERE r = 1)"
_W = "sum(buy_amt * floor(ret * 100 + 0.5)::BIGINT)::DOUBLE / nullif(sum(buy_amt) FILTER (ret IS NOT NULL), 0)::DOUBLE / 100"
_STATS = "stats0 AS (SELECT s_nationkey AS broker, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'total' END AS kind, s_suppkey % 3 AS priority, CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS win_rate, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey::DOUBLE END AS hold, s_suppkey AS n FROM supplier)"


def _stats(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return V.table(s, d, "supplier").select(F.col("s_nationkey").alias("broker"), F.when(k % 2 == 0, "A").otherwise("total").alias("kind"), (k % 3).alias("priority"), F.when(k % 4 > 0, F.col("s_acctbal")).alias("win_rate"), F.when(k % 5 > 0, k.cast("double")).alias("hold"), k.alias("n"))


def _stats_module():
    from ..operators import stats

    return stats


QUERIES = {
    "j8_sell_event_by_priority": _lookup,
    "j8_sell_event_by_date": lambda s, d: report.sell_event_by_date(V.events(s, d).drop("lots"), ["broker", "target"]),
    "j9_not_shown": lambda s, d: report.not_shown(V.events(s, d).drop("lots"), V.events(s, d).where("event = 'E' and broker % 3 = 0")).select("event_id"),
    "j10_qualifying_plain_sells": lambda s, d: report.qualifying_plain_sells(sells(s, d), _lookup(s, d).where("broker % 2 = 0"), ["broker", "target"], 60_000),
    "j16_coalesce_detail": lambda s, d: report.coalesce_detail(V.table(s, d, "part").select("p_partkey"), "p_partkey", V.table(s, d, "part").where("p_size % 2 = 0").select("p_partkey", F.array("p_type").alias("items")), V.table(s, d, "part").where("p_size % 3 = 0").select("p_partkey", F.array("p_brand").alias("items"))).select("p_partkey", F.array_join("items", "|").alias("items")),
    "a20_position_rollup": lambda s, d: report.position_rollup(detail(s, d)),
    "a21_merge_broker_detail": lambda s, d: report.merge_broker_detail(V.facts(s, d).select("target", F.when(F.col("broker") % 2 == 0, F.col("broker").cast("string")).otherwise("").alias("code"), F.concat(F.lit("b"), (F.col("broker") % 4).cast("string")).alias("name"), F.col("buy_amt").alias("amount"), (F.col("broker") % 7).cast("double").alias("ret"))),
    "a22_compress_buys": lambda s, d: report.compress_buys(V.events(s, d).select("broker", F.lit("new").alias("status"), "event", "target", "amount", "qty", F.dayofmonth("day").cast("string").alias("item"))),
    "a22_compress_sells": lambda s, d: report.compress_sells(_sell_actions(s, d)),
    "a23_daily_kpi": lambda s, d: report.daily_kpi(V.events(s, d).where("year(day) = 1999"), sells(s, d).where("day = '1999-06-15'").withColumnRenamed("sell_amt", "amount"), V.table(s, d, "supplier").select(F.col("s_suppkey").alias("broker"))),
    "a24_actual_daily_net": lambda s, d: report.actual_daily_net(V.facts(s, d), "1999-06-15", V.table(s, d, "supplier").select(F.col("s_suppkey").alias("broker"))),
    "a25_add_count": lambda s, d: report.add_count(V.outcomes(s, d), DAY, 50, 55_000),
    "a26_mean_hold_days": lambda s, d: report.mean_hold_days(V.outcomes(s, d), V.table(s, d, "supplier").select(F.col("s_suppkey").alias("broker"))),
    "a27_merge_window_detail": lambda s, d: report.merge_window_detail(window_rows(s, d)),
    "a28_consensus_map": _cons,
    "a29_consensus_signal": lambda s, d: report.consensus_signal(_cons(s, d), "buy").unionByName(report.consensus_signal(_cons(s, d), "sell")),
    "a30_branch_window_meta": lambda s, d: report.branch_window_meta(window_rows(s, d).dropDuplicates().withColumn("stated_ret", F.when(F.col("broker") % 4 == 0, 1.5))),
    "a31_win_rate_table": lambda s, d: _stats_module().win_rate_table(_stats(s, d), "broker"),
    "a42_history_stats": lambda s, d: _stats_module().history_stats(_stats_module().win_rate_table(_stats(s, d), "broker").select("broker", F.lit("total").alias("kind"), F.col("total_n").alias("n"), F.col("total_win_rate").alias("win_rate"), F.col("total_hold").alias("hold")).where("n is not null"), V.table(s, d, "nation").select(F.col("n_nationkey").alias("broker")), "broker"),
    "a35_card_summary": lambda s, d: _stats_module().card_summary(report.top_n(V.outcomes(s, d).where("ret is not null"), [], [F.desc("amount"), F.col("event_id")], 10), "amount", "ret"),
    "a36_latest_day": lambda s, d: report.latest_day((V.table(s, d, "orders").withColumn("x", F.to_date("o_orderdate")), "x"), (V.facts(s, d), "day")),
    "a37_consensus_ranking": lambda s, d: report.consensus_ranking(V.facts(s, d), 21, DAY, 15),
    "a40_position_cache": lambda s, d: report.position_cache(snapshots(s, d).select(F.col("scope").alias("target"), (F.col("o_orderkey") % 10).alias("broker"), "stat_date", F.col("o_orderkey").alias("updated"), F.when(F.col("o_orderkey") % 2 == 0, F.col("amount")).alias("cost"), (F.col("amount") - 90000).alias("estimable"), F.lit(0.0).alias("unpriced")).withColumn("stat_date", F.trunc("stat_date", "year")), DAY),
    "a41_month_consensus": lambda s, d: report.month_consensus(V.facts(s, d).groupBy("target").agg(F.when(F.max("code") % 2 == 0, F.sum("net_amt")).alias("net_cost")), detail(s, d)),
    "a43_daily_buys": lambda s, d: report.daily_buys(V.events(s, d).drop("lots"), "1999-06-15", 52_000, report.add_count(V.outcomes(s, d), "1999-06-15", 50, 55_000)),
    "a44_daily_sells": lambda s, d: report.daily_sells(sells(s, d), _lookup(s, d).where("broker % 2 = 0"), "1999-06-15", 60_000),
    "w7_wavg_cost_by_instrument": lambda s, d: report.wavg_cost_returns(V.facts(s, d), ["broker", "code"]).withColumns({c: F.bround(F.col(c) + 1e-7, 4) for c in ("cost", "ret")}),  # past the ties of round amounts
    "w7_wavg_cost_returns": lambda s, d: report.wavg_cost_returns(V.facts(s, d).groupBy("broker", "target", "day").agg(*(F.sum(c).alias(c) for c in ("buy_qty", "buy_amt", "sell_qty", "sell_amt"))), ["broker", "target"], 100_000).withColumns({c: F.bround(c, 4) for c in ("cost", "ret")}),  # in one slice: the last bits of its running doubles are those of its SQL
    "w8_latest_snapshot": lambda s, d: report.latest_snapshot(snapshots(s, d)),
    "w8_latest_snapshot_run_id": lambda s, d: report.latest_snapshot(snapshots(s, d), by_run_id=True),
    "w9_asof_stat_date": lambda s, d: report.asof_stat_date(snapshots(s, d), "1999-06-15"),
    "w10_top_n": lambda s, d: report.top_n(V.facts(s, d).select("broker", "target", "code", "day", "net_amt"), ["target"], [F.desc("net_amt"), F.col("broker"), F.col("code"), F.col("day")], 5),
    "w11_rank_dedupe": lambda s, d: report.rank_dedupe(V.events(s, d).select("broker", "target", "event_id", "amount", F.dayofmonth("day").alias("rank"))).select("target", "rank", "amount"),
    "w12_dedupe_daily_sells": lambda s, d: report.dedupe_daily_sells(V.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), (F.col("l_suppkey") % 5).alias("broker"), (F.col("l_partkey") % 20).alias("code"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("ret"), F.col("l_tax").alias("cost"), F.when(F.col("l_linenumber") > 1, F.col("l_linestatus")).alias("name"), F.when(F.col("l_linenumber") == 2, "A").otherwise("").alias("event"))),
    "w13_dedupe_buys": lambda s, d: report.dedupe_buys(V.table(s, d, "lineitem"), ["l_suppkey", "l_returnflag", "l_discount", "l_tax"]),
    "w16_recent_days": lambda s, d: report.recent_days(V.events(s, d), DAY, 50),
    "w18_supplement_events": lambda s, d: report.supplement_events(V.events(s, d).where("event_id = '1|Brand#1|1995-01-01' or (event = 'E' and broker = 1 and year(day) = 1995 and month(day) = 1)"), V.events(s, d).drop("lots")),
    "w19_order_by_list": lambda s, d: report.order_by_list(V.table(s, d, "part").select((F.col("p_size") % 6).alias("broker"), F.col("p_retailprice").alias("amount"), F.col("p_partkey").cast("string").alias("code")), [3, 1, 5]),
    "p31_scope_filter": lambda s, d: report.scope_filter(snapshots(s, d), "1-URGENT"),
    "p32_selected_scope": lambda s, d: report.selected_scope(snapshots(s, d), "^9-NONE", "5-LOW"),
    "p11_first_value": lambda s, d: _first_value(s, d),
    "p37_mask_view": lambda s, d: _mask(s, d),
    "s14_project_top": top_feed,
    "s11_upsert_last": lambda s, d: spot.upsert_last(V.table(s, d, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("v"), "o_totalprice"), V.table(s, d, "orders").where("o_orderkey % 2 = 0").select("o_custkey", "o_orderpriority", (F.col("o_orderkey") + 1_000_000_000).alias("v"), (F.col("o_totalprice") + 1).alias("o_totalprice")), ["o_custkey", "o_orderpriority"], "v"),
    "o1_rankings": lambda s, d: _rankings(s, d),
    "a16_branch_summary": lambda s, d: spot.branch_summary(top_feed(s, d), ["net_lots", "buy_amt", "sell_amt", "net_amt"]),
    "a17_tracked_stock_top": lambda s, d: spot.tracked_stock_top(top_feed(s, d).where("broker % 2 = 0"), 20),
    "a18_branch_stock_top": lambda s, d: spot.branch_stock_top(top_feed(s, d), 5),
    "a19_market_stock_buy_top": lambda s, d: spot.market_stock_buy_top(top_feed(s, d), 20),
    "a46_run_info": lambda s, d: spot.run_info(top_feed(s, d).where("broker % 2 = 0"), top_feed(s, d)),
    "a47_unique_text": lambda s, d: V.table(s, d, "orders").groupBy("o_custkey").agg(spot.unique_text("o_orderstatus", "o_orderkey").alias("texts"), spot.first_text("o_orderpriority", "o_orderkey").alias("first")),
    "a11_probe_metrics": lambda s, d: monitor.probe_metrics(V.raw_trades(s, d)),
    "a12_sha_fingerprint": lambda s, d: monitor.sha_fingerprint(V.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"], ["l_suppkey"]),
    "a12_fingerprint": lambda s, d: monitor.fingerprint(V.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"], ["l_suppkey"]),
    "a13_complete_buysell": lambda s, d: monitor.complete_buysell(V.raw_trades(s, d)),
    "a14_median_baseline": lambda s, d: monitor.median_baseline(probe_log(s, d)),
    "a15_coverage": lambda s, d: monitor.coverage(V.table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 7).alias("history"), F.col("s_nationkey").alias("raw_rows"), F.lit(20).alias("base_rows"), (F.col("s_nationkey") + 3).alias("instruments"), F.lit(22).alias("base_instruments"), F.lit(5).alias("brokers"), F.lit(0).alias("base_brokers"))),
    "a45_branch_probe": lambda s, d: monitor.branch_probe(V.raw_trades(s, d), V.table(s, d, "customer").select(F.col("c_custkey").alias("broker")), V.table(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("broker"))),
    "w17_stable_runs": lambda s, d: monitor.stable_runs(probes(s, d), "user_id", "ts", "mark", "failed").select("event_id", "stable"),
    "t7_last_per_day": lambda s, d: monitor.last_per_day(probe_log(s, d)),
}


def _first_value(s: SparkSession, d: str) -> DataFrame:
    from ..functions.scalars import first_value

    df = V.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "-").otherwise(F.col("p_type")).alias("報酬 ％"), F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_brand")).alias("alt"))
    return df.select("p_partkey", first_value(df, ["報酬%", "none", "alt"], fuzzy=True).alias("value"))


def _mask(s: SparkSession, d: str) -> DataFrame:
    from ..functions.scalars import mask_view

    return mask_view(V.table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), ["p_name", "p_brand"])


def _rankings(s: SparkSession, d: str) -> DataFrame:
    hits = top_feed(s, d).groupBy("stock").agg(F.sum("net_amt").alias("net_amt"))
    buy, sell, both = spot.rankings(hits, 10, "stock")
    return buy.withColumn("kind", F.lit("buy")).unionByName(sell.withColumn("kind", F.lit("sell"))).unionByName(both.withColumn("kind", F.lit("abs")))


def _signal(a: str, b: str) -> str:
    return f"SELECT *, CASE WHEN {b}_amt::DOUBLE / nullif({a}_amt, 0) >= 1 AND n_{b} >= n_{a} THEN 'reverse' WHEN n_{a} >= 2 AND n_{b} >= 2 AND {b}_amt::DOUBLE / nullif({a}_amt, 0) >= 0.5 THEN 'split' WHEN n_{a} >= 2 THEN n_{a} || ' {a} together' WHEN n_{a} = 1 THEN 'single' ELSE '-' END AS signal FROM cons"


_ADDS = "WITH {o}, rd AS (SELECT DISTINCT day FROM outcomes WHERE day <= DATE '{day}' ORDER BY day DESC LIMIT 50), adds AS (SELECT broker, target, count(DISTINCT day) AS adds FROM outcomes WHERE day IN (SELECT day FROM rd) AND (exit_day IS NULL OR exit_day > DATE '{day}') AND amount >= 55000 GROUP BY ALL)"
_TOPSIDES = "SELECT * EXCLUDE (r) FROM (SELECT {cols}, net_amt, 'buy' AS direction, row_number() OVER ({part} ORDER BY net_amt DESC, stock)::INT AS rank, row_number() OVER ({part} ORDER BY net_amt DESC, stock) AS r FROM sums WHERE net_amt > 0) WHERE r <= {n} UNION ALL SELECT * EXCLUDE (r) FROM (SELECT {cols}, net_amt, 'sell', row_number() OVER ({part} ORDER BY net_amt, stock)::INT, row_number() OVER ({part} ORDER BY net_amt, stock) AS r FROM sums WHERE net_amt < 0) WHERE r <= {n}"
_TABLE = f"{_STATS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY broker, kind ORDER BY priority DESC, (win_rate IS NOT NULL)::INT + (hold IS NOT NULL)::INT DESC, n DESC) AS r FROM stats0) WHERE r = 1), piv AS (SELECT broker, max(win_rate) FILTER (kind = 'A') AS A_win_rate, max(hold) FILTER (kind = 'A') AS A_hold, max(n) FILTER (kind = 'A') AS A_n, max(win_rate) FILTER (kind = 'total') AS total_win_rate, max(hold) FILTER (kind = 'total') AS total_hold, max(n) FILTER (kind = 'total') AS total_n FROM best GROUP BY broker)"
ORACLE_SQL = {
    "j8_sell_event_by_priority": f"WITH {V.EVENTS}, {_LOOK} SELECT * FROM look",
    "j8_sell_event_by_date": f"WITH {V.EVENTS} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY broker, target ORDER BY day, event_id) AS r FROM events) WHERE r = 1",
    "j9_not_shown": f"WITH {V.EVENTS} SELECT event_id FROM events WHERE target NOT IN (SELECT target FROM events WHERE event = 'E' AND broker % 3 = 0)",
    "j10_qualifying_plain_sells": f"WITH {V.EVENTS}, {_LOOK}, plain AS (SELECT broker, target, code, day, sell_amt, sell_qty FROM facts f WHERE sell_qty > 0 AND NOT EXISTS (SELECT 1 FROM look l WHERE l.broker % 2 = 0 AND l.broker = f.broker AND l.target = f.target)) SELECT * FROM plain WHERE (broker, target, day) IN (SELECT (broker, target, day) FROM plain GROUP BY broker, target, day HAVING sum(sell_amt) >= 60000)",
    "j16_coalesce_detail": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type WHEN p_size % 3 = 0 THEN p_brand END AS items FROM part",
    "a20_position_rollup": f"WITH {V.FACTS}, s AS (SELECT target, broker, sum(buy_amt)::BIGINT AS cost, sum(CASE WHEN code % 3 > 0 THEN net_qty * 100 END)::BIGINT AS pnl, sum(CASE WHEN code % 3 > 0 THEN buy_amt END)::BIGINT AS estimable FROM facts WHERE buy_amt > 0 GROUP BY ALL) SELECT *, floor(pnl::DOUBLE / nullif(estimable, 0) * 100 * 1e4 + 0.5) / 1e4 AS ret, CASE WHEN estimable::DOUBLE / cost < 0.6 THEN '*' ELSE '' END AS mark FROM s",
    "a21_merge_broker_detail": f"WITH {V.FACTS} SELECT target, CASE WHEN broker % 2 = 0 THEN broker::VARCHAR ELSE 'b' || (broker % 4) END AS key, max('b' || (broker % 4)) AS name, sum(buy_amt)::BIGINT AS amount, floor(sum(buy_amt * (broker % 7) * 100)::DOUBLE / nullif(sum(buy_amt), 0)::DOUBLE / 100 * 1e4 + 0.5) / 1e4 AS ret FROM facts GROUP BY 1, 2",
    "a22_compress_buys": f"WITH {V.EVENTS} SELECT broker, 'new' AS status, event, target, sum(amount)::BIGINT AS amount, sum(qty)::BIGINT AS qty, string_agg(DISTINCT day(day)::VARCHAR, '、' ORDER BY day(day)::VARCHAR) AS items FROM events GROUP BY broker, event, target",
    "a22_compress_sells": f"WITH {V.FACTS}, x AS (SELECT broker, target, sell_amt AS amount, CASE WHEN code % 2 = 0 THEN sell_amt - 100 END AS cost, (code % 150 - 100)::DOUBLE AS ret, (code % 9)::VARCHAR AS item FROM facts WHERE sell_qty > 0), y AS (SELECT *, CASE WHEN ret > -95 THEN floor(amount::DOUBLE / (1 + ret / 100) + 0.5)::BIGINT END AS imp FROM x), z AS (SELECT broker, target, sum(amount)::BIGINT AS amount, sum(cost) AS c, sum(amount) FILTER (cost IS NOT NULL) AS a, sum(imp) AS ic, sum(amount) FILTER (imp IS NOT NULL) AS ia, string_agg(DISTINCT item, '、' ORDER BY item) AS items FROM y GROUP BY ALL) SELECT broker, 'plain' AS status, target, amount, items, floor(CASE WHEN c > 0 THEN (a - c)::DOUBLE / c::DOUBLE * 100 WHEN ic > 0 THEN (ia - ic)::DOUBLE / ic::DOUBLE * 100 END * 100 + 0.5) / 100 AS ret FROM z",
    "a23_daily_kpi": f"WITH {V.EVENTS}, b AS (SELECT broker, count(*) AS n_buys, sum(amount)::BIGINT AS buy_amt FROM events WHERE year(day) = 1999 GROUP BY broker), s AS (SELECT broker, count(*) AS n_sells, sum(sell_amt)::BIGINT AS sell_amt FROM facts WHERE sell_qty > 0 AND day = DATE '1999-06-15' GROUP BY broker) SELECT s_suppkey AS broker, coalesce(n_buys, 0) AS n_buys, coalesce(buy_amt, 0)::BIGINT AS buy_amt, coalesce(n_sells, 0) AS n_sells, coalesce(sell_amt, 0)::BIGINT AS sell_amt, coalesce(n_buys, 0) + coalesce(n_sells, 0) > 0 AS active FROM supplier LEFT JOIN b ON b.broker = s_suppkey LEFT JOIN s ON s.broker = s_suppkey",
    "a24_actual_daily_net": f"WITH {V.FACTS} SELECT broker, sum(net_amt)::BIGINT AS net_amt FROM facts WHERE day = DATE '1999-06-15' GROUP BY broker",
    "a25_add_count": _ADDS.format(o=V.OUTCOMES, day=DAY) + " SELECT * FROM adds",
    "a26_mean_hold_days": f"WITH {V.OUTCOMES} SELECT s_suppkey AS broker, floor(avg(hold_days) * 1e4 + 0.5) / 1e4 AS mean_hold FROM supplier LEFT JOIN outcomes ON broker = s_suppkey GROUP BY s_suppkey",
    "a27_merge_window_detail": f"WITH {V.FACTS}, {_WROWS}, o AS (SELECT DISTINCT * FROM wrows), s AS (SELECT broker, target, sum(buy_amt)::BIGINT AS buy_amt, sum(sell_amt)::BIGINT AS sell_amt, floor({_W} * 1e4 + 0.5) / 1e4 AS ret FROM o GROUP BY ALL), it AS (SELECT broker, target, string_agg(DISTINCT i, '、' ORDER BY i) AS items FROM (SELECT broker, target, unnest(string_split(items, '、')) AS i FROM o) GROUP BY ALL) SELECT s.*, it.items, CASE WHEN buy_amt > sell_amt THEN 'buy' WHEN buy_amt < sell_amt THEN 'sell' ELSE 'flat' END AS direction, ret > 0 AS won FROM s JOIN it USING (broker, target)",
    "a28_consensus_map": f"WITH {V.FACTS}, {_NET} SELECT * FROM cons",
    "a29_consensus_signal": f"WITH {V.FACTS}, {_NET} {_signal('buy', 'sell')} UNION ALL {_signal('sell', 'buy')}",
    "a30_branch_window_meta": f"WITH {V.FACTS}, {_WROWS}, o AS (SELECT DISTINCT * FROM wrows) SELECT broker, sum(buy_amt)::BIGINT AS buy_amt, sum(sell_amt)::BIGINT AS sell_amt, count(*) FILTER (ret > 0) AS n_win, count(*) FILTER (ret < 0) AS n_loss, CASE WHEN broker % 4 = 0 THEN 1.5::DOUBLE ELSE floor({_W} * 1e4 + 0.5) / 1e4 END AS ret FROM o GROUP BY broker",
    "a31_win_rate_table": f"WITH {_TABLE} SELECT * FROM piv",
    "a42_history_stats": f"WITH {_TABLE} SELECT n_nationkey AS broker, coalesce(total_n, 0) AS n, total_win_rate AS win_rate, total_hold AS hold FROM nation LEFT JOIN piv ON broker = n_nationkey",
    "a35_card_summary": f"WITH {V.OUTCOMES}, t AS (SELECT * FROM outcomes WHERE ret IS NOT NULL ORDER BY amount DESC, event_id LIMIT 10) SELECT count(*) AS n, sum(amount)::BIGINT AS amount, round_even(sum(amount * ret) / sum(amount), 4) AS weighted_ret, round_even(count(*) FILTER (ret > 0) * 100 / count(ret), 2) AS win_rate FROM t",
    "a36_latest_day": "SELECT greatest((SELECT max(o_orderdate::DATE) FROM orders), (SELECT max(l_shipdate::DATE) FROM lineitem)) AS day",
    "a37_consensus_ranking": f"WITH {V.FACTS}, rd AS (SELECT DISTINCT day FROM facts WHERE day <= DATE '{DAY}' ORDER BY day DESC LIMIT 21), {_NET.replace('FROM facts', 'FROM facts WHERE day IN (SELECT day FROM rd)')}, r AS (SELECT *, buy_amt - sell_amt AS rank_amt, row_number() OVER (ORDER BY n_buy DESC, buy_amt - sell_amt DESC, target) AS rank FROM cons) SELECT * FROM r WHERE rank <= 15",
    "a40_position_cache": "WITH p AS (SELECT o_orderpriority AS target, o_orderkey % 10 AS broker, date_trunc('year', o_orderdate)::DATE AS stat_date, o_orderkey AS updated, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice - 90000 + 0.0 END AS cost, o_totalprice - 90000 AS estimable, 0.0 AS unpriced FROM orders), a AS (SELECT * FROM p WHERE stat_date = coalesce((SELECT max(stat_date) FROM p WHERE stat_date <= DATE '2000-06-30'), (SELECT max(stat_date) FROM p))) SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY target, broker ORDER BY updated DESC) AS r FROM a) WHERE r = 1 AND cost > 0",
    "a41_month_consensus": f"WITH {V.FACTS}, fl AS (SELECT target, CASE WHEN max(code) % 2 = 0 THEN sum(net_amt)::BIGINT END AS net_cost FROM facts GROUP BY target), d AS (SELECT target, sum(buy_amt)::BIGINT AS c, count(DISTINCT broker) AS brokers FROM facts WHERE buy_amt > 0 GROUP BY target), m AS (SELECT fl.target, coalesce(net_cost, c) AS net_cost, brokers FROM fl LEFT JOIN d USING (target)), r AS (SELECT *, row_number() OVER (ORDER BY net_cost DESC, target) AS rank FROM m WHERE net_cost > 0) SELECT * FROM r WHERE rank <= 15",
    "a43_daily_buys": _ADDS.format(o=V.OUTCOMES, day="1999-06-15") + " SELECT e.*, coalesce(adds, 1) AS adds FROM events e LEFT JOIN adds USING (broker, target) WHERE e.day = DATE '1999-06-15' AND e.amount >= 52000",
    "a44_daily_sells": f"WITH {V.EVENTS}, {_LOOK}, td AS (SELECT f.broker, f.target, f.sell_amt, l.event FROM facts f LEFT JOIN look l ON l.broker % 2 = 0 AND l.broker = f.broker AND l.target = f.target WHERE sell_qty > 0 AND f.day = DATE '1999-06-15'), g AS (SELECT broker, target, CASE WHEN event IS NULL THEN 'plain' ELSE 'event' END AS status, sum(sell_amt)::BIGINT AS amount, max(coalesce(event, '')) AS event FROM td GROUP BY 1, 2, 3) SELECT * FROM g WHERE amount >= CASE WHEN status = 'plain' THEN 60000 ELSE 30000 END",
    "w8_latest_snapshot": f"WITH {_SNAP} SELECT * FROM snap WHERE (updated, run_id) = (SELECT (updated, run_id) FROM snap ORDER BY updated DESC, run_id DESC LIMIT 1)",
    "w8_latest_snapshot_run_id": f"WITH {_SNAP} SELECT * FROM snap WHERE run_id = (SELECT max(run_id) FROM snap WHERE run_id <> 'draft')",
    "w9_asof_stat_date": f"WITH {_SNAP} SELECT * FROM snap WHERE stat_date = (SELECT max(stat_date) FROM snap WHERE stat_date <= DATE '1999-06-15')",
    "w10_top_n": f"WITH {V.FACTS} SELECT * FROM (SELECT broker, target, code, day, net_amt, row_number() OVER (PARTITION BY target ORDER BY net_amt DESC, broker, code, day) AS rank FROM facts) WHERE rank <= 5",
    "w11_rank_dedupe": f"WITH {V.EVENTS} SELECT target, rank, amount FROM (SELECT target, day(day) AS rank, amount, row_number() OVER (PARTITION BY target ORDER BY day(day), amount DESC, broker) AS r FROM events) WHERE r = 1",
    "w12_dedupe_daily_sells": "WITH x AS (SELECT DISTINCT l_shipdate::DATE AS day, l_suppkey % 5 AS broker, l_partkey % 20 AS code, l_extendedprice AS amount, l_quantity AS qty, l_discount AS ret, l_tax AS cost, CASE WHEN l_linenumber > 1 THEN l_linestatus END AS name, CASE WHEN l_linenumber = 2 THEN 'A' ELSE '' END AS event FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY day, broker, code ORDER BY amount DESC, qty DESC, ret DESC, cost DESC) AS r, max(name) OVER k AS n2, max(event) OVER k AS e2 FROM x WINDOW k AS (PARTITION BY day, broker, code)) SELECT day, broker, code, n2 AS name, e2 AS event, amount, qty, ret, cost FROM r WHERE r = 1",
    "w13_dedupe_buys": "SELECT DISTINCT l_suppkey, l_returnflag, floor(l_discount * 1e4 + 0.5) / 1e4 AS l_discount, floor(l_tax * 1e4 + 0.5) / 1e4 AS l_tax FROM lineitem",
    "w16_recent_days": f"WITH {V.EVENTS} SELECT DISTINCT day FROM events WHERE day <= DATE '{DAY}' ORDER BY day DESC LIMIT 50",
    "w18_supplement_events": f"WITH {V.EVENTS}, main AS (SELECT * FROM events WHERE event_id = '1|Brand#1|1995-01-01' OR (event = 'E' AND broker = 1 AND year(day) = 1995 AND month(day) = 1)), pool AS (SELECT * FROM events WHERE event IN ('C', 'D', 'E') AND target NOT IN (SELECT target FROM main)), b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY event DESC, amount DESC, event_id) AS r FROM pool), t AS (SELECT * EXCLUDE (r), row_number() OVER (ORDER BY event DESC, amount DESC, event_id)::INT AS rank FROM b WHERE r = 1) SELECT t.* FROM t WHERE (SELECT count(*) FROM main) < 5 AND rank <= 7 - (SELECT count(*) FROM main)",
    "w7_wavg_cost_by_instrument": f"WITH RECURSIVE {V.FACTS}, days AS (SELECT broker, code, day, sum(buy_qty)::DOUBLE AS bq, sum(buy_amt)::DOUBLE AS ba, sum(sell_qty)::DOUBLE AS sq, sum(sell_amt)::DOUBLE AS sa, row_number() OVER (PARTITION BY broker, code ORDER BY day) AS r FROM facts GROUP BY broker, code, day), fold AS (SELECT broker, code, 0::BIGINT AS r, NULL::DATE AS day, 0::DOUBLE AS held, 0::DOUBLE AS mean, NULL::DOUBLE AS cost, NULL::DOUBLE AS ret FROM (SELECT DISTINCT broker, code FROM days) UNION ALL SELECT d.broker, d.code, d.r, d.day, (f.held - least(f.held, d.sq)) + d.bq, CASE WHEN d.bq > 0 THEN ((f.held - least(f.held, d.sq)) * f.mean + d.ba) / ((f.held - least(f.held, d.sq)) + d.bq) ELSE f.mean END, CASE WHEN d.sq > 0 AND f.held > 0 THEN f.mean * d.sq END, CASE WHEN d.sq > 0 AND f.held > 0 AND f.mean > 0 THEN (d.sa - f.mean * d.sq) / (f.mean * d.sq) * 100 END FROM fold f JOIN days d ON d.broker = f.broker AND d.code = f.code AND d.r = f.r + 1) SELECT broker, code, day, round_even(cost + 1e-7, 4) AS cost, round_even(ret + 1e-7, 4) AS ret FROM fold WHERE cost > 0",
    "w7_wavg_cost_returns": f"WITH RECURSIVE {V.FACTS}, days AS (SELECT broker, target, day, sum(buy_qty)::DOUBLE AS bq, sum(buy_amt)::DOUBLE AS ba, sum(sell_qty)::DOUBLE AS sq, sum(sell_amt)::DOUBLE AS sa, row_number() OVER (PARTITION BY broker, target ORDER BY day) AS r FROM facts GROUP BY broker, target, day), fold AS (SELECT broker, target, 0::BIGINT AS r, NULL::DATE AS day, 0::DOUBLE AS held, 0::DOUBLE AS mean, NULL::DOUBLE AS cost, NULL::DOUBLE AS ret FROM (SELECT DISTINCT broker, target FROM days) UNION ALL SELECT d.broker, d.target, d.r, d.day, (f.held - least(f.held, d.sq)) + d.bq, CASE WHEN d.bq > 0 THEN ((f.held - least(f.held, d.sq)) * f.mean + d.ba) / ((f.held - least(f.held, d.sq)) + d.bq) ELSE f.mean END, CASE WHEN d.sq > 0 AND f.held > 0 THEN f.mean * d.sq END, CASE WHEN d.sq > 0 AND f.held > 0 AND f.mean > 0 THEN (d.sa - f.mean * d.sq) / (f.mean * d.sq) * 100 END FROM fold f JOIN days d ON d.broker = f.broker AND d.target = f.target AND d.r = f.r + 1) SELECT broker, target, day, round_even(cost, 4) AS cost, round_even(ret, 4) AS ret FROM fold WHERE cost > 0",
    "w19_order_by_list": "SELECT p_size % 6 AS broker, p_retailprice AS amount, p_partkey::VARCHAR AS code, row_number() OVER (ORDER BY CASE p_size % 6 WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 5 THEN 3 ELSE 4 END, p_retailprice DESC, p_partkey, p_size % 6) AS rank FROM part",
    "p31_scope_filter": f"WITH {_SNAP} SELECT * FROM snap WHERE scope = '1-URGENT'",
    "p32_selected_scope": f"WITH {_SNAP} SELECT * FROM snap WHERE scope = '5-LOW'",
    "p11_first_value": "SELECT p_partkey, CASE WHEN p_size % 2 > 0 THEN p_type WHEN p_size % 3 > 0 THEN p_brand END AS value FROM part",
    "p37_mask_view": "SELECT p_partkey, '***' AS p_name, '***' AS p_brand, p_size FROM part",
    "s14_project_top": f"WITH {_FEED} SELECT * FROM feed",
    "s11_upsert_last": "WITH b AS (SELECT o_custkey, o_orderpriority, o_orderkey AS v, o_totalprice FROM orders UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey + 1000000000, o_totalprice + 1 FROM orders WHERE o_orderkey % 2 = 0) SELECT o_custkey, o_orderpriority, max(v) AS v, arg_max(o_totalprice, v) AS o_totalprice FROM b GROUP BY ALL",
    "o1_rankings": f"WITH {_FEED}, h AS (SELECT stock, sum(net_amt) AS net_amt FROM feed GROUP BY stock) SELECT * FROM (SELECT stock, net_amt, row_number() OVER (ORDER BY net_amt DESC, stock) AS rank, 'buy' AS kind FROM h WHERE net_amt > 0 UNION ALL SELECT stock, net_amt, row_number() OVER (ORDER BY net_amt, stock), 'sell' FROM h WHERE net_amt < 0 UNION ALL SELECT stock, net_amt, row_number() OVER (ORDER BY abs(net_amt) DESC, stock), 'abs' FROM h) WHERE rank <= 10",
    "a16_branch_summary": f"WITH {_FEED} SELECT broker, sum(net_lots) AS net_lots, sum(buy_amt) AS buy_amt, sum(sell_amt) AS sell_amt, sum(net_amt) AS net_amt, count(*) AS n FROM feed GROUP BY broker",
    "a17_tracked_stock_top": f"WITH {_FEED}, sums AS (SELECT stock, sum(net_amt) AS net_amt, count(DISTINCT broker) AS n_brokers, string_agg(DISTINCT broker::VARCHAR, '、' ORDER BY broker) AS brokers FROM (SELECT * FROM feed WHERE broker % 2 = 0 ORDER BY broker) GROUP BY stock) ".replace("string_agg(DISTINCT broker::VARCHAR, '、' ORDER BY broker)", "array_to_string(list_sort(list(DISTINCT broker)), '、')") + _TOPSIDES.format(cols="stock, n_brokers, brokers", part="", n=20),
    "a18_branch_stock_top": f"WITH {_FEED}, sums AS (SELECT broker, stock, sum(net_amt) AS net_amt FROM feed GROUP BY ALL) " + _TOPSIDES.format(cols="broker, stock", part="PARTITION BY broker", n=5),
    "a19_market_stock_buy_top": f"WITH {_FEED}, h AS (SELECT stock, sum(net_amt) AS net_amt FROM feed WHERE list = 'buy' AND net_amt > 0 GROUP BY stock) SELECT * FROM (SELECT stock, net_amt, row_number() OVER (ORDER BY net_amt DESC, stock) AS rank FROM h) WHERE rank <= 20",
    "a46_run_info": f"WITH {_FEED} SELECT 'hits' AS item, count(*) AS value FROM feed WHERE broker % 2 = 0 UNION ALL SELECT 'brokers', count(DISTINCT broker) FROM feed WHERE broker % 2 = 0 UNION ALL SELECT 'feed rows', count(*) FROM feed UNION ALL SELECT 'stocks', count(DISTINCT stock) FROM feed",
    "a47_unique_text": "SELECT o_custkey, (SELECT string_agg(s, '、' ORDER BY k) FROM (SELECT o_orderstatus AS s, min(o_orderkey) AS k FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY o_orderstatus)) AS texts, arg_min(o_orderpriority, o_orderkey) AS first FROM orders o GROUP BY o_custkey",
    "a11_probe_metrics": f"WITH {V.RAW} SELECT count(*) AS rows, count(DISTINCT code) AS instruments, sum(buy)::BIGINT AS buy_qty, sum(sell)::BIGINT AS sell_qty, sum(round_even(price * buy, 0)::BIGINT)::BIGINT AS buy_amt, sum(round_even(price * sell, 0)::BIGINT)::BIGINT AS sell_amt, (sum(round_even(price * buy, 0)::BIGINT) - sum(round_even(price * sell, 0)::BIGINT))::BIGINT AS net_amt FROM raw",
    "a12_sha_fingerprint": "SELECT l_suppkey, sha256(string_agg(h, '' ORDER BY h)) AS fingerprint FROM (SELECT l_suppkey, sha256(l_orderkey || chr(1) || l_linenumber || chr(1) || l_returnflag) AS h FROM lineitem) GROUP BY l_suppkey",
    "a13_complete_buysell": f"WITH {V.RAW} SELECT day, broker, code, max(name) AS name, sum(buy)::BIGINT AS buy_qty, sum(sell)::BIGINT AS sell_qty, sum(floor(price * buy * 100 + 0.5)::BIGINT)::DOUBLE / 100 AS buy_amt, sum(floor(price * sell * 100 + 0.5)::BIGINT)::DOUBLE / 100 AS sell_amt FROM raw GROUP BY day, broker, code",
    "a14_median_baseline": f"WITH {_LOG}, good AS (SELECT *, row_number() OVER (ORDER BY target_date) AS at FROM last WHERE is_complete AND failed = 0), u AS (SELECT l.target_date, l.raw_rows, (SELECT count(*) FROM good g WHERE g.target_date < l.target_date) AS upto FROM last l) SELECT u.target_date, any_value(u.raw_rows) AS raw_rows, median(g.raw_rows) AS baseline, count(g.raw_rows) AS history FROM u LEFT JOIN good g ON g.at BETWEEN u.upto - 19 AND u.upto GROUP BY u.target_date",
    "a15_coverage": "WITH c AS (SELECT s_suppkey, s_suppkey % 7 AS history, s_nationkey AS raw_rows, 20 AS base_rows, s_nationkey + 3 AS instruments, 22 AS base_instruments, 5 AS brokers, 0 AS base_brokers, floor(least(s_nationkey / 20::DOUBLE, (s_nationkey + 3) / 22::DOUBLE) * 1e6 + 0.5) / 1e6 AS coverage FROM supplier) SELECT *, history >= 5 AS enforced, history < 5 OR coverage >= 0.9 AS passed FROM c",
    "a45_branch_probe": f"WITH {V.RAW}, r AS (SELECT broker, count(*) AS rows, count(DISTINCT code) AS instruments FROM raw GROUP BY broker) SELECT c_custkey AS broker, coalesce(rows, 0) AS rows, coalesce(instruments, 0) AS instruments, CASE WHEN s_suppkey IS NOT NULL THEN 'ERROR' WHEN rows IS NULL THEN 'NO_DATA' ELSE 'OK' END AS status FROM customer LEFT JOIN r ON r.broker = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey AND s_acctbal < 0",
    "w17_stable_runs": "WITH p AS (SELECT event_id, user_id, ts, event_type, event_type = 'error' AS bad, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), g AS (SELECT *, sum((bad OR before IS NULL OR before <> event_type OR before = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM p) SELECT event_id, CASE WHEN bad THEN 0 ELSE row_number() OVER (PARTITION BY user_id, run ORDER BY ts) END AS stable FROM g",
    "t7_last_per_day": f"WITH {_LOG} SELECT * FROM last",
}
