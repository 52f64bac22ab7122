"""Report tables: event look-ups for sales, dedupe rules, merges, consensus, snapshots, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .stats import cents, rounded
from .trades import representative_text


def weighted(amount: str, ret: str) -> Column:
    """Amount-weighted return over the rows that have one."""
    return rounded(F.sum(F.col(amount) * cents(F.col(ret))) / F.nullif(F.sum(F.when(F.col(ret).isNotNull(), F.col(amount))), F.lit(0)) / 100, 4)


def sell_event_by_priority(events: DataFrame, keys: list[str]) -> DataFrame:
    """Event of a later sale per key: class A before B, C, D; of equal classes the later day."""
    order = Window.partitionBy(*keys).orderBy("event", F.desc("day"), F.desc("event_id"))
    return events.where(F.col("event").isin("A", "B", "C", "D")).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def sell_event_by_date(events: DataFrame, keys: list[str]) -> DataFrame:
    """Event of a later sale per key: the earliest."""
    order = Window.partitionBy(*keys).orderBy("day", "event_id")
    return events.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def not_shown(candidates: DataFrame, shown: DataFrame) -> DataFrame:
    """Candidates neither of whose (broker, target) nor target is shown yet."""
    return candidates.join(shown.select("broker", "target").distinct(), ["broker", "target"], "left_anti").join(shown.select("target").distinct(), "target", "left_anti")


def qualifying_plain_sells(sells: DataFrame, lookup: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Sells without an event whose broker sold at least ``threshold`` of the target that day."""
    plain = sells.join(lookup.select(keys).distinct(), keys, "left_anti")
    enough = plain.groupBy("broker", "target", "day").agg(F.sum("sell_amt").alias("_s")).where(F.col("_s") >= threshold)
    return plain.join(enough, ["broker", "target", "day"], "left_semi")


def coalesce_detail(rows: DataFrame, key: str, *details: DataFrame) -> DataFrame:
    """``rows`` with the first non-empty ``items`` array that any of ``details`` (key, items) has."""
    out, names = rows, []
    for k, detail in enumerate(details):
        names.append(f"_items{k}")
        out = out.join(detail.select(key, F.col("items").alias(names[-1])), key, "left")
    return out.withColumn("items", F.coalesce(*(F.when(F.size(n) > 0, F.col(n)) for n in names))).drop(*names)


def position_rollup(detail: DataFrame, coverage_min: float = 0.6) -> DataFrame:
    """Per (target, broker) of some cost: cost, P&L over what can be estimated, return, and a star where less than ``coverage_min`` of the cost is priced.

    Where nothing can be estimated the return is the cost-weighted one of the rows' own (``ret``, if there is such a column).
    What is priced is ``traded`` (cost at a price of the day), or without such a column what can be estimated.
    """
    own = F.col("ret") if "ret" in detail.columns else F.lit(None).cast("double")
    traded = F.col("traded") if "traded" in detail.columns else F.col("estimable")
    rows = detail.withColumns({"_own": own, "_traded": traded}).withColumn("_weight", F.when(F.col("_own").isNotNull() & (F.col("cost") > 0), F.col("cost")))
    sums = rows.groupBy("target", "broker").agg(F.sum("cost").alias("cost"), F.sum("pnl").alias("pnl"), F.sum("estimable").alias("estimable"), F.sum("_traded").alias("_traded"), (F.sum(F.col("_weight") * cents(F.col("_own"))) / F.sum("_weight") / 100).alias("_own")).where("cost > 0")
    ret = F.coalesce(F.when(F.col("estimable") > 0, F.col("pnl") / F.nullif(F.col("estimable"), F.lit(0)) * 100), F.col("_own"))
    out = sums.withColumn("ret", rounded(ret, 4))
    covered = F.coalesce(F.col("_traded"), F.lit(0)) / F.col("cost")
    return out.withColumn("mark", F.when(F.col("ret").isNotNull() & (covered < coverage_min), "*").otherwise("")).drop("_own", "_traded")


def merge_broker_detail(exploded: DataFrame) -> DataFrame:
    """Broker detail by code, or by name where there is no code."""
    keyed = exploded.withColumn("key", F.coalesce(F.nullif(F.col("code"), F.lit("")), "name"))
    return keyed.groupBy("target", "key").agg(F.max("name").alias("name"), F.sum("amount").alias("amount"), weighted("amount", "ret").alias("ret"))


def compress_buys(actions: DataFrame) -> DataFrame:
    items = F.array_join(F.array_sort(F.collect_set("item")), "、")
    return actions.groupBy("broker", "status", "event", "target").agg(F.sum("amount").alias("amount"), F.sum("qty").alias("qty"), items.alias("items"))


def compress_sells(actions: DataFrame) -> DataFrame:
    """Sells by (broker, status, target); the return uses the same items above and below: those with a cost, else the cost that a return above -95 implies."""
    implied = F.when(F.col("ret") > -95, F.floor(F.col("amount") / (1 + F.col("ret") / 100) + 0.5).cast("bigint"))
    rows = actions.withColumns({"_cost": F.col("cost"), "_implied": implied})
    sums = rows.groupBy("broker", "status", "target").agg(
        F.sum("amount").alias("amount"), F.sum("_cost").alias("_c"), F.sum(F.when(F.col("_cost").isNotNull(), F.col("amount"))).alias("_a"), F.sum("_implied").alias("_ic"), F.sum(F.when(F.col("_implied").isNotNull(), F.col("amount"))).alias("_ia"), F.array_join(F.array_sort(F.collect_set("item")), "、").alias("items")
    )
    ret = F.when(F.col("_c") > 0, (F.col("_a") - F.col("_c")) / F.col("_c") * 100).when(F.col("_ic") > 0, (F.col("_ia") - F.col("_ic")) / F.col("_ic") * 100)
    return sums.withColumn("ret", rounded(ret, 2)).drop("_c", "_a", "_ic", "_ia")


def daily_kpi(buys: DataFrame, sells: DataFrame, brokers: DataFrame) -> DataFrame:
    """Per listed broker: buy and sell counts and amounts, and whether it was active."""
    b = buys.groupBy("broker").agg(F.count("*").alias("n_buys"), F.sum("amount").alias("buy_amt"))
    s = sells.groupBy("broker").agg(F.count("*").alias("n_sells"), F.sum("amount").alias("sell_amt"))
    out = brokers.select("broker").distinct().join(b, "broker", "left").join(s, "broker", "left").fillna(0)
    return out.withColumn("active", F.col("n_buys") + F.col("n_sells") > 0)


def actual_daily_net(facts: DataFrame, day: str, brokers: DataFrame) -> DataFrame:
    return facts.where(F.col("day") == F.lit(day).cast("date")).join(brokers.select("broker").distinct(), "broker", "left_semi").groupBy("broker").agg(F.sum("net_amt").alias("net_amt"))


def recent_days(events: DataFrame, day: str, n: int) -> DataFrame:
    return events.where(F.col("day") <= F.lit(day).cast("date")).select("day").distinct().orderBy(F.desc("day")).limit(n)


def add_count(events: DataFrame, day: str, n: int, threshold: float) -> DataFrame:
    """Distinct event days per (broker, target) of the last ``n`` event days, of events not left by then and large enough."""
    live = F.col("exit_day").isNull() | (F.col("exit_day") > F.lit(day).cast("date"))
    recent = events.join(F.broadcast(recent_days(events, day, n)), "day", "left_semi").where(live & (F.col("amount") >= threshold))
    return recent.groupBy("broker", "target").agg(F.countDistinct("day").alias("adds"))


def mean_hold_days(events: DataFrame, brokers: DataFrame) -> DataFrame:
    sums = events.where("hold_days is not null").groupBy("broker").agg(rounded(F.avg("hold_days"), 4).alias("mean_hold"))
    return brokers.select("broker").distinct().join(sums, "broker", "left")


def merge_window_detail(rows: DataFrame) -> DataFrame:
    """Per (broker, target): exact copies once, sums, weighted return, union of instruments, direction and outcome."""
    once = rows.dropDuplicates()
    sums = once.groupBy("broker", "target").agg(F.sum("buy_amt").alias("buy_amt"), F.sum("sell_amt").alias("sell_amt"), weighted("buy_amt", "ret").alias("ret"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("items", "、"))))), "、").alias("items"))
    net = F.col("buy_amt") - F.col("sell_amt")
    return sums.withColumns({"direction": F.when(net > 0, "buy").when(net < 0, "sell").otherwise("flat"), "won": F.col("ret") > 0})


def merge_window_sides(rows: DataFrame) -> DataFrame:
    """Per (broker, target): exact copies once, sums, the amount-weighted return of each side, direction and outcome by the side of the net.

    rows: broker, target, buy_amt, sell_amt, buy_ret, sell_ret, direction, primary_ret, items (separated by ; or ；).  A row without a side's
    return gives its primary one if its direction is that side.
    """
    own = lambda side, word: F.coalesce(F.col(f"{side}_ret"), F.when(F.col("direction") == word, F.col("primary_ret")))
    once = rows.dropDuplicates().withColumns({"_b": own("buy", "buy"), "_s": own("sell", "sell")})
    mean = lambda amount, ret: F.bround(F.sum(F.when(F.col(amount) > 0, F.col(amount) * cents(F.col(ret)))) / F.sum(F.when((F.col(amount) > 0) & F.col(ret).isNotNull(), F.col(amount))) / 100, 2)
    parts = F.filter(F.transform(F.split("items", "[；;]"), lambda x: F.trim(x)), lambda x: x != "")
    sums = once.groupBy("broker", "target").agg(F.sum("buy_amt").alias("buy_amt"), F.sum("sell_amt").alias("sell_amt"), mean("buy_amt", "_b").alias("buy_ret"), mean("sell_amt", "_s").alias("sell_ret"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(parts)))).alias("_items"))
    net = F.col("buy_amt") - F.col("sell_amt")
    out = sums.withColumns({"direction": F.when(net > 0, "buy").when(net < 0, "sell").otherwise("flat"), "net_buy": F.greatest(net, F.lit(0)), "net_sell": F.greatest(-net, F.lit(0)), "items": F.array_join("_items", "；"), "n_items": F.size("_items")}).drop("_items")
    out = out.withColumn("primary_ret", F.when(net > 0, F.col("buy_ret")).when(net < 0, F.col("sell_ret")))
    return out.withColumn("outcome", F.when(F.col("primary_ret").isNull(), "-").when(F.col("primary_ret") > 0, "won").otherwise("lost"))


def branch_window_returns(rows: DataFrame) -> DataFrame:
    """Per broker: totals, net, wins and losses, and its buy, sell and overall returns; a stated return comes before the weighted one.

    rows: those of ``merge_window_sides``, with stated_buy, stated_sell and stated_ret of the broker (null without).  The overall return weighs a
    row's primary one by its net amount, of a flat row by the larger side.
    """
    mean = lambda weight, ret: F.bround(F.sum(F.when(weight > 0, weight * cents(F.col(ret)))) / F.sum(F.when((weight > 0) & F.col(ret).isNotNull(), weight)) / 100, 2)
    weight = F.when(F.col("direction") == "buy", F.col("net_buy")).when(F.col("direction") == "sell", F.col("net_sell")).otherwise(F.greatest("buy_amt", "sell_amt"))
    sums = rows.withColumn("_w", weight).groupBy("broker").agg(
        F.sum("buy_amt").alias("buy_amt"), F.sum("sell_amt").alias("sell_amt"), F.sum(F.col("buy_amt") - F.col("sell_amt")).alias("net"), F.count_if(F.col("outcome") == "won").alias("n_win"), F.count_if(F.col("outcome") == "lost").alias("n_loss"),
        F.coalesce(F.max("stated_buy"), mean(F.col("buy_amt"), "buy_ret")).alias("buy_ret"), F.coalesce(F.max("stated_sell"), mean(F.col("sell_amt"), "sell_ret")).alias("sell_ret"), F.coalesce(F.max("stated_ret"), mean(F.col("_w"), "primary_ret")).alias("ret"),
    )
    return sums.withColumn("win_rate", F.bround(F.col("n_win") * 100 / F.nullif(F.col("n_win") + F.col("n_loss"), F.lit(0)), 2))


def underlying_names(events: DataFrame, known: DataFrame) -> DataFrame:
    """(code, name): each code's most frequent name, then the shortest, then the first; a name of ``known`` (name, known_code) counts for that code."""
    rows = events.where("code is not null and code <> '' and name is not null and name <> ''").join(known, "name", "left")
    return representative_text(rows.select(F.coalesce("known_code", "code").alias("code"), "name"), ["code"], "name")


def consensus_map(flows: DataFrame) -> DataFrame:
    """Per target: brokers and net amounts by side, each broker once on the side of its own net."""
    net = flows.groupBy("target", "broker").agg(F.sum("net_amt").alias("net"))
    buys, sells = F.col("net") > 0, F.col("net") < 0
    return net.groupBy("target").agg(F.count_if(buys).alias("n_buy"), F.count_if(sells).alias("n_sell"), F.sum(F.when(buys, F.col("net")).otherwise(0)).alias("buy_amt"), F.sum(F.when(sells, -F.col("net")).otherwise(0)).alias("sell_amt"))


def consensus_signal(consensus: DataFrame, direction: str) -> DataFrame:
    """Signal of a target seen from ``direction`` (buy or sell): reverse, split, n together, single, or none."""
    other = "sell" if direction == "buy" else "buy"
    same_n, opp_n, same_a, opp_a = (F.col(c) for c in (f"n_{direction}", f"n_{other}", f"{direction}_amt", f"{other}_amt"))
    ratio = opp_a / F.nullif(same_a, F.lit(0))
    signal = (
        F.when((ratio >= 1) & (opp_n >= same_n), "reverse").when((same_n >= 2) & (opp_n >= 2) & (ratio >= 0.5), "split")
        .when(same_n >= 2, F.concat(same_n.cast("string"), F.lit(f" {direction} together"))).when(same_n == 1, "single").otherwise("-")
    )
    return consensus.withColumn("signal", signal)


def branch_window_meta(rows: DataFrame) -> DataFrame:
    """Per broker: totals, wins and losses, weighted return; a stated overall return comes before the computed one."""
    return rows.groupBy("broker").agg(F.sum("buy_amt").alias("buy_amt"), F.sum("sell_amt").alias("sell_amt"), F.count_if(F.col("ret") > 0).alias("n_win"), F.count_if(F.col("ret") < 0).alias("n_loss"), F.coalesce(F.max("stated_ret"), weighted("buy_amt", "ret")).alias("ret"))


def latest_day(*tables: tuple[DataFrame, str]) -> DataFrame:
    days = [df.agg(F.max(c).alias("day")) for df, c in tables]
    return reduce(lambda a, b: a.unionByName(b), days).agg(F.max("day").alias("day"))


def consensus_ranking(flows: DataFrame, n_days: int, day: str, top: int) -> DataFrame:
    """Targets by consensus over the last ``n_days`` trading days up to ``day``."""
    days = recent_days(flows, day, n_days)
    recent = flows.join(F.broadcast(days), "day", "left_semi")
    ranked = consensus_map(recent).withColumn("rank_amt", F.col("buy_amt") - F.col("sell_amt"))
    return top_n(ranked, [], [F.desc("n_buy"), F.desc("rank_amt"), F.col("target")], top)


def month_consensus(flows: DataFrame, detail: DataFrame, top: int = 15) -> DataFrame:
    """Net cost per target, missing ones filled from broker detail; none or negative dropped; first ``top`` with their broker counts."""
    d = detail.groupBy("target").agg(F.sum("cost").alias("_detail"), F.countDistinct("broker").alias("brokers"))
    met = flows.join(d, "target", "left").withColumn("net_cost", F.coalesce("net_cost", "_detail")).where("net_cost > 0").drop("_detail")
    return top_n(met, [], [F.desc("net_cost"), F.col("target")], top)


def stated_ranking(rows: DataFrame, kind: str, top: int = 15) -> DataFrame:
    """First ``top`` targets of a published ranking, of one ``kind`` (buy or sell), each once, missing figures taken from others.

    rows: target, kind, rank, rank_amt, buy_amt, sell_amt, net_buy, net_sell, n_same, n_brokers.  A net is the difference of the amounts, a
    rank amount of 0 the net of the kind's side, and the number of brokers that of those on the same side.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.where(F.col("kind") == kind).withColumns({c: zero(c) for c in ("rank", "buy_amt", "sell_amt", "n_same")})
    rows = rows.withColumns({"net_buy": F.coalesce("net_buy", F.col("buy_amt") - F.col("sell_amt")), "net_sell": F.coalesce("net_sell", F.col("sell_amt") - F.col("buy_amt"))})
    filled = rows.withColumns({"rank_amt": F.coalesce(F.nullif("rank_amt", F.lit(0)), F.col(f"net_{kind}")), "n_brokers": F.when(F.col("n_brokers") > 0, F.col("n_brokers")).otherwise(F.col("n_same"))})
    order = [F.col("rank"), F.desc("rank_amt")]
    ties = [F.desc(c) for c in ("buy_amt", "sell_amt", "net_buy", "net_sell", "n_same", "n_brokers")]
    once = filled.withColumn("_r", F.row_number().over(Window.partitionBy("target").orderBy(*order, *ties))).where("_r = 1").drop("_r")
    return once.orderBy(*order, "target").limit(top)


def month_ranking(rows: DataFrame, detail: DataFrame, top: int = 15) -> DataFrame:
    """First ``top`` targets of a published month's ranking, each once, with their merged brokers.

    rows: target, rank, net_cost, cost; detail: target, broker, amount.  A net cost that is missing or not above 0 is the sum of the detail, and
    a target without either is left out; a missing cost is the net one.  Stated ranks go first if there are any, else net costs decide.
    """
    sums = detail.groupBy("target", "broker").agg(F.sum("amount").alias("amount")).groupBy("target").agg(F.sum("amount").alias("_detail"), F.count("broker").alias("n_brokers"), F.min_by("broker", F.struct(-F.col("amount"), "broker")).alias("top_broker"))
    met = rows.join(sums, "target", "left").withColumns({"rank": F.coalesce("rank", F.lit(0)), "net_cost": F.when(F.col("net_cost") > 0, F.col("net_cost")).otherwise(F.col("_detail")), "n_brokers": F.coalesce("n_brokers", F.lit(0))}).where("net_cost > 0").drop("_detail")
    met = met.withColumn("cost", F.when(F.col("cost") > 0, F.col("cost")).otherwise(F.col("net_cost")))
    any_rank = met.agg(F.coalesce(F.max(F.col("rank") > 0), F.lit(False)).alias("_ranked"))
    order = [F.when(F.col("_ranked"), F.col("rank")), F.desc("net_cost"), F.desc("cost")]
    marked = met.join(F.broadcast(any_rank))  # one row
    once = marked.withColumn("_r", F.row_number().over(Window.partitionBy("target").orderBy(*order, "rank"))).where("_r = 1")
    return once.orderBy(*order, "target").limit(top).drop("_r", "_ranked")


def position_cache(rows: DataFrame, day: str) -> DataFrame:
    """Per (target, broker) as of the statistic date: cost missing is estimable plus unpriced; 0 or less is closed and dropped; last update wins."""
    asof = asof_stat_date(rows, day)
    order = Window.partitionBy("target", "broker").orderBy(F.desc("updated"))
    last = asof.withColumn("cost", F.coalesce("cost", F.col("estimable") + F.col("unpriced"))).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return last.where("cost > 0").drop("_r")


def latest_snapshot(df: DataFrame, by_run_id: bool = False) -> DataFrame:
    """Rows of the last snapshot: greatest well-formed run_id, or greatest (updated, run_id); unchanged without a run_id column."""
    if "run_id" not in df.columns:
        return df
    key = F.when(F.col("run_id").rlike(r"^\d{8}_\d{6}$"), F.struct(F.col("run_id"))) if by_run_id else F.struct("updated", "run_id")
    last = df.agg(F.max(key).alias("_last"))
    return df.join(F.broadcast(last), key == F.col("_last")).drop("_last")


def asof_stat_date(df: DataFrame, day: str) -> DataFrame:
    """Rows of the greatest statistic date up to ``day``, else of the greatest of all."""
    d = F.lit(day).cast("date")
    pick = df.agg(F.coalesce(F.max(F.when(F.col("stat_date") <= d, F.col("stat_date"))), F.max("stat_date")).alias("_pick"))
    return df.join(F.broadcast(pick), F.col("stat_date") == F.col("_pick")).drop("_pick")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key by ``order``, with their rank; without keys a sorted limit, then ranks of what is left."""
    if not keys:
        return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def rank_dedupe(df: DataFrame) -> DataFrame:
    """First row per target by (rank, amount descending, broker)."""
    order = Window.partitionBy("target").orderBy("rank", F.desc("amount"), "broker")
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def dedupe_daily_sells(df: DataFrame) -> DataFrame:
    """Exact copies once; per (day, broker, code) the row of the largest amount, its missing texts filled from others, a classified event preferred."""
    by_amount = F.struct("amount", "qty", "ret", "cost")
    return df.dropDuplicates().groupBy("day", "broker", "code").agg(F.max(by_amount).alias("_m"), F.max("name").alias("name"), F.coalesce(F.min(F.when(F.col("event") != "", F.col("event"))), F.lit("")).alias("event")).select("day", "broker", "code", "name", "event", "_m.*")


def dedupe_buys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, numbers of the key rounded to four places."""
    kinds = dict(df.dtypes)
    shaped = [rounded(F.col(k), 4).alias(k) if kinds[k] == "double" else F.col(k) for k in keys]
    return df.select(*shaped).distinct()


def supplement_events(main: DataFrame, events: DataFrame, least: int = 5, most: int = 7) -> DataFrame:
    """More events for a short list: best per (broker, target), best per target, E before D before C by amount, up to ``most`` rows in all."""
    have = main.agg(F.count("*").alias("_have"))
    pool = not_shown(events.where(F.col("event").isin("C", "D", "E")), main)
    best = pool.withColumn("_r", F.row_number().over(Window.partitionBy("broker", "target").orderBy(F.desc("event"), F.desc("amount"), "event_id"))).where("_r = 1")
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("event"), F.desc("amount"), "event_id"))).where("_r = 1").drop("_r")
    ranked = top_n(best, [], [F.desc("event"), F.desc("amount"), F.col("event_id")], most)
    return ranked.crossJoin(F.broadcast(have)).where(f"_have < {least} and rank <= {most} - _have").drop("_have")


def order_by_list(df: DataFrame, brokers: list) -> DataFrame:
    """Listed brokers first in their order, then by amount, code and broker, with their rank.

    Codes go by the number they begin with, then as text; those without one come last.  Rows are sorted in ranges; ranks come from the ranges' sizes.
    """
    at = F.array_position(F.array(*map(F.lit, brokers)), F.col("broker"))
    number = F.regexp_extract(F.col("code").cast("string"), r"^(\d+)", 1).try_cast("decimal(38,0)")
    order = [F.when(at == 0, len(brokers) + 1).otherwise(at), F.desc("amount"), number.asc_nulls_last(), F.col("code"), F.col("broker")]
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), part == F.col("_part")).withColumn("rank", (F.col("_before") + F.col("_id") % (1 << 33) + 1).cast("int")).drop("_id", "_part", "_before")


#: Days of the calendar in a slice of a key's history, and rows of one that is gone through at once.
SLICE_DAYS, WHOLE_ROWS = 64, 4096


def wavg_cost_returns(daily: DataFrame, keys: list[str], slice_days: int = SLICE_DAYS, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Moving weighted-average cost per key in day order, the day's sale before its buy; ``daily`` has a row for each key and day.

    Adds cost (average times the full sold quantity) and ret of each day with a sale while something is held; the holding falls by
    what it has at most.

    A key without a buy up to its last sale has no such day and goes no further.  One of ``whole_rows`` rows at most is one run, worked out by itself
    where the key's rows are; longer ones are sliced.

    A prefix scan in two levels.  A day takes a holding h to max(h - sold, 0) + bought, and steps of the form max(h + x, y) follow on each other as one
    step of that form; with the holding known, it takes the cost c to r * c + m, and such steps make one as well.  Each slice of ``slice_days`` of the calendar
    is summed up as one step, the slices' steps give what each slice begins with, and the slices are then run through by themselves.  So a task holds one
    slice's days, or one row for each slice of a key; a key with a third of all rows is spread over as many tasks as it has slices.
    """
    numbers = ("buy_qty", "buy_amt", "sell_qty", "sell_amt")
    part = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / slice_days)
    rows = F.array_sort(F.collect_list(F.struct("day", *(F.col(c).cast("double").alias(c) for c in numbers))))
    own = Window.partitionBy(*keys)
    first_buy, last_sale = F.min(F.when(F.col("buy_qty") > 0, F.col("day"))).over(own), F.max(F.when(F.col("sell_qty") > 0, F.col("day"))).over(own)
    able = daily.withColumns({"_long": F.count("*").over(own) > whole_rows, "_first": first_buy, "_last": last_sale}).where("_first <= _last")
    runs = stored(able.groupBy(*keys, "_long", F.when(F.col("_long"), part).alias("_part")).agg(rows.alias("days")), "slices")
    slices = runs.where("_long").drop("_long")
    at = [*keys, "_part"]
    order = Window.partitionBy(*keys).orderBy("_part")

    held_start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    held_step = lambda s, d: F.struct((s["x"] - d["sell_qty"] + d["buy_qty"]).alias("x"), F.greatest(s["y"] - d["sell_qty"] + d["buy_qty"], d["buy_qty"]).alias("y"))
    held = slices.select(*at, F.aggregate("days", held_start, held_step).alias("s")).withColumn("sum", F.sum("s.x").over(order))
    after = F.col("sum") + F.greatest(F.lit(0.0), F.max(F.col("s.y") - F.col("sum")).over(order))
    held = held.withColumn("_after", after).select(*at, F.coalesce(F.lag("_after").over(order), F.lit(0.0)).alias("held"))

    def left(s: Column, d: Column) -> Column:
        return F.greatest(s["held"] - d["sell_qty"], F.lit(0.0))

    def cost_step(s: Column, d: Column) -> Column:
        r = F.when((d["sell_qty"] > 0) & (s["held"] > 0), left(s, d) / s["held"]).otherwise(1.0)
        return F.struct((left(s, d) + d["buy_qty"]).alias("held"), (s["r"] * r).alias("r"), (s["m"] * r + d["buy_amt"]).alias("m"))

    steps = slices.join(held, at).select(*at, "held", F.aggregate("days", F.struct("held", F.lit(1.0).alias("r"), F.lit(0.0).alias("m")), cost_step).alias("s"))
    entry = "struct<cost:double,out:array<struct<_part:bigint,held:double,cost:double>>>"
    enter = lambda s, x: F.struct((s["cost"] * x["r"] + x["m"]).alias("cost"), F.concat(s["out"], F.array(F.struct(x["_part"].alias("_part"), x["held"].alias("held"), s["cost"].alias("cost")))).alias("out")).cast(entry)
    listed = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_part", "held", F.col("s.r").alias("r"), F.col("s.m").alias("m")))).alias("s"))
    begins = listed.select(*keys, F.inline(F.aggregate("s", F.struct(F.lit(0.0).alias("cost"), F.array().alias("out")).cast(entry), enter)["out"]))

    state = "struct<held:double,avg:double,out:array<struct<day:date,cost:double,ret:double>>>"

    def step(s: Column, x: Column) -> Column:
        sells = (x["sell_qty"] > 0) & (s["held"] > 0)
        cost = s["avg"] * x["sell_qty"]
        after = left(s, x) + x["buy_qty"]
        avg = F.when(x["buy_qty"] > 0, (left(s, x) * s["avg"] + x["buy_amt"]) / after).otherwise(s["avg"])
        row = F.struct(x["day"].alias("day"), cost.alias("cost"), ((x["sell_amt"] - cost) / cost * 100).alias("ret"))
        return F.struct(after.alias("held"), avg.alias("avg"), F.when(sells & (cost > 0), F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out")).cast(state)

    start = F.struct("held", F.when(F.col("held") > 0, F.col("cost") / F.col("held")).otherwise(0.0).alias("avg"), F.array().alias("out")).cast(state)
    sliced = slices.join(begins, at).select(*keys, F.explode(F.aggregate("days", start, step)["out"]).alias("r"))

    # In pieces, so that what has come out isn't copied at every day.
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("days") - 1) / slice_days).cast("int")), lambda i: F.slice("days", i * slice_days + 1, slice_days))
    passed = state.replace("out:array<struct<day:date,cost:double,ret:double>>", "out:array<array<struct<day:date,cost:double,ret:double>>>")
    begin = F.struct(F.lit(0.0), F.lit(0.0), F.array())

    def piece(s: Column, x: Column) -> Column:
        at_start = F.struct(s["held"], s["avg"], F.array()).cast(state)
        return F.aggregate(x, at_start, step, lambda t: F.struct(t["held"], t["avg"], F.concat(s["out"], F.array(t["out"]))).cast(passed))

    whole = runs.where("not _long").select(*keys, F.explode(F.aggregate(pieces, begin.cast(passed), piece, lambda s: F.flatten(s["out"]))).alias("r"))
    return whole.unionByName(sliced).select(*keys, "r.day", "r.cost", "r.ret")


def scope_filter(df: DataFrame, scope: str, col: str = "scope") -> DataFrame:
    """Rows of exactly that scope; all rows if there is no scope column; none if no row has it."""
    return df.where(F.col(col) == scope) if col in df.columns else df


def selected_scope(df: DataFrame, pattern: str, fallback: str, col: str = "scope") -> DataFrame:
    """Rows whose scope matches ``pattern`` if there are any, else those of ``fallback``."""
    there = df.agg(F.coalesce(F.max(F.col(col).rlike(pattern)), F.lit(False)).alias("_there"))
    return df.join(F.broadcast(there)).where((F.col("_there") & F.col(col).rlike(pattern)) | (~F.col("_there") & (F.col(col) == fallback))).drop("_there")


def daily_buys(events: DataFrame, day: str, threshold: float, adds: DataFrame) -> DataFrame:
    """Events of the day that are large enough, each once, with their add-count (1 if unknown)."""
    rows = events.where((F.col("day") == F.lit(day).cast("date")) & (F.col("amount") >= threshold)).dropDuplicates(["event_id"])
    return rows.join(adds, ["broker", "target"], "left").withColumn("adds", F.coalesce("adds", F.lit(1).cast("bigint")))


def daily_sells(sells: DataFrame, lookup: DataFrame, day: str, threshold: float) -> DataFrame:
    """The day's sells that belong to an event or qualify by themselves, compressed, from half the threshold on."""
    today = sells.where(F.col("day") == F.lit(day).cast("date"))
    keys = ["broker", "target"]
    known = today.join(lookup.select(*keys, "event"), keys).withColumn("status", F.lit("event"))
    plain = qualifying_plain_sells(today, lookup, keys, threshold).withColumns({"status": F.lit("plain"), "event": F.lit("")})
    both = known.unionByName(plain).groupBy("broker", "status", "target").agg(F.sum("sell_amt").alias("amount"), F.max("event").alias("event"))
    return both.where(F.col("amount") >= threshold / 2)


def admitted_sells(sells: DataFrame, lookup: DataFrame, day: str, threshold: float) -> DataFrame:
    """The day's sells that belong to an event or reach ``threshold`` by broker and target, with event, lots, return and cost.

    sells: day, broker, code, target, name, status, event, amount, qty (lots), shares, price, ret, cost; lookup: broker, code (once each), event, target,
    ret, cost, buy_avg.  Lots that are missing come from shares.  A sell's own return and cost go first; then the event's return; then the
    average cost of the lots sold, and the return against it; then the event's cost.  An event that is no class is "single".
    """
    known = F.col("_event").isNotNull()
    found = lookup.select("broker", "code", F.coalesce("event", F.lit("")).alias("_event"), F.col("target").alias("_target"), F.col("ret").alias("_ret"), F.col("cost").alias("_cost"), F.col("buy_avg").alias("_avg"))
    rows = sells.where((F.col("day") == F.lit(day).cast("date")) & (F.col("amount") > 0)).join(found, ["broker", "code"], "left")
    rows = rows.withColumns({"qty": F.when(F.col("qty") > 0, F.col("qty")).otherwise(F.floor(F.coalesce("shares", F.lit(0)) / 1000)), "target": F.coalesce(F.nullif("target", F.lit("")), "_target")})
    enough = rows.where(~known & F.col("target").isNotNull()).groupBy("broker", "target").agg(F.sum("amount").alias("_s")).where(F.col("_s") >= threshold)
    rows = rows.join(enough, ["broker", "target"], "left").where(known | F.col("_s").isNotNull())
    classed = lambda c: F.when(F.col(c).isin("A", "B", "C", "D", "E"), F.col(c))
    by_lots = known & (F.col("_avg") > 0) & (F.col("qty") > 0) & ~F.coalesce(F.col("cost") > 0, F.lit(False))
    return rows.select(
        "day", "broker", "code", "target", "name", "status", "amount", "qty",
        F.when(known, F.coalesce(classed("event"), classed("_event"))).alias("event"),
        F.coalesce("ret", "_ret", F.when(by_lots & (F.col("price") > 0), rounded((F.col("price") - F.col("_avg")) / F.col("_avg") * 100, 4))).alias("ret"),
        F.floor(F.when(F.col("cost") > 0, F.col("cost")).when(by_lots, F.col("_avg") * F.col("qty") * 1000).when(F.col("_cost") > 0, F.col("_cost")) + F.lit(0.5)).alias("cost"),
    ).fillna({"event": "single"})


def shown_sells(admitted: DataFrame, threshold: float) -> DataFrame:
    """``admitted_sells`` by broker, status and target; small sells count in the sum, which must reach half the threshold."""
    return compress_sells(admitted.withColumn("item", F.col("name"))).where(F.col("amount") >= threshold / 2)
