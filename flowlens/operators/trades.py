"""From raw trades to the compact fact, buying events and sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import amount_class, is_instrument_code, label_branch, norm_code


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Raises before anything runs if a column is missing; more columns are fine."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


#: Rows of a fact table that one task sorts and adds up.
TASK_ROWS = 400_000


def parts_for(df: DataFrame, rows: int) -> int:
    """How many partitions ``rows`` are dealt to: as many as keep a task's share the same however many there are, at least the session's own number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in ``parts`` partitions, by default the session's number; groups of these keys and more are then added up where they are."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def keep_tracked(trades: DataFrame, branches: DataFrame, code: str = "broker") -> DataFrame:
    """Rows of tracked branches with the branch's label; ``branches`` is (broker, label), one row a branch."""
    keys = branches.select(norm_code(F.col("broker").cast("string")).alias("_code"), "label").dropDuplicates(["_code"])
    return trades.withColumn("_code", norm_code(F.col(code).cast("string"))).join(keys, "_code").drop("_code")


def label_branches(df: DataFrame, name: str, patterns: list[tuple[str, str]]) -> DataFrame:
    return df.withColumn("label", label_branch(F.col(name), patterns))


def valid_trades(trades: DataFrame) -> DataFrame:
    """price, buy, sell as numbers with a flag ``valid``: price above 0, quantities integral and not negative."""
    price, buy, sell = (F.col(c).cast("string").try_cast("double") for c in ("price", "buy", "sell"))
    whole = lambda x: (x >= 0) & (F.pmod(x, F.lit(1.0)) == 0)
    valid = F.coalesce((price > 0) & whole(buy) & whole(sell), F.lit(False))
    return trades.withColumns({"valid": valid, "price": price, "buy": buy.cast("bigint"), "sell": sell.cast("bigint")})


def kept_trades(trades: DataFrame) -> DataFrame:
    """Valid rows with something bought or sold."""
    return valid_trades(trades).where("valid and (buy > 0 or sell > 0)").drop("valid")


def exclude_securities(df: DataFrame, code: str, keywords: list[str]) -> DataFrame:
    """Without codes from ``00`` and rows in which any column holds a keyword."""
    cells = F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns))
    return df.where(~F.col(code).cast("string").startswith("00") & ~cells.rlike("|".join(keywords)))


def compact_daily(trades: DataFrame, of_code: tuple[str, ...] = ()) -> DataFrame:
    """One row per (code, broker, day) from (code, broker, day, name, price, buy, sell): quantities, rounded amounts, nets.

    ``of_code`` are columns that the code alone decides; they stay beside it.
    """
    money = lambda q: F.bround(F.col("price") * F.col(q)).cast("bigint")
    sums = trades.groupBy("code", "broker", "day", *of_code).agg(F.max("name").alias("name"), F.sum("buy").alias("buy_qty"), F.sum("sell").alias("sell_qty"), F.sum(money("buy")).alias("buy_amt"), F.sum(money("sell")).alias("sell_amt"))
    return sums.withColumns({"net_qty": F.col("buy_qty") - F.col("sell_qty"), "net_amt": F.col("buy_amt") - F.col("sell_amt")})


def representative_text(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Most frequent text per key, then the shortest, then the first in order."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(col, F.struct(-F.col("_n"), F.length(col), F.col(col))).alias(col))


def build_events(facts: DataFrame, min_single: float, bounds: tuple[float, ...], matched: Column | None = None, parts: int | None = None) -> DataFrame:
    """Buying events per (broker, target, day) from (broker, target, day, code, buy_qty, buy_amt, net_qty).

    ``matched`` restricts the rows (call type, matched identity).  An event needs one instrument of ``min_single`` or more;
    its class goes by its total amount.  Lots are kept as an array ordered by code.  Rows travel once, to ``parts`` partitions of whole events.
    """
    rows = facts.where(F.col("buy_qty") > 0) if matched is None else facts.where(matched & (F.col("buy_qty") > 0))
    rows = dealt(rows.select("broker", "target", "day", "code", "buy_qty", "buy_amt", "net_qty"), parts, "broker", "target", "day")
    lots = rows.groupBy("broker", "target", "day", "code").agg(F.sum("buy_qty").alias("qty"), F.sum("buy_amt").alias("amount"), F.sum("net_qty").alias("net"))
    most = F.max("amount").over(Window.partitionBy("broker", "target", "day"))
    lots = lots.withColumn("_most", most).where(F.col("_most") >= min_single)  # before they are gathered
    events = lots.groupBy("broker", "target", "day").agg(F.sum("amount").alias("amount"), F.sum("qty").alias("qty"), F.sum("net").alias("net_qty"), F.array_sort(F.collect_list(F.struct(F.col("code"), F.col("qty"), F.col("amount")))).alias("lots"))
    return events.withColumns({"event": amount_class(F.col("amount"), bounds), "event_id": F.concat_ws("|", "broker", "target", "day")})


def sale_rows(facts: DataFrame) -> DataFrame:
    """Rows with something sold, of any type, per (broker, code, day)."""
    return facts.where("sell_qty > 0").groupBy("broker", "code", "day").agg(F.sum("sell_qty").alias("sell_qty"), F.sum("sell_amt").alias("sell_amt"))


def instrument_rows(df: DataFrame, code: str) -> DataFrame:
    return df.where(is_instrument_code(F.col(code).cast("string")))


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(keys).distinct()


def union_events(tables: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Union of event tables of different column names: each comes with {wanted name: its column}; missing ones are null."""
    shaped = [df.select(*(F.col(old).alias(new) for new, old in names.items())) for df, names in tables]
    out = shaped[0]
    for df in shaped[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def window_flows(facts: DataFrame, n_days: int) -> DataFrame:
    """Flows per (target, broker) over the last ``n_days`` trading days of ``facts``."""
    days = facts.select("day").distinct().orderBy(F.desc("day")).limit(n_days)
    recent = facts.join(F.broadcast(days), "day", "left_semi")
    return recent.groupBy("target", "broker").agg(F.sum("buy_amt").alias("buy_amt"), F.sum("sell_amt").alias("sell_amt"), F.sum("net_amt").alias("net_amt"), F.countDistinct("day").alias("days"))


def stock_master(info: DataFrame, code: str, name: str, version: str) -> DataFrame:
    """Latest name per code."""
    return info.groupBy(code).agg(F.max_by(name, F.struct(F.col(version), F.col(name))).alias(name))


def names_by_code(info: DataFrame, code: str, name: str, seq: str) -> DataFrame:
    """Distinct names per code in first-seen order."""
    first = info.groupBy(code, name).agg(F.min(seq).alias("_seq"))
    ordered = F.array_sort(F.collect_list(F.struct("_seq", F.col(name).alias("n"))))
    return first.groupBy(code).agg(F.transform(ordered, lambda x: x["n"]).alias("names"))


def reprocess_days(calendar: DataFrame, day_status: DataFrame, late: int = 5) -> DataFrame:
    """(day, priority) to run again: failed days first (0), days never seen (1), then the last ``late`` expected days that were empty (2)."""
    recent = calendar.orderBy(F.desc("day")).limit(late).withColumn("_recent", F.lit(True))
    joined = calendar.join(day_status, "day", "left").join(recent, "day", "left")
    rank = F.when(F.col("status") == "failed", 0).when(F.col("status").isNull(), 1).when((F.col("status") == "empty") & F.col("_recent"), 2)
    return joined.select("day", rank.alias("priority")).where("priority is not null")


def unprocessed_days(calendar: DataFrame, day_status: DataFrame) -> DataFrame:
    return calendar.select("day").join(day_status.where(F.col("status").isin("success", "failed", "empty")), "day", "left_anti")


def expected_days(calendar: DataFrame, start: str, today: str) -> DataFrame:
    return calendar.where(F.col("day").between(F.lit(start).cast("date"), F.lit(today).cast("date"))).select("day").distinct()


