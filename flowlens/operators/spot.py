"""Spot-equity branch rankings from a feed of buy and sell lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .report import top_n
from .stats import rounded


def project_top(raw: DataFrame, per_side: int = 15) -> DataFrame:
    """Feed rows from (stock, position, shares bought and sold, close, volume): list side and rank, lots, amounts, turnover."""
    buy_side = F.col("pos") < per_side
    net = F.col("buy_shares") - F.col("sell_shares")
    return raw.select("stock", "day", "broker", F.when(buy_side, "buy").otherwise("sell").alias("list"), F.when(buy_side, F.col("pos") + 1).otherwise(F.col("pos") - per_side + 1).alias("list_rank"), (net / 1000).alias("net_lots"), (F.col("buy_shares") * F.col("close")).alias("buy_amt"), (F.col("sell_shares") * F.col("close")).alias("sell_amt"), (net * F.col("close")).alias("net_amt"), rounded(F.abs(net) / F.nullif(F.col("volume"), F.lit(0)) * 100, 4).alias("turnover"), F.when(net > 0, "buy").when(net < 0, "sell").otherwise("flat").alias("side"))


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Union in which the last version of each key stays."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")


def rankings(hits: DataFrame, n: int, tie: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Buy, sell and absolute rankings by net amount."""
    net = F.col("net_amt")
    return top_n(hits.where(net > 0), [], [net.desc(), F.col(tie)], n), top_n(hits.where(net < 0), [], [net.asc(), F.col(tie)], n), top_n(hits, [], [F.abs(net).desc(), F.col(tie)], n)


def branch_summary(hits: DataFrame, measures: list[str]) -> DataFrame:
    return hits.groupBy("broker").agg(*(F.sum(c).alias(c) for c in measures), F.count("*").alias("n"))


def unique_text(col: str, seq: str) -> Column:
    """Distinct texts joined in first-seen order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(col)))), lambda x: x[col])
    return F.array_join(F.array_distinct(ordered), "、")


def first_text(col: str, seq: str) -> Column:
    blank = F.trim(F.col(col)) == ""
    return F.min_by(F.when(~blank, F.col(col)), F.when(~blank & F.col(col).isNotNull(), F.col(seq)))


def tracked_stock_top(hits: DataFrame, n: int) -> DataFrame:
    """Stocks over all tracked branches, first ``n`` of each direction, with their branches in order of broker."""
    sums = hits.groupBy("stock").agg(F.sum("net_amt").alias("net_amt"), F.countDistinct("broker").alias("n_brokers"), F.array_join(F.transform(F.array_sort(F.collect_set("broker")), lambda b: b.cast("string")), "、").alias("brokers"))
    return concat_sides(*sides(sums, [], n))


def sides(sums: DataFrame, keys: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    net = F.col("net_amt")
    return top_n(sums.where(net > 0), keys, [net.desc(), F.col("stock")], n), top_n(sums.where(net < 0), keys, [net.asc(), F.col("stock")], n)


def concat_sides(buy: DataFrame, sell: DataFrame) -> DataFrame:
    return buy.withColumn("direction", F.lit("buy")).unionByName(sell.withColumn("direction", F.lit("sell")))


def branch_stock_top(hits: DataFrame, n: int) -> DataFrame:
    """First ``n`` stocks of each branch and direction."""
    return concat_sides(*sides(hits.groupBy("broker", "stock").agg(F.sum("net_amt").alias("net_amt")), ["broker"], n))


def market_stock_buy_top(feed: DataFrame, n: int) -> DataFrame:
    """All branches: stocks by positive net of the buy lists."""
    sums = feed.where((F.col("list") == "buy") & (F.col("net_amt") > 0)).groupBy("stock").agg(F.sum("net_amt").alias("net_amt"))
    return top_n(sums, [], [F.desc("net_amt"), F.col("stock")], n)


def run_info(hits: DataFrame, feed: DataFrame) -> DataFrame:
    """(item, value) rows about a run."""
    h = hits.agg(F.count("*").alias("n"), F.countDistinct("broker").alias("b"))
    f = feed.agg(F.count("*").alias("n"), F.countDistinct("stock").alias("s"))
    return h.select(F.expr("stack(2, 'hits', n, 'brokers', b) as (item, value)")).unionByName(f.select(F.expr("stack(2, 'feed rows', n, 'stocks', s) as (item, value)")))


def ordered_feed(df: DataFrame) -> DataFrame:
    """Feed positions per (stock, day) when the source has none: buys from the most bought, then sells from the most sold."""
    order = Window.partitionBy("stock", "day").orderBy(F.desc("net"), "broker")
    return df.withColumn("pos", F.row_number().over(order) - 1)
