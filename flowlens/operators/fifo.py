"""First-in-first-out matching of sales to bought lots as an overlap of running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trades import dealt


def fifo_match(lots: DataFrame, sales: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Allocations (keys, event_id, lot_no, sale_day, qty, revenue, cost).

    lots: keys, event_id, event_day, lot_no, qty, amount, and ``open`` if part of a lot has been sold before (``open_lots``);
    sales: keys, day, sell_qty, sell_amt, one row per key and day.
    The oldest lots go first; a sale only reaches lots of earlier days, and what it sells beyond them is dropped.
    Per key, lots cover the intervals between their running sums.  With A the lots before a sale and S the sold so far, the
    matched so far is S plus the running minimum of min(0, A - S), so that each sale covers an interval as well.

    Lots and sales travel once, together, to ``parts`` partitions.  Lots that no sale reaches go no further.
    """
    lots = lots if "open" in lots.columns else lots.withColumn("open", F.col("qty"))
    none = F.lit(0).cast("bigint")
    both = sales.select(*keys, "day", F.lit(0).alias("_kind"), "sell_qty", "sell_amt", none.alias("open")).unionByName(
        lots.select(*keys, F.col("event_day").alias("day"), F.lit(1).alias("_kind"), none.alias("sell_qty"), none.alias("sell_amt"), "open", "event_id", "lot_no", "qty", "amount"), allowMissingColumns=True
    )
    order = Window.partitionBy(*keys).orderBy("day", "_kind", "event_id", "lot_no")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    is_sale = F.col("_kind") == 0
    run = dealt(both, parts, *keys).withColumns({"_a": F.sum("open").over(upto), "_s": F.sum("sell_qty").over(upto)})
    matched = run.withColumn("_m", F.when(is_sale, F.col("_s") + F.least(F.lit(0), F.min(F.when(is_sale, F.col("_a") - F.col("_s"))).over(upto))))
    matched = matched.withColumn("_from", F.coalesce(F.last("_m", ignorenulls=True).over(before), F.lit(0)))
    reached = F.coalesce(F.max("_m").over(Window.partitionBy(*keys)), F.lit(0))
    matched = matched.withColumn("_reached", reached).where("(_kind = 0 and _m > _from) or (_kind = 1 and _a - open < _reached)")
    # Lots and sales each cover their key's units without a gap: in one order, each start opens the part of the last lot and the last sale.
    lot = F.struct("event_id", "lot_no", F.col("_a").alias("hi"), "amount", "qty")
    sale = F.struct(F.col("day").alias("sale_day"), "sell_qty", "sell_amt", "_m")
    starts = matched.select(*keys, F.when(is_sale, F.col("_from")).otherwise(F.col("_a") - F.col("open")).alias("_at"), F.when(is_sale, F.col("_m")).otherwise(F.col("_a")).alias("_end"), F.when(~is_sale, lot).alias("_lot"), F.when(is_sale, sale).alias("_sale"))
    by_start = Window.partitionBy(*keys).orderBy("_at", "_end")
    upto = by_start.rowsBetween(Window.unboundedPreceding, 0)
    opened = starts.select(*keys, "_at", F.lead("_at").over(by_start).alias("_next"), F.last("_lot", ignorenulls=True).over(upto).alias("_lot"), F.last("_sale", ignorenulls=True).over(upto).alias("_sale"))
    part = F.least("_next", "_lot.hi", "_sale._m") - F.col("_at")
    met = opened.withColumn("_part", part).where("_part > 0 and _lot is not null and _sale is not null").select(*keys, "_lot.*", "_sale.*", "_part")
    part = F.col("_part")
    return met.select(*keys, "event_id", "lot_no", "sale_day", part.alias("got"), (part * F.col("sell_amt") / F.col("sell_qty")).alias("revenue"), (part * F.col("amount") / F.col("qty")).alias("cost")).withColumnRenamed("got", "qty")


def open_lots(lots: DataFrame, allocations: DataFrame) -> DataFrame:
    """``lots`` that ``allocations`` leave something of, with what is ``open``.

    All that later sales depend on: matching them to these lots and newer ones gives what one run over the whole history gives for them.
    """
    before = F.col("open") if "open" in lots.columns else F.col("qty")
    sold = allocations.groupBy("event_id", "lot_no").agg(F.sum("qty").alias("_sold"))
    return lots.join(sold, ["event_id", "lot_no"], "left").withColumn("open", before - F.coalesce("_sold", F.lit(0))).where("open > 0").drop("_sold")


def with_remaining(events: DataFrame, allocations: DataFrame) -> DataFrame:
    """``events`` whose ``lots`` have ``remaining`` after ``allocations``; lots that have it already go on from there."""
    sold = allocations.groupBy("event_id", "lot_no").agg(F.sum("qty").alias("q")).groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("lot_no", "q"))).alias("_sold"))
    has = "remaining" in events.schema["lots"].dataType.elementType.names

    def lot(x: Column) -> Column:
        gone = F.coalesce(F.element_at(F.col("_sold"), x["code"]), F.lit(0))
        return x.withField("remaining", (x["remaining"] if has else x["qty"]) - gone)

    return events.join(sold, "event_id", "left").withColumn("lots", F.transform("lots", lot)).drop("_sold")


def exit_days(events: DataFrame, allocations: DataFrame) -> DataFrame:
    """(event_id, first_reduce, exit_day): the first sale of an event's lots, and the day on which nothing is left."""
    daily = allocations.groupBy("event_id", "sale_day").agg(F.sum("qty").alias("q"))
    run = daily.withColumn("done", F.sum("q").over(Window.partitionBy("event_id").orderBy("sale_day")))
    sums = run.join(events.select("event_id", F.col("qty").alias("orig")), "event_id")
    return sums.groupBy("event_id").agg(F.min("sale_day").alias("first_reduce"), F.min(F.when(F.col("done") >= F.col("orig"), F.col("sale_day"))).alias("exit_day"))


def event_outcomes(events: DataFrame, allocations: DataFrame, parts: int | None = None) -> DataFrame:
    """Events (event_id, day, qty, amount, ...) with sold, remaining, revenue, cost, ret, hold_days and status, in ``parts`` partitions."""
    events = dealt(events, parts, "event_id")
    sums = allocations.groupBy("event_id").agg(F.sum("qty").alias("sold"), F.sum("revenue").alias("revenue"), F.sum("cost").alias("sold_cost"), F.min("sale_day").alias("first_reduce"), F.max("sale_day").alias("_last"))
    # No more is matched than was bought: on the last day of a sale nothing is left, or there is no exit.
    out = events.join(sums, "event_id", "left").withColumn("exit_day", F.when(F.col("sold") >= F.col("qty"), F.col("_last"))).drop("_last")
    out = out.withColumns({"sold": F.coalesce("sold", F.lit(0).cast("bigint")), "revenue": F.coalesce("revenue", F.lit(0.0)), "sold_cost": F.coalesce("sold_cost", F.lit(0.0))})
    out = out.withColumn("remaining", F.col("qty") - F.col("sold"))
    status = F.when(F.col("remaining") == 0, "closed").when(F.col("sold") > 0, "reduced").otherwise("open")
    ret = F.when(F.col("sold_cost") > 0, F.bround((F.col("revenue") - F.col("sold_cost")) / F.col("sold_cost") * 100, 2))
    return out.withColumns({"status": status, "ret": ret, "hold_days": F.datediff(F.coalesce("exit_day", "first_reduce"), F.col("day"))})
