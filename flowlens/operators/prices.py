"""Price series: clean-up, moving averages, market states, calendar completeness, last closes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LOW_NAMES, POSITION_NAMES, bits_code, low_level, named, settlement_value, slope

WINDOWS = (5, 10, 20, 60, 120, 240)
#: Low levels 1 to 4: below all three short averages, then also below each long one.
LOWS = ((5, 10, 20), 60, 120, 240)


def clean_prices(df: DataFrame, version: str, allow_zero: bool = False) -> DataFrame:
    """(series, date, close): bad or non-positive closes dropped (0 may be allowed); the last version of a day wins."""
    close = F.col("close").cast("string").try_cast("double")
    good = df.withColumn("close", close).where(F.col("close") >= 0 if allow_zero else F.col("close") > 0)
    return good.groupBy("series", "date").agg(F.max_by("close", F.struct(F.col(version), F.col("close"))).alias("close"))


def moving_averages(prices: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """ma<n> of each series; null until ``n`` rows are there."""
    order = Window.partitionBy("series").orderBy("date")
    full = lambda n: order.rowsBetween(1 - n, 0)
    return prices.withColumns({f"ma{n}": F.when(F.count("close").over(full(n)) == n, F.avg("close").over(full(n))) for n in windows})


def price_lags(features: DataFrame, windows: tuple[int, ...] = (5, 10, 20), back: int = 5) -> DataFrame:
    """prev_close, prev_ma<n>, and the last window's average ``back`` rows ago."""
    order = Window.partitionBy("series").orderBy("date")
    lags = {"prev_close": F.lag("close").over(order)} | {f"prev_ma{n}": F.lag(f"ma{n}").over(order) for n in windows}
    return features.withColumns(lags | {f"ma{windows[-1]}_back": F.lag(f"ma{windows[-1]}", back).over(order)})


def ma_states(features: DataFrame, windows: tuple[int, ...] = (5, 10, 20), lows: tuple[int | tuple[int, ...], ...] = LOWS) -> DataFrame:
    """above, below, crossings, alignments, position code, low level, slope; ties are neither above nor below.

    A level of ``lows`` may name several windows that all count; windows of ``lows`` beyond ``windows`` get a below of their own.
    """
    ma = [F.col(f"ma{n}") for n in windows]
    close, prev = F.col("close"), F.col("prev_close")
    cols: dict[str, Column] = {}
    for n in windows:
        cols |= {f"above{n}": close > F.col(f"ma{n}"), f"below{n}": close < F.col(f"ma{n}"), f"up{n}": (close > F.col(f"ma{n}")) & (prev <= F.col(f"prev_ma{n}")), f"down{n}": (close < F.col(f"ma{n}")) & (prev >= F.col(f"prev_ma{n}"))}
    levels = [(x,) if isinstance(x, int) else x for x in lows]
    cols |= {f"below{n}": close < F.col(f"ma{n}") for level in levels for n in level if n not in windows}
    pairs = list(zip(ma, ma[1:], strict=False))
    cols |= {"bull": reduce(lambda a, b: a & b, [x > y for x, y in pairs]), "bear": reduce(lambda a, b: a & b, [x < y for x, y in pairs])}
    cols |= {"position": bits_code(*(close > m for m in ma)), "low": low_level(*(reduce(lambda a, b: a & b, [close < F.col(f"ma{n}") for n in level]) for level in levels)), "slope": slope(ma[-1], F.col(f"ma{windows[-1]}_back"))}
    return features.withColumns(cols)


def state_names(states: DataFrame) -> DataFrame:
    """``states`` with the names of their position and low level."""
    return states.withColumns({"position_name": named(F.col("position"), POSITION_NAMES), "low_name": named(F.col("low"), LOW_NAMES)})


def attach_price_features(events: DataFrame, features: DataFrame) -> DataFrame:
    """Events (series, day) with the features of exactly that day; never filled from another day."""
    out = events.join(features.withColumnRenamed("date", "day"), ["series", "day"], "left")
    return out.withColumn("ma_status", F.when(F.col("close").isNull(), "Missing: no price").otherwise("OK"))


def calendar_complete(series_days: DataFrame, prices: DataFrame, calendar: DataFrame, n: int = 240, shown: int = 5) -> DataFrame:
    """(series, day, status): whether each of the last ``n`` market days up to the event day has a price; else which are missing."""
    pos = calendar.select("date").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("date")) - 1).cast("bigint"))  # one row a day
    order = Window.partitionBy("series").orderBy("pos")
    there = prices.select("series", "date").distinct().join(pos, "date").select("series", "pos", F.lit(True).alias("has"))
    # The days without a price right before each priced one; neighbours suffice, so no series meets the whole calendar.
    there = there.withColumn("after", F.coalesce(F.lag("pos").over(order), F.lit(-1)))
    asked = series_days.select("series", F.col("day").alias("date")).distinct().join(pos, "date", "left").withColumnRenamed("date", "day")
    both = there.withColumn("day", F.lit(None).cast("date")).unionByName(asked.where("pos is not null").select("series", "pos", F.lit(None).cast("boolean").alias("has"), F.lit(None).cast("bigint").alias("after"), "day"))
    last_n = order.rangeBetween(1 - n, 0)
    gap = F.when(F.col("has") & (F.col("after") < F.col("pos") - 1), F.struct((F.col("after") + 1).alias("a"), (F.col("pos") - 1).alias("z")))
    state = both.select("series", "day", "pos", F.count("has").over(last_n).alias("have"), F.collect_list(gap).over(last_n).alias("gaps"), F.coalesce(F.last(F.when(F.col("has"), F.col("pos")), ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0)), F.lit(-1)).alias("last")).where("day is not null")
    first = F.col("pos") - n + 1
    ends = F.concat(F.filter("gaps", lambda g: g["z"] >= first), F.filter(F.array(F.struct((F.col("last") + 1).alias("a"), F.col("pos").alias("z"))), lambda g: g["a"] <= g["z"]))
    out = F.slice(F.array_sort(F.flatten(F.transform(ends, lambda g: F.sequence(F.greatest(g["a"], first), g["z"])))), 1, shown)
    short = state.where((F.col("pos") >= n - 1) & (F.col("have") < n)).select("series", "day", F.explode(out).alias("pos")).join(pos, "pos")
    named_gaps = short.groupBy("series", "day").agg(F.array_join(F.array_sort(F.collect_list(F.date_format("date", "yyyy-MM-dd"))), ",").alias("gaps"))
    met = asked.join(named_gaps, ["series", "day"], "left")
    status = F.when(F.col("pos").isNull(), "Missing: not a market day").when(F.col("pos") < n - 1, "Missing: too early").when(F.col("gaps").isNotNull(), F.concat(F.lit("Missing: "), "gaps")).otherwise("OK")
    return met.select("series", "day", status.alias("status"))


def lookback_start(events: DataFrame, calendar: DataFrame, n: int) -> DataFrame:
    """(day, start): the ``n``-th market day before each event day, the first one if there are fewer."""
    order = Window.orderBy("date")
    back = calendar.select(F.col("date").alias("day"), F.coalesce(F.lag("date", n).over(order), F.first("date").over(order)).alias("start"))
    return events.select("day").distinct().join(back, "day")


def missing_days(prices: DataFrame, calendar: DataFrame, bounds: DataFrame) -> DataFrame:
    """(series, date): market days within a series' (start, end) that have no price."""
    keys = ["series", "start", "end"]
    inside = bounds.join(prices.select("series", "date"), "series").where(F.col("date").between(F.col("start"), F.col("end")))
    edges = bounds.withColumn("date", F.explode(F.array(F.date_sub("start", 1), F.date_add("end", 1))))
    # Days between neighbouring prices; those on the calendar are missing.
    points = inside.select(*keys, "date").unionByName(edges.select(*keys, "date")).withColumn("next", F.lead("date").over(Window.partitionBy(*keys).orderBy("date")))
    between = points.where(F.datediff("next", "date") > 1).select("series", F.explode(F.sequence(F.date_add("date", 1), F.date_sub("next", 1))).alias("date"))
    return between.join(calendar.select("date").distinct(), "date", "left_semi").select("series", "date").distinct()


def contiguous_ranges(missing: DataFrame, calendar: DataFrame) -> DataFrame:
    """(series, start, end, days): runs of missing days that are neighbours on the calendar."""
    pos = calendar.withColumn("pos", F.row_number().over(Window.orderBy("date")))
    runs = missing.join(pos, "date").withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("series").orderBy("pos")))
    return runs.groupBy("series", "run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days")).drop("run")


def sample_days(days: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced days, first and last among them."""
    ranked = days.select(F.row_number().over(Window.orderBy("date")).alias("r"), "date", F.count("*").over(Window.partitionBy()).alias("c"))
    steps = F.array(*(F.lit(k / max(n - 1, 1)) for k in range(n)))
    wanted = F.transform(steps, lambda f: F.floor(f * (F.col("c") - 1) + 0.5) + 1)
    return ranked.where(F.array_contains(wanted, F.col("r").cast("bigint"))).select("date")


def last_close(contracts: DataFrame, prices: DataFrame, valuation_day: str) -> DataFrame:
    """Contracts (series, list_date, end_date) with the last close between list_date and the earlier of end_date and the valuation day."""
    end = F.least(F.col("end_date"), F.lit(valuation_day).cast("date"))
    asked = contracts.select("series", "list_date", "end_date").distinct()
    # As of: a series' prices and ends in one order, each end takes the last price before it.
    price = F.struct("date", "close")
    rows = prices.select("series", F.col("date").alias("at"), F.lit(0).alias("kind"), price.alias("price"), F.lit(None).cast("date").alias("list_date"), F.lit(None).cast("date").alias("end_date"))
    rows = rows.unionByName(asked.select("series", end.alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["price"].dataType).alias("price"), "list_date", "end_date"))
    upto = Window.partitionBy("series").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("price", F.last("price", ignorenulls=True).over(upto)).where((F.col("kind") == 1) & (F.col("price.date") >= F.col("list_date")))
    best = met.select("series", "list_date", "end_date", F.col("price.close").alias("last_close"), F.col("price.date").alias("close_day"))
    return contracts.join(best, ["series", "list_date", "end_date"], "left")


#: What a lot's value rests on, beside its ``remaining``.
LOT_TERMS = ("end_date", "official", "recorded", "kind", "strike", "settle", "ratio", "last_close", "close_day")


def recognise(events: DataFrame, lots: DataFrame | None, valuation_day: str, months: int = 2, tax: float = 0.001) -> DataFrame:
    """Recognised value, return, day and status of events.

    events: event_id, day, status, amount, revenue, ret, exit_day; lots (remaining ones): event_id, remaining, end_date, recorded, kind, strike,
    settle, ratio, last_close, close_day, and official (whether the contract is of the official source; so if there is no such column).  A closed event
    keeps its outcome; a younger one than ``months`` is pending; of an older one each lot is settled, lapses or is marked at its last close.  A lot without
    a contract (end_date), one that has ended without an official contract or with a record that lacks a price or ratio, and one
    without the close that it needs make the event fail.  Without ``lots`` what remains of an event is one lot, whose columns are the event's own; nothing
    is joined then, and the lot's terms don't come out.
    """
    v = F.lit(valuation_day).cast("date")
    ended = v >= F.col("end_date")
    official = F.coalesce(F.col("official"), F.lit(False)) if "official" in (events if lots is None else lots).columns else F.lit(True)
    paid = settlement_value(*(F.col(c) for c in ("kind", "strike", "settle", "ratio")), tax, F.col("recorded"))
    unit = F.when(F.col("end_date").isNull() | (ended & ~official), F.lit(None)).when(ended, paid).otherwise(F.when(~F.isnan("last_close"), F.col("last_close")))
    reason = F.when(ended & F.col("recorded"), "settled").when(ended, "lapsed").otherwise("market")
    value_day = F.when(ended, F.col("end_date")).otherwise(v)
    if lots is None:
        left = lambda c: F.when(F.col("remaining") > 0, c)
        met = events.withColumns({"value": left(F.col("remaining") * unit), "bad": left(unit.isNull()), "reasons": left(F.array(reason)), "value_day": left(value_day)}).drop(*LOT_TERMS)
    else:
        valued = lots.select("event_id", (F.col("remaining") * unit).alias("value"), unit.isNull().alias("bad"), reason.alias("reason"), value_day.alias("value_day"))
        sums = valued.groupBy("event_id").agg(F.sum("value").alias("value"), F.max("bad").alias("bad"), F.collect_set("reason").alias("reasons"), F.max("value_day").alias("value_day"))
        met = events.join(sums, "event_id", "left")
    due = v >= F.add_months("day", months)
    market = F.array_contains("reasons", "market")
    status = (
        F.when(F.col("status") == "closed", "fifo closed").when(~due, "pending").when(F.col("reasons").isNull() | F.col("bad"), "failed")
        .when((F.size("reasons") == 1) & F.array_contains("reasons", "lapsed"), "lapsed").when(market, "market").otherwise("settled")
    )
    met = met.withColumn("recog_status", status)
    valued_now = F.col("recog_status").isin("lapsed", "market", "settled")
    ret = F.when(F.col("recog_status") == "fifo closed", F.col("ret")).when(valued_now, F.floor((F.col("revenue") + F.col("value") - F.col("amount")) / F.col("amount") * 10000 + 0.5) / 100)
    day = F.when(F.col("recog_status") == "fifo closed", F.col("exit_day")).when(valued_now, F.when(market, v).otherwise(F.col("value_day")))
    return met.withColumns({"recog_ret": ret, "recog_day": day, "recog_hold": F.datediff(day, F.col("day"))}).drop("value", "bad", "reasons", "value_day")
