"""Win rates, returns and holding times of events by branch, class, condition and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sample_grade
from .trades import dealt

CODES = ("ALL", "A", "B", "C", "D", "E")


def rounded(x: Column, places: int) -> Column:
    """Rounded half up; money and returns are added up as integers before, so that the order of rows can't show."""
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


def even(x: Column, places: int) -> Column:
    """Rounded half to even after scaling in double precision, as numpy does it."""
    return F.rint(x * 10.0**places) / 10.0**places


def cents(x: Column) -> Column:
    """A figure of two decimals as an integer."""
    return F.floor(x * 100 + 0.5).cast("bigint")


def outcome_aggregates() -> list[Column]:
    """The aggregates of an outcome summary over (status, recog_status, ret, hold_days, amount, day)."""
    done = F.col("ret").isNotNull()
    loss, tie, win = (done & x for x in (F.col("ret") < 0, F.col("ret") == 0, F.col("ret") > 0))
    return [
        F.count("event_id").alias("n_events"), F.count_if(F.col("status") == "closed").alias("n_closed"), F.count_if(F.col("status") == "reduced").alias("n_reduced"), F.count_if(F.col("status") == "open").alias("n_open"),
        F.count_if(done).alias("n_resolved"), F.count_if(F.col("event_id").isNotNull() & ~done).alias("n_pending"), F.count_if(win).alias("n_win"), F.count_if(loss).alias("n_loss"), F.count_if(tie).alias("n_tie"),
        F.bround(F.count_if(win) * 100 / F.nullif(F.count_if(done), F.lit(0)), 2).alias("win_rate"),
        even(F.avg(F.when(done, F.col("hold_days"))), 2).alias("mean_hold"), F.median(F.when(done, F.col("hold_days"))).alias("median_hold"),
        rounded(F.sum(cents(F.col("ret"))) / F.nullif(F.count("ret"), F.lit(0)) / 100, 4).alias("mean_ret"), F.bround(F.median("ret"), 4).alias("median_ret"), rounded(F.sum(F.col("amount") * cents(F.col("ret"))) / F.nullif(F.sum(F.when(done, F.col("amount"))), F.lit(0)) / 100, 4).alias("weighted_ret"),
        F.max("ret").alias("max_ret"), F.min("ret").alias("min_ret"), F.sum("amount").alias("amount"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    ]


def summarise_outcomes(events: DataFrame, keys: list[str]) -> DataFrame:
    out = events.groupBy(*keys).agg(*outcome_aggregates())
    return out.withColumn("grade", sample_grade(F.col("n_resolved")))


def summarise_recognised(events: DataFrame, keys: list[str]) -> DataFrame:
    """The whole summary of events (event_id, day, status, amount, total_cost, recog_status, recog_ret, recog_hold) by ``keys``.

    Resolved are events that are not pending and have a recognised return; P&L is their cost times it.
    """
    done = F.col("event_id").isNotNull() & (F.col("recog_status") != "pending") & F.col("recog_ret").isNotNull()
    ret, cost = F.when(done, F.col("recog_ret")), F.when(done, F.coalesce("total_cost", F.lit(0)))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    hold = F.when(done & (F.col("recog_status") != "pending"), F.col("recog_hold"))
    closed = F.col("status") == "closed"
    pnl = F.sum(cost * cents(ret)) / 10_000
    out = events.groupBy(*keys).agg(
        F.count("event_id").alias("n_events"), count(closed).alias("n_closed"), (F.count("event_id") - count(closed)).alias("n_not_closed"), count(done).alias("n_resolved"),
        count(done & (F.col("recog_status") == "fifo closed")).alias("n_fifo"), count(done & (F.col("recog_status") == "market")).alias("n_market"), count(done & F.col("recog_status").isin("settled", "lapsed")).alias("n_settled"), (F.count("event_id") - count(done)).alias("n_pending"),
        count(ret > 0).alias("n_win"), count(ret < 0).alias("n_loss"), count(ret == 0).alias("n_tie"), F.bround(count(ret > 0) * 100 / F.nullif(count(done), F.lit(0)), 2).alias("win_rate"),
        even(F.avg(hold), 2).alias("mean_hold"), even(F.median(hold), 2).alias("median_hold"), rounded(F.sum(cents(ret)) / F.nullif(F.count(ret), F.lit(0)) / 100, 2).alias("mean_ret"), even(F.median(ret), 2).alias("median_ret"),
        rounded(pnl / F.nullif(F.sum(cost), F.lit(0)) * 100, 2).alias("weighted_ret"), F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.coalesce(F.sum(cost), F.lit(0)).alias("resolved_amount"), F.coalesce(F.sum(F.when(closed, F.col("amount"))), F.lit(0)).alias("closed_amount"),
        F.coalesce(rounded(pnl, 0).cast("bigint"), F.lit(0)).alias("pnl"), F.max(ret).alias("max_ret"), F.min(ret).alias("min_ret"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )
    return out.withColumn("grade", sample_grade(F.col("n_resolved")))


def _best(stats: DataFrame, label: str, name: str, min_n: int, broker: str) -> DataFrame:
    """(broker, name): the label of the best win rate among samples of ``min_n``, then of more samples and events, with its figures as text."""
    order = Window.partitionBy(broker).orderBy(F.desc("win_rate"), F.desc("n_resolved"), F.desc("n_events"), label)
    text = F.concat(F.col(label), F.lit("（勝率"), F.format_string("%.2f", "win_rate"), F.lit("%，勝敗樣本"), F.col("n_resolved").cast("string"), F.lit("筆）"))
    best = stats.where((F.col("code") == "ALL") & (F.col("n_resolved") >= min_n) & F.col("win_rate").isNotNull()).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.select(broker, text.alias(name))


def profiles(events: DataFrame, cond: DataFrame, pos: DataFrame, min_n: int = 15, broker: str = "broker") -> DataFrame:
    """Per branch: its summary, most frequent position (of equal ones the first code) and best condition and position; texts say so where there is none."""
    base = summarise_recognised(events, [broker]).select(broker, "first_day", "last_day", "n_events", "n_closed", "n_not_closed", "n_resolved", "n_market", "n_settled", "n_pending", "mean_hold", "median_hold", "mean_ret", "median_ret", "weighted_ret")
    counts = events.where("position is not null").groupBy(broker, "position").agg(F.count("*").alias("_n"))
    common = counts.groupBy(broker).agg(F.min_by("position", F.struct(-F.col("_n"), "position")).alias("most_position"))
    out = base.join(common, broker, "left").join(_best(cond, "condition", "best_condition", min_n, broker), broker, "left").join(_best(pos, "position", "best_position", min_n, broker), broker, "left")
    return out.fillna({"most_position": "Missing", "best_condition": "樣本不足，暫不判定", "best_position": "樣本不足，暫不判定"})


def with_codes(events: DataFrame) -> DataFrame:
    """Each event once as ALL and once as its class."""
    return events.withColumn("code", F.explode(F.array(F.lit("ALL"), F.col("event")))).where("code is not null")


def class_stats(events: DataFrame, keys: list[str]) -> DataFrame:
    """Summary by ``keys`` and code (ALL, A-E); combinations without events are absent."""
    return summarise_outcomes(dealt(_summed(with_codes(events), [*keys, "code"]), None, *keys, "code"), [*keys, "code"])


def _summed(events: DataFrame, keys: list[str]) -> DataFrame:
    """What an outcome summary by ``keys`` needs of its events; they travel as they are, since a state with medians is longer than a row and a task has few rows of a group."""
    return events.select(*dict.fromkeys([*keys, "event_id", "status", "ret", "hold_days", "amount", "day"]))


def condition_stats(events: DataFrame, conditions: dict[str, Column], broker: str = "broker") -> DataFrame:
    """Summary by branch, condition and code on the dense grid, in one pass over the events.

    Conditions overlap; an event counts once for each that holds.  The grid comes from the branches alone.  An event travels once as ALL and once as its
    class, and meets its conditions where its branch and code are summed up.
    """
    held = F.array(*(F.when(c, F.lit(k)).cast("smallint") for k, c in enumerate(conditions.values())))
    rows = dealt(_summed(with_codes(events.withColumn("_held", held)), [broker, "code", "_held"]), None, broker, "code")
    names = F.array(*map(F.lit, conditions))
    rows = rows.withColumn("_k", F.explode("_held")).where("_k is not null").drop("_held")
    grid = events.select(broker).distinct().withColumn("condition", F.explode(F.array(*map(F.lit, conditions)))).withColumn("code", F.explode(F.array(*map(F.lit, CODES))))
    found = summarise_outcomes(rows, [broker, "_k", "code"]).withColumn("condition", F.get(names, F.col("_k"))).drop("_k")
    return dense(grid, found, [broker, "condition", "code"])


def position_stats(events: DataFrame, position: str, positions: list[str], broker: str = "broker") -> DataFrame:
    """Summary by branch, position code and code on the dense grid."""
    grid = events.select(broker).distinct().withColumn(position, F.explode(F.array(*map(F.lit, positions)))).withColumn("code", F.explode(F.array(*map(F.lit, CODES))))
    return dense(grid, summarise_outcomes(with_codes(events), [broker, position, "code"]), [broker, position, "code"])


def recognised_grid(events: DataFrame, label: str, held: Column, values: list[str], broker: str = "broker") -> DataFrame:
    """``summarise_recognised`` by branch, ``label`` (one row of an event for each entry of ``held``) and code, on the dense grid of ``values``."""
    needed = [broker, "code", "_held", "event_id", "day", "status", "amount", "total_cost", "recog_status", "recog_ret", "recog_hold"]
    rows = dealt(with_codes(events.withColumn("_held", held)).select(needed), None, broker, "code").withColumn(label, F.explode("_held")).drop("_held")
    grid = events.select(broker).distinct().withColumn(label, F.explode(F.array(*map(F.lit, values)))).withColumn("code", F.explode(F.array(*map(F.lit, CODES))))
    out = dense(grid, summarise_recognised(rows, [broker, label, "code"]), [broker, label, "code"])
    return out.fillna(0, ["amount", "resolved_amount", "closed_amount", "pnl"])


def dense(grid: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``stats`` for every row of ``grid``; counts are 0 and the rest null where there is none."""
    out = grid.join(stats, keys, "left")
    return out.fillna(0, [c for c in out.columns if c.startswith("n_")]).withColumn("grade", sample_grade(F.col("n_resolved")))


def branch_profiles(events: DataFrame, cond: DataFrame, min_n: int = 15, broker: str = "broker") -> DataFrame:
    """Per branch: events, P&L (returns missing count 0, their amounts too), and its best condition of ``min_n`` samples."""
    base = events.groupBy(broker).agg(F.count("*").alias("n_events"), rounded(F.sum(cents(F.coalesce("ret", F.lit(0.0))) * F.col("amount")) / F.nullif(F.sum(F.when(F.col("ret").isNotNull(), F.col("amount"))), F.lit(0)) / 100, 4).alias("profile_ret"))
    order = Window.partitionBy(broker).orderBy(F.desc("win_rate"), F.desc("n_resolved"), F.desc("n_events"), "condition")
    best = cond.where((F.col("code") == "ALL") & (F.col("n_resolved") >= min_n)).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return base.join(best.select(broker, F.col("condition").alias("best_condition"), F.col("win_rate").alias("best_win_rate")), broker, "left")


def integrity_report(facts: DataFrame, calendar: DataFrame, day_status: DataFrame, top: int = 10) -> DataFrame:
    """(item, value) rows: days, rows, missing days, and the most frequent reasons with the rest as one."""
    reasons = day_status.where("reason is not null").groupBy(F.split("reason", ":")[0].alias("reason")).agg(F.count("*").alias("n"))
    first = reasons.orderBy(F.desc("n"), "reason").limit(top)
    rest = reasons.join(F.broadcast(first.select("reason")), "reason", "left_anti").agg(F.lit("reason other").alias("item"), F.sum("n").alias("value")).where("value is not null")
    named = first.select(F.concat(F.lit("reason "), F.col("reason")).alias("item"), F.col("n").alias("value")).unionByName(rest)
    sums = facts.agg(F.count("*").alias("rows"), F.countDistinct("day").alias("days"), F.countDistinct("broker").alias("brokers"))
    counted = sums.select(F.expr("stack(3, 'rows', rows, 'days', days, 'brokers', brokers) as (item, value)"))
    missing = calendar.join(facts.select("day").distinct(), "day", "left_anti").agg(F.lit("missing days").alias("item"), F.count("*").alias("value"))
    return counted.unionByName(missing).unionByName(named)


def integrity_counts(day_status: DataFrame, calendar: DataFrame, events: DataFrame, top: int = 10) -> DataFrame:
    """(item, value) rows, values as text: the calendar's days by status, sums of rows, events by state, missing reasons and events per branch.

    day_status: day (once each), status (success, failed, empty or null), raw_rows, compact_rows, unique_rows, invalid_rows; calendar: day; events: day, broker, status,
    recog_status, ma_status, reason.  Reasons are cut at a colon and the less frequent ones are one item.  A history is complete if no day
    has failed or waits.
    """
    days = calendar.select("day").distinct().join(day_status, "day", "left")
    of = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    state = F.col("status")
    items = {
        "expected days": F.count("*"), "success days": of(state == "success"), "failed days": of(state == "failed"), "empty days": of(state == "empty"), "unprocessed days": of(state.isNull()),
        "complete": (of(state == "failed") + of(state.isNull()) == 0), "first day": F.min(F.when(state == "success", F.col("day"))), "last day": F.max(F.when(state == "success", F.col("day"))),
        **{c.replace("_", " "): F.coalesce(F.sum(c), F.lit(0)) for c in ("raw_rows", "compact_rows", "unique_rows", "invalid_rows")},
    }
    recog, ma = F.col("recog_status"), F.col("ma_status")
    more = {
        "events": F.count("*"), "states complete": of(ma == "OK"), "states missing": of(ma == "Missing"), "closed": of(state == "closed"), "not closed": F.count("*") - of(state == "closed"),
        "resolved": of(recog != "pending"), "pending": F.count("*") - of(recog != "pending"), "market": of(recog == "market"), "settled": of(recog.isin("settled", "lapsed")), "first event": F.min("day"), "last event": F.max("day"),
    }
    wide = lambda df, cols: df.agg(F.array(*(F.struct(F.lit(n).alias("item"), c.cast("string").alias("value")) for n, c in cols.items())).alias("x")).select(F.inline("x"))
    reason = F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("no reason"))
    counts = events.where(ma == "Missing").groupBy(F.split(reason, "[:：]")[0].alias("reason")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "reason").limit(top).withColumn("_top", F.lit(True))
    named = counts.join(F.broadcast(first.select("reason", "_top")), "reason", "left").groupBy(F.when(F.col("_top"), F.concat(F.lit("reason "), "reason")).otherwise("reason other").alias("item")).agg(F.sum("n").cast("string").alias("value"))
    branches = events.groupBy(F.concat(F.lit("events of "), F.col("broker").cast("string")).alias("item")).agg(F.count("*").cast("string").alias("value"))
    return wide(days, items).unionByName(wide(events, more)).unionByName(named).unionByName(branches)


def card_summary(top: DataFrame, amount: str, ret: str) -> DataFrame:
    """Totals of displayed rows: sum, weighted return, win rate."""
    return top.agg(F.count("*").alias("n"), F.sum(amount).alias("amount"), F.bround(F.sum(F.col(amount) * F.col(ret)) / F.nullif(F.sum(F.when(F.col(ret).isNotNull(), F.col(amount))), F.lit(0)), 4).alias("weighted_ret"), F.bround(F.count_if(F.col(ret) > 0) * 100 / F.nullif(F.count(ret), F.lit(0)), 2).alias("win_rate"))


def win_rate_table(stats: DataFrame, broker: str) -> DataFrame:
    """Kinds (A, total) side by side; of several scopes the one of highest priority, then of most filled fields, wins."""
    filled = sum(F.col(c).isNotNull().cast("int") for c in ("win_rate", "hold"))
    order = Window.partitionBy(broker, "kind").orderBy(F.desc("priority"), F.desc(filled), F.desc("n"))
    best = stats.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.groupBy(broker).pivot("kind", ["A", "total"]).agg(F.first("win_rate").alias("win_rate"), F.first("hold").alias("hold"), F.first("n").alias("n"))


def history_stats(stats: DataFrame, branches: DataFrame, broker: str) -> DataFrame:
    """Total-event history of each listed branch, with defaults for those without any."""
    total = stats.where("kind = 'total'").select(broker, "n", "win_rate", "hold")
    return branches.select(broker).distinct().join(total, broker, "left").fillna(0, ["n"])
