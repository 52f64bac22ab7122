"""Data-quality rules: each returns the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LOW_NAMES, amount_class, bits_code, low_level, named, result_tag


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks, in one pass; an unknown result counts as broken."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def implies(a: Column, b: Column) -> Column:
    return ~F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def check_outcomes(events: DataFrame) -> DataFrame:
    closed = F.col("status") == "closed"
    return violations(events, "event_id", {
        "status": F.col("status").isin("open", "reduced", "closed"),
        "closed needs exit, return and hold": implies(closed, F.col("exit_day").isNotNull() & F.col("ret").isNotNull() & F.col("hold_days").isNotNull()),
        "open has no exit": implies(~closed, F.col("exit_day").isNull()),
        "nothing sold, no return": implies(F.col("sold") == 0, F.col("ret").isNull()),
        "tag": F.col("tag") == result_tag(F.col("ret")) if "tag" in events.columns else F.lit(True),
    })


RECOGNISED = ("fifo closed", "market", "settled", "lapsed")


def check_recognised(events: DataFrame) -> DataFrame:
    """Recognised results (recog_status, recog_day, recog_ret, recog_hold, tag): known states, all figures and the return's tag if resolved, none if pending."""
    done, pending = F.col("recog_status").isin(*RECOGNISED), F.col("recog_status") == "pending"
    figures = F.col("recog_day").isNotNull() & F.col("recog_ret").isNotNull() & F.col("recog_hold").isNotNull() & F.col("tag").isNotNull()
    return violations(events, "event_id", {
        "recognised status": done | pending,
        "recognised needs day, return, hold and tag": implies(done, figures),
        "tag follows return": implies(done & F.col("recog_ret").isNotNull(), F.col("tag") == result_tag(F.col("recog_ret"))),
        "pending has no return or tag": implies(pending, F.col("recog_ret").isNull() & F.col("tag").isNull()),
    })


def check_event_frame(events: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """Unique ids, known classes, and classes that come out again from the amounts.

    With market states (``ma_status`` OK), position code, low level and its name have to come out again from the flags as well.
    """
    rules = {"class known": F.col("event").isin("A", "B", "C", "D", "E"), "class follows amount": F.col("event") == amount_class(F.col("amount"), bounds)}
    if "ma_status" in events.columns:
        ok = F.col("ma_status") == "OK"
        below = [F.col(f"below{n}") for n in (5, 10, 20, 60, 120, 240)]
        level = low_level(below[0] & below[1] & below[2], *below[3:])
        rules |= {"position follows flags": implies(ok, F.col("position") == bits_code(*(F.col(f"above{n}") for n in (5, 10, 20)))), "low level follows flags": implies(ok, F.col("low") == level), "low name follows level": implies(ok, F.col("low_name") == named(level, LOW_NAMES))}
    rules = violations(events, "event_id", rules)
    return rules.unionByName(check_unique(events, "event_id").select("event_id", F.lit("unique id").alias("rule")))


def check_additive(stats: DataFrame, key: str) -> DataFrame:
    n = lambda *names: reduce(lambda a, b: a + b, (F.col(f"n_{x}") for x in names))
    return violations(stats, key, {"win, loss and tie": n("win", "loss", "tie") == n("resolved"), "resolved and pending": n("resolved", "pending") == n("events"), "closed, reduced and open": n("closed", "reduced", "open") == n("events")})


def check_traceable(stats: DataFrame, again: DataFrame, keys: list[str], rel: float = 1e-12, abs_: float = 1e-9) -> DataFrame:
    """(keys, column) where published statistics differ from recomputed ones, or a key is on one side only."""
    columns = [c for c in again.columns if c not in keys]
    right = again.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"_{c}") for c in columns))
    both = stats.join(right, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "full")

    def same(c: str) -> Column:
        a, b = F.col(c), F.col(f"_{c}")
        if dict(again.dtypes)[c] in ("double", "float"):
            return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * rel + abs_, F.lit(False))
        return a.eqNullSafe(b)

    off = F.filter(F.array(*(F.when(~same(c), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return both.select(*(F.coalesce(k, f"_{k}").alias(k) for k in keys), F.explode(off).alias("column"))


def recompute(events: DataFrame, label: str, held: dict[str, Column], codes: list[str], broker: str = "broker") -> DataFrame:
    """Counts, rates and ranges of events by branch, ``label`` (the condition of ``held`` that filters them) and code ("ALL" or the event's), on the whole grid.

    To check published statistics against: each condition is a filter of its own, "ALL" a grouping set over the codes' sums, and sums are of ones and zeros.
    """
    kept = F.array(*(F.when(c, F.lit(name)) for name, c in held.items()))
    rows = events.select(broker, "event", "ret", "status", "amount", "day", kept.alias("_kept")).repartition(broker, "event").withColumn(label, F.explode("_kept")).where(F.col(label).isNotNull())
    ones = lambda c: F.sum(F.when(c, 1).otherwise(0))
    ret, status = F.col("ret"), F.col("status")
    counts = {"events": F.lit(True), "closed": status == "closed", "reduced": status == "reduced", "open": status == "open", "resolved": ret.isNotNull(), "pending": ret.isNull(), "win": ret > 0, "loss": ret < 0, "tie": ret == 0}
    each = rows.groupBy(broker, label, "event").agg(*(ones(c).alias(f"n_{k}") for k, c in counts.items()), F.sum("amount").alias("amount"), F.max(ret).alias("max_ret"), F.min(ret).alias("min_ret"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    again = {"max_ret": F.max, "min_ret": F.min, "first_day": F.min, "last_day": F.max}
    sums = each.groupingSets([[broker, label, "event"], [broker, label]], broker, label, "event").agg(*(again.get(c, F.sum)(c).alias(c) for c in each.columns if c not in (broker, label, "event")))
    rate = F.when(F.col("n_resolved") > 0, F.bround((F.lit(100).cast("decimal(20,0)") * F.col("n_win") / F.col("n_resolved")).cast("decimal(38,10)"), 2).cast("double"))
    sums = sums.withColumn("win_rate", rate).withColumn("code", F.coalesce("event", F.lit("ALL"))).drop("event")
    grid = events.select(broker).distinct().withColumn(label, F.explode(F.array(*map(F.lit, held)))).withColumn("code", F.explode(F.array(*map(F.lit, codes))))
    return grid.join(sums, [broker, label, "code"], "left").fillna(0, [f"n_{k}" for k in counts])


def check_unique(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def audit_days(compact: DataFrame, day_status: DataFrame) -> DataFrame:
    """(day, rule): saved days whose key isn't unique, or whose row count isn't the recorded one, to be run again."""
    twice = check_unique(compact, "code", "broker", "day").select("day", F.lit("key").alias("rule")).distinct()
    counts = compact.groupBy("day").agg(F.count("*").alias("rows"))
    off = day_status.where("status = 'success'").join(counts, "day", "left").where("coalesce(rows, 0) <> compact_rows").select("day", F.lit("rows").alias("rule"))
    return twice.unionByName(off)


def check_valuation(valued: DataFrame) -> DataFrame:
    """Aged positions that could not be valued."""
    return valued.where("recog_status = 'failed'").select("event_id", F.lit("no value").alias("rule"))


def stop_on(rows: DataFrame, what: str, shown: int = 10) -> None:
    """Ends the run, naming the first ``shown`` rows, if there are any."""
    first = rows.limit(shown).collect()
    if first:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in first))
