"""Arrival monitor: metrics, fingerprints, stable runs, baselines, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import rounded


def probe_metrics(raw: DataFrame) -> DataFrame:
    """One row: rows, instruments, volumes, amounts, net."""
    money = lambda q: F.sum(F.bround(F.col("price") * F.col(q)).cast("bigint"))
    out = raw.agg(F.count("*").alias("rows"), F.countDistinct("code").alias("instruments"), F.sum("buy").alias("buy_qty"), F.sum("sell").alias("sell_qty"), money("buy").alias("buy_amt"), money("sell").alias("sell_amt"))
    return out.withColumn("net_amt", F.col("buy_amt") - F.col("sell_amt"))


def fingerprint(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Order-independent content fingerprint per key: rows, exclusive or and sum (mod 2^61 - 1) of row hashes; no rows are gathered."""
    h = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols))
    mod = (1 << 61) - 1
    hashed = df.select(*keys, h.alias("_h"), F.xxhash64(h, F.lit(1)).alias("_g"))
    return hashed.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor("_h").alias("mark"), (F.sum(F.pmod(F.col("_g"), F.lit(mod)).cast("decimal(38,0)")) % mod).cast("bigint").alias("total"))


def md5_fingerprint(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """The same by the first 60 bits of each row's MD5 over its texts (nulls as U+0000, U+0001 between columns), which any engine can state."""
    text = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols))
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    mod = (1 << 61) - 1
    return df.select(*keys, h.alias("_h")).groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor("_h").alias("mark"), (F.sum(F.col("_h").cast("decimal(38,0)")) % mod).cast("bigint").alias("total"))


def sha_fingerprint(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """SHA-256 over a group's sorted row digests; for groups of bounded size (a branch and day)."""
    row = F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)), 256)
    return df.withColumn("_row", row).groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_row")), ""), 256).alias("fingerprint"))


def complete_buysell(raw: DataFrame) -> DataFrame:
    money = lambda q: rounded(F.sum(F.floor(F.col("price") * F.col(q) * 100 + 0.5).cast("bigint")) / 100, 2)
    return raw.groupBy("day", "broker", "code").agg(F.max("name").alias("name"), F.sum("buy").alias("buy_qty"), F.sum("sell").alias("sell_qty"), money("buy").alias("buy_amt"), money("sell").alias("sell_amt"))


def last_per_day(log: DataFrame) -> DataFrame:
    order = Window.partitionBy("target_date").orderBy(F.desc("probe_time"), F.desc("probe_id"))
    return log.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def median_baseline(log: DataFrame, n: int = 20) -> DataFrame:
    """(target_date, baseline, history): median rows over the last ``n`` complete days before, without failures; one row per day.

    If the log has a column ``configured`` (the number of branches), only days with as many count.
    """
    days = last_per_day(log)
    days = days if "configured" in days.columns else days.withColumn("configured", F.lit(0))
    alike = Window.partitionBy("configured").orderBy("target_date")
    good = days.where("is_complete and failed = 0")
    ranked = good.select("configured", F.col("target_date").alias("past"), F.col("raw_rows").alias("past_rows"), F.row_number().over(alike).alias("at"))
    at = days.join(ranked.select(F.col("past").alias("target_date"), "at"), "target_date", "left")
    upto = at.withColumn("upto", F.coalesce(F.max("at").over(alike.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slots = upto.where("upto > 0").select("target_date", "configured", F.explode(F.sequence(F.greatest(F.col("upto") - n + 1, F.lit(1)), F.col("upto"))).alias("at"))
    found = slots.join(ranked, ["configured", "at"]).groupBy("target_date").agg(F.median("past_rows").alias("baseline"), F.count("*").alias("history"))
    return days.select("target_date", "raw_rows").join(found, "target_date", "left").withColumn("history", F.coalesce("history", F.lit(0).cast("bigint")))


def coverage(metrics: DataFrame, threshold: float = 0.9, min_days: int = 5) -> DataFrame:
    """Ratios to the baseline, their least, whether enough history enforces it, and whether it passes."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    least = F.least(ratio("raw_rows", "base_rows"), ratio("instruments", "base_instruments"), ratio("brokers", "base_brokers"))
    out = metrics.withColumns({"coverage": rounded(least, 6), "enforced": F.col("history") >= min_days})
    return out.withColumn("passed", ~F.col("enforced") | F.coalesce(F.col("coverage") >= threshold, F.lit(False)))


def branch_probe(raw: DataFrame, branches: DataFrame, errors: DataFrame) -> DataFrame:
    """Per configured branch: rows and OK, NO_DATA or ERROR."""
    counts = raw.groupBy("broker").agg(F.count("*").alias("rows"), F.countDistinct("code").alias("instruments"))
    out = branches.select("broker").distinct().join(counts, "broker", "left").join(errors.select("broker", F.lit(True).alias("_e")).distinct(), "broker", "left")
    return out.select("broker", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"), F.coalesce("instruments", F.lit(0).cast("bigint")).alias("instruments"), F.when(F.col("_e"), "ERROR").when(F.col("rows").isNull(), "NO_DATA").otherwise("OK").alias("status"))


def stable_runs(probes: DataFrame, key: str, time: str, mark: str, failed: str) -> DataFrame:
    """Each probe with the length of its run of equal marks; a failure counts 0 and ends the run."""
    order = Window.partitionBy(key).orderBy(time)
    bad = F.coalesce(F.col(failed), F.lit(False))
    change = bad | ~F.col(mark).eqNullSafe(F.lag(mark).over(order)) | F.coalesce(F.lag(bad).over(order), F.lit(False))
    runs = probes.withColumn("_c", change.cast("int")).withColumn("_run", F.sum("_c").over(order))
    place = F.row_number().over(Window.partitionBy(key, "_run").orderBy(time))
    return runs.withColumn("stable", F.when(bad, 0).otherwise(place)).drop("_c", "_run")
