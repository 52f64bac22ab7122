"""Streaming twins: completeness per target day and probe counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "key long, probe_id long, status string, stable int"
_STATE = "mark string, stable int, done boolean, last_ms long"
#: A key without probes for so long has ended.
IDLE_DAYS = 7


def completeness_stream(probes: DataFrame, need: int = 4, idle_days: int | None = IDLE_DAYS, late: str = "1 hour") -> DataFrame:
    """Status of each probe of (key, probe_id, ts, mark, failed, rows, covered), kept per key between batches.

    API_ERROR before NO_DATA before COMPLETE (``need`` equal marks in a row, and covered) before COVERAGE_TOO_LOW before
    STABLE_WAITING before DATA_CHANGING.  A failure keeps the last mark and ends the run; an empty success stores its own.  After COMPLETE a key's
    probes are ignored.

    A key ends when more than ``idle_days`` go by without a probe of it: one that comes back then starts anew, also after COMPLETE.  Its state
    goes once the watermark (``late`` behind the latest probe of any key) has passed that time; probes before the watermark are ignored.  With None
    keys never end, and their state stays for ever.
    """
    idle = None if idle_days is None else idle_days * 86_400_000

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fresh = (None, 0, False, None)
        mark, stable, done, last = state.get if state.exists else fresh
        mark_ms = state.getCurrentWatermarkMs() if idle is not None else 0
        out = []
        for row in pd.concat(list(frames)).sort_values(["ts", "probe_id"]).itertuples():
            if idle is not None:
                if row.ms < mark_ms:
                    continue
                if last is not None and row.ms - last > idle:
                    mark, stable, done, last = fresh
            last = row.ms if last is None else max(last, row.ms)
            if done:
                continue
            has = not row.failed and row.rows > 0
            stable = 0 if not has else stable + 1 if row.mark == mark and stable else 1
            mark = mark if row.failed else row.mark
            status = "API_ERROR" if row.failed else "NO_DATA" if not has else "DATA_CHANGING" if stable == 1 else "STABLE_WAITING"
            if has and stable >= need:
                done = bool(row.covered)
                status = "COMPLETE" if done else "COVERAGE_TOO_LOW"
            out.append((key[0], row.probe_id, status, stable))
        if last is not None:
            state.update((mark, stable, done, last))
            if idle is not None:
                state.setTimeoutTimestamp(max(last + idle, mark_ms) + 1)
        yield pd.DataFrame(out, columns=["key", "probe_id", "status", "stable"])

    zoned = probes.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis("ts"))
    if idle is None:
        return zoned.groupBy("key").applyInPandasWithState(update, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
    return zoned.withWatermark("ts", late).groupBy("key").applyInPandasWithState(update, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def completeness_batch(probes: DataFrame, need: int = 4, idle_days: int | None = IDLE_DAYS) -> DataFrame:
    """The same over a finished log, by windows: a key's probes after more than ``idle_days`` without one are a key of their own."""
    parts = probes.withColumn("_part", F.lit(0))
    if idle_days is not None:
        by_key = Window.partitionBy("key").orderBy("ts", "probe_id")
        ms = F.unix_millis(F.col("ts").cast("timestamp"))
        parts = probes.withColumn("_part", F.sum(F.coalesce((ms - F.lag(ms).over(by_key) > idle_days * 86_400_000).cast("int"), F.lit(0))).over(by_key))
    order = Window.partitionBy("key", "_part").orderBy("ts", "probe_id")
    has = ~F.col("failed") & (F.col("rows") > 0)
    change = ~has | ~F.coalesce(F.lag(has).over(order), F.lit(False)) | ~F.col("mark").eqNullSafe(F.lag("mark").over(order))
    runs = parts.withColumns({"has": has, "_c": change.cast("int")}).withColumn("_run", F.sum("_c").over(order))
    counted = runs.withColumn("stable", F.when(F.col("has"), F.row_number().over(Window.partitionBy("key", "_part", "_run").orderBy("ts", "probe_id"))).otherwise(0))
    enough = F.col("has") & (F.col("stable") >= need)
    status = F.when(F.col("failed"), "API_ERROR").when(~F.col("has"), "NO_DATA").when(enough & F.col("covered"), "COMPLETE").when(enough, "COVERAGE_TOO_LOW").when(F.col("stable") > 1, "STABLE_WAITING").otherwise("DATA_CHANGING")
    return completed_gate(counted.withColumn("status", status), keys=("key", "_part")).select("key", "probe_id", "status", "stable")


def completed_gate(statuses: DataFrame, force: bool = False, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Without the probes of a key after its first COMPLETE, unless forced."""
    if force:
        return statuses
    before = Window.partitionBy(*keys).orderBy("ts", "probe_id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.col("status") == "COMPLETE").over(before), F.lit(False))
    return statuses.withColumn("_done", done).where("not _done").drop("_done")


def last_mark(probes: DataFrame) -> DataFrame:
    """Each probe with the mark stored after it: its own, or on failure the last stored one."""
    order = Window.partitionBy("key").orderBy("ts", "probe_id").rowsBetween(Window.unboundedPreceding, 0)
    return probes.withColumn("stored", F.last(F.when(~F.col("failed"), F.col("mark")), ignorenulls=True).over(order))


def probe_counts(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Probes and their values per tumbling window and type, with a watermark; works on streams and tables."""
    zoned = stream.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time zone
    windowed = zoned.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("bigint")).alias("cents"))
    return windowed.select(F.col("window.start").cast(stream.schema["ts"].dataType).alias("start"), "event_type", "n", "cents")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into ``path`` and returns what it wrote."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
