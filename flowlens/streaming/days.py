"""Streams whose state is kept by day and ends: landed days, the last complete probe of a day, days to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trades import compact_daily, reprocess_days
from ..sources.tables import write_compact


def land(df: DataFrame, number: int, path: str, day: str = "day") -> list:
    """Writes the rows of batch ``number`` under their days and returns these days; a batch that is tried again replaces its own rows.

    The days of one batch go to the driver; they are few, as a calendar has few.
    """
    df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "batch").parquet(path)
    kept = df.sparkSession.read.schema(df.withColumn("batch", F.lit(0)).schema).parquet(path)
    return [r[0] for r in kept.where((F.col("batch") == number) & F.col(day).isNotNull()).select(day).distinct().collect()]


def landed(spark: SparkSession, path: str, like: DataFrame, days: list, day: str = "day") -> DataFrame:
    """All rows of ``days`` from whichever batch, with the columns of ``like``; the scan opens the folders of these days only."""
    rows = spark.read.schema(like.withColumn("batch", F.lit(0)).schema).parquet(path)
    return rows.where(F.col(day).isin(days)).select(*like.columns)


def compact_stream(stream: DataFrame, path: str) -> DataFrame:
    """Compacts arriving raw trades into ``path``, whole days at a time, from all batches that have rows of the day.

    Raw rows are kept under their day and batch: a batch reads back the days it has rows of, and one that is tried again counts once.
    Rows without a day are kept but in no day.  A stream without rows gives none.
    """
    spark = stream.sparkSession
    empty = compact_daily(spark.createDataFrame([], stream.schema)).withColumnRenamed("day", "trade_day")

    def batch(df: DataFrame, number: int) -> None:
        if days := land(df, number, f"{path}/raw"):
            write_compact(compact_daily(landed(df.sparkSession, f"{path}/raw", df, days)).withColumnRenamed("day", "trade_day"), f"{path}/rows")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start()
    query.awaitTermination()
    empty.limit(0).write.mode("append").partitionBy("trade_day").parquet(f"{path}/rows")  # so that there is a table in any case
    return spark.read.schema(empty.schema).parquet(f"{path}/rows")


def last_complete_stream(log: DataFrame, day: str = "target_date", time: str = "probe_time", seq: str = "probe_id", complete: str = "is_complete", keep: str = "2 days") -> DataFrame:
    """The last complete probe of each day, once, when the day closes: when a probe of a day more than ``keep`` after its end has come.

    Event time is the day that is probed.  State is one row for each open day; it goes when the day closes.  What comes for a day after that is dropped.
    Repeated probes change nothing; of several at one ``time`` the greatest ``seq`` counts.  Days without a complete probe give nothing.
    """
    marked = log.withColumn("_day", F.col(day).cast("timestamp")).withWatermark("_day", keep)
    row = F.struct(*(F.col(c) for c in log.columns))
    best = marked.where(F.col(complete)).groupBy(F.window("_day", "1 day")).agg(F.max_by(row, F.struct(time, seq)).alias("_row"))
    return best.select("_row.*")


def closed_days(log: DataFrame, day: str = "target_date", keep_days: int = 2) -> DataFrame:
    """The days that ``last_complete_stream`` has closed after all of ``log``."""
    last = log.agg(F.max(day).alias("_last"))
    return log.select(day).distinct().crossJoin(F.broadcast(last)).where(F.date_add(day, keep_days + 1) <= F.col("_last")).select(day)


def _queue(calendar: DataFrame, status: DataFrame, late: int) -> DataFrame:
    today = status.agg(F.to_date(F.max("at")).alias("_today"))
    expected = calendar.crossJoin(F.broadcast(today)).where("day <= _today").select("day")
    return reprocess_days(expected, status.select("day", "status"), late)


def reprocess_queue(log: DataFrame, calendar: DataFrame, late: int = 5) -> DataFrame:
    """(day, priority) to run again after all of ``log`` (day, status, at, seq): the last status of a day counts, by (at, seq).

    Days are expected up to that of the latest ``at``.  Of these, failed ones come first, then those never seen, then the last ``late`` ones if
    they were empty: what was empty earlier stays so.
    """
    return _queue(calendar, log.groupBy("day").agg(F.max_by("status", F.struct("at", "seq")).alias("status"), F.max("at").alias("at")), late)


def reprocess_stream(log: DataFrame, calendar: DataFrame, path: str, late: int = 5) -> DataFrame:
    """(batch, day, priority): ``reprocess_queue`` at the end of each batch of the stream ``log``.

    Between batches one row is kept for each day, in two tables that take turns: a batch reads the one before's and replaces the other, and so
    may be tried again.
    """
    spark = log.sparkSession
    kind = "day date, status string, at timestamp, seq long"

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        fresh = df.select("day", "status", F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"))
        both = fresh if number == 0 else fresh.unionByName(session.read.schema(kind).parquet(f"{path}/status{(number - 1) % 2}"))
        last = both.where("day is not null").groupBy("day").agg(F.max_by(F.struct("status", "at", "seq"), F.struct("at", "seq")).alias("r")).select("day", "r.*")
        last.write.mode("overwrite").parquet(f"{path}/status{number % 2}")
        status = session.read.schema(kind).parquet(f"{path}/status{number % 2}")
        _queue(calendar, status, late).write.mode("overwrite").parquet(f"{path}/queue/batch={number}")

    query = log.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start()
    query.awaitTermination()
    none = spark.createDataFrame([], "batch int, day date, priority int")
    none.write.mode("append").partitionBy("batch").parquet(f"{path}/queue")
    return spark.read.schema("day date, priority int, batch int").parquet(f"{path}/queue").select("batch", "day", "priority")
