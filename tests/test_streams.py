"""Streams over several batches: pruned reads, batches tried again, late and repeated rows, state that ends."""

from __future__ import annotations

import datetime
import re
import time

from pyspark.sql import functions as F

from flowlens.streaming import days as D
from flowlens.streaming import monitor as M

DAY = datetime.date(2024, 1, 1)
TRADES = "code long, broker long, day date, name string, price double, buy long, sell long"


def on(k: int) -> datetime.date:
    return DAY + datetime.timedelta(days=k)


def at(days: float) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=days)


def batches(spark, path, schema, parts):
    """A stream that gives each of ``parts`` in a batch of its own."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.02)  # files are taken by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_compaction_reads_the_days_of_its_batch(spark, tmp_path):
    trade = lambda k, q: (1, 2, on(k), "x", 10.0, q, 0)
    parts = [[trade(k, 1) for k in range(6)], [trade(0, 5), trade(1, 7), (1, 2, None, "x", 1.0, 1, 0)], [trade(0, 100)]]
    stream = batches(spark, tmp_path / "in", TRADES, parts)
    found = {r["trade_day"]: r["buy_qty"] for r in D.compact_stream(stream, str(tmp_path / "out")).collect()}
    assert found == {on(0): 106, on(1): 8, on(2): 1, on(3): 1, on(4): 1, on(5): 1}
    like = spark.createDataFrame([], TRADES)
    raw = f"{tmp_path}/out/raw"
    for days, files in (([on(0)], 3), ([on(1)], 2), ([on(0), on(1)], 5), ([on(5)], 1)):
        opened = D.landed(spark, raw, like, days).select(F.input_file_name().alias("f"))
        assert opened.distinct().count() == files
    plan = D.landed(spark, raw, like, [on(0)])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*day", plan)


def test_a_batch_tried_again_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, on(0), "x", 10.0, 3, 0), (1, 2, on(4), "x", 10.0, 4, 0)], TRADES)
    for number in (0, 1, 1, 0):
        assert sorted(D.land(rows, number, f"{tmp_path}/raw")) == [on(0), on(4)]
    assert D.landed(spark, f"{tmp_path}/raw", rows, [on(0)]).count() == 2
    assert D.land(rows.limit(0), 7, f"{tmp_path}/raw") == []


PROBES = "target_date date, probe_time timestamp, probe_id long, is_complete boolean, raw_rows long"


def test_last_complete_probe_once_a_day(spark, tmp_path):
    parts = [
        [(on(0), at(0.1), 1, True, 10), (on(0), at(0.2), 2, True, 20), (on(0), at(0.2), 2, True, 20), (on(0), at(0.9), 3, False, 99), (on(1), at(1.1), 4, False, 5)],
        [(on(1), at(1.5), 5, True, 50), (on(0), at(1.6), 6, True, 60), (on(3), at(3.0), 7, True, 70)],  # a late one for day 0, which is still open
        [(on(4), at(4.0), 8, True, 80)],  # closes days 0 and 1
        [(on(0), at(5.0), 9, True, 90), (on(6), at(6.0), 10, False, 1)],  # too late for day 0; closes day 3
        [(on(9), at(9.0), 11, True, 3)],
    ]
    stream = D.last_complete_stream(batches(spark, tmp_path / "in", PROBES, parts))
    got = sorted((r["target_date"], r["probe_id"], r["raw_rows"]) for r in M.drain(stream, str(tmp_path / "out")).collect())
    assert got == [(on(0), 6, 60), (on(1), 5, 50), (on(3), 7, 70), (on(4), 8, 80)]
    log = spark.createDataFrame([r for part in parts for r in part], PROBES)
    assert sorted(r[0] for r in D.closed_days(log).collect()) == [on(0), on(1), on(3), on(4), on(6)]


CHECKS = "key long, probe_id long, ts timestamp, mark string, failed boolean, rows long, covered boolean"


def state_rows(stream, path):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_state_of_ended_keys_goes(spark, tmp_path):
    probe = lambda key, n, day, mark="a": (key, n, at(day), mark, False, 5, True)
    first = [probe(k, 10 * k + j, j / 10) for k in range(8) for j in range(3)]
    later = [probe(0, 900, 4), probe(0, 901, 4.1), probe(0, 902, 30), probe(1, 903, 30.1)]
    stream = lambda parts, name: M.completeness_stream(batches(spark, tmp_path / name, CHECKS, parts), 2, idle_days=3)
    assert state_rows(stream([first], "one"), str(tmp_path / "one-out")) == 8
    # the watermark passes the end of all keys but those that have come back since
    parts = [first, later, [probe(2, 904, 33.2)], [probe(3, 905, 0.05)], [probe(9, 906, 60)]]
    out = str(tmp_path / "two-out")
    assert state_rows(stream(parts, "two"), out) == 1
    got = {(r["key"], r["probe_id"], r["status"], r["stable"]) for r in spark.read.parquet(f"{out}/rows").collect()}
    log = spark.createDataFrame([r for part in parts for r in part if r[1] != 905], CHECKS)  # 905 is behind the watermark
    assert got == {tuple(r) for r in M.completeness_batch(log, 2, idle_days=3).collect()}
    assert {(0, 0, "DATA_CHANGING", 1), (0, 1, "COMPLETE", 2), (0, 900, "DATA_CHANGING", 1), (0, 901, "COMPLETE", 2), (0, 902, "DATA_CHANGING", 1)} <= got  # key 0 comes back twice


LOG = "day date, status string, at timestamp, seq long"


def test_queue_at_the_end_of_each_batch(spark, tmp_path):
    parts = [
        [(on(0), "empty", at(0.5), 1), (on(1), "failed", at(1.5), 2), (on(2), "success", at(2.5), 3), (None, "failed", at(2.6), 4)],
        [(on(1), "success", at(3.5), 5), (on(3), "empty", at(3.6), 6), (on(2), "failed", at(2.4), 7)],  # 7 is older than 3
        [(on(7), "failed", at(8.5), 8), (on(3), "empty", at(8.6), 9), (on(8), "success", at(8.7), 10), (on(5), "success", at(8.7), 11), (on(5), "empty", at(8.7), 12)],
    ]
    calendar = spark.createDataFrame([(on(k),) for k in range(20)], "day date")
    found = D.reprocess_stream(batches(spark, tmp_path / "in", LOG, parts), calendar, str(tmp_path / "out")).collect()
    for k in range(3):
        log = spark.createDataFrame([r for part in parts[: k + 1] for r in part if r[0]], LOG)
        want = sorted(map(tuple, D.reprocess_queue(log, calendar).collect()))
        assert sorted((r["day"], r["priority"]) for r in found if r["batch"] == k) == want
    last = {r["day"]: r["priority"] for r in found if r["batch"] == 2}
    assert last == {on(4): 1, on(5): 2, on(6): 1, on(7): 0}  # day 0 and day 3 were empty, but are no longer among the last five


def test_streams_without_rows(spark, tmp_path):
    empty = lambda schema, name: batches(spark, tmp_path / name, schema, [[]])
    assert D.compact_stream(empty(TRADES, "a"), str(tmp_path / "a-out")).count() == 0
    assert D.reprocess_stream(empty(LOG, "b"), spark.createDataFrame([(on(1),)], "day date"), str(tmp_path / "b-out")).count() == 0
    assert M.drain(D.last_complete_stream(empty(PROBES, "c")), str(tmp_path / "c-out")).where(F.col("probe_id") > 0).count() == 0
