"""What is scanned in slices or resumed from a checkpoint against plain loops over the whole history."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import fifo, report
from flowlens.sources import tables as T

DAY = datetime.date(2020, 1, 1)


def on(k: int) -> datetime.date:
    return DAY + datetime.timedelta(days=k)


def literal_costs(rows):
    held = cost = 0.0
    for day, bq, ba, sq, sa in sorted(rows):
        if sq > 0 and held > 0:
            mean = cost / held
            if mean > 0:
                yield day, mean * sq, (sa - mean * sq) / (mean * sq) * 100
            cost, held = cost * max(held - sq, 0) / held, max(held - sq, 0)
        held, cost = held + bq, cost + ba


@pytest.mark.parametrize("slice_days", [1, 7, 64, 100_000])
def test_average_cost_by_slices(spark, slice_days):
    rng = random.Random(slice_days)
    rows = []
    for key in range(12):
        for k in sorted(rng.sample(range(900), rng.choice((1, 5, 400)))):
            bq, sq = rng.choice((0, 0, rng.randint(1, 50))), rng.choice((0, rng.randint(1, 20), rng.randint(1, 90)))
            rows.append((key, on(k), bq, bq * rng.randint(1, 30), sq, sq * rng.randint(1, 30)))
    daily = spark.createDataFrame(rows, "key int, day date, buy_qty long, buy_amt long, sell_qty long, sell_amt long")
    want = [(key, *x) for key in range(12) for x in literal_costs([r[1:] for r in rows if r[0] == key])]
    got = sorted(map(tuple, report.wavg_cost_returns(daily, ["key"], slice_days).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [x for r in got for x in r[2:]] == pytest.approx([x for r in want for x in r[2:]], rel=1e-9, abs=1e-9)
    assert report.wavg_cost_returns(daily.limit(0), ["key"]).count() == 0


def test_runs_from_checkpoints_equal_one_run(spark, tmp_path):
    rng = random.Random(4)
    lot = "array<struct<code:long,qty:long,amount:long>>"
    events, sales = [], {}
    for k in range(120):
        for broker in (1, 2):
            if rng.random() < 0.4:
                codes = rng.sample(range(4), rng.randint(1, 3))
                events.append((broker, f"{broker}-{k}", on(k), [(c, rng.randint(1, 60), rng.randint(1, 900)) for c in codes]))
            for code in range(4):
                if rng.random() < 0.3:
                    q = rng.randint(1, 70)
                    sales[broker, code, on(k)] = (q, q * rng.randint(1, 20))
    events = spark.createDataFrame(events, f"broker long, event_id string, day date, lots {lot}")
    sales = spark.createDataFrame([(*k, *v) for k, v in sales.items()], "broker long, code long, day date, sell_qty long, sell_amt long")
    whole = fifo.fifo_match(T.lots_of(events), sales, ["broker", "code"])
    columns = ["event_id", "lot_no", "sale_day", "qty", "revenue", "cost"]
    want = sorted(map(tuple, whole.select(columns).collect()))
    old = None
    for n, (a, z) in enumerate([(0, 3), (4, 40), (41, 41), (42, 90), (91, 200)]):
        part = F.col("day").between(F.lit(on(a)), F.lit(on(z)))
        path = str(tmp_path / f"c{n}")
        found = T.resume_checkpoint(old, events.where(part), sales.where(part), path)
        old = path
    got = found.select("event_id", F.explode("allocations").alias("a")).select("event_id", "a.lot_no", "a.sale_day", "a.qty", "a.revenue", "a.cost")
    assert sorted(map(tuple, got.collect())) == want
    left = {(r["event_id"], r["lot_no"]): r["open"] for r in fifo.open_lots(T.lots_of(events), whole).collect()}
    kept = found.select("event_id", F.explode("open_lots").alias("l")).collect()
    assert {(r["event_id"], r["l"]["code"]): r["l"]["remaining"] for r in kept} == left and left
    # lots of which nothing is open don't come back
    assert T.lots_of(found.select("broker", "event_id", "day", "lots")).count() == len(left)


def test_tables_of_a_run_go_at_its_end(spark):
    from pathlib import Path

    parts = lambda: {p for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).rglob("*") if p.is_file()}
    T.stored(spark.range(3), "kept").count()
    before = parts()
    with T.scratch_run(spark) as outer:
        a = T.stored(spark.range(5), "a")
        with T.scratch_run(spark) as inner:
            assert inner.startswith(outer) and T.stored(a, "b").count() == 5
        assert not Path(inner.removeprefix("file:")).exists() and a.count() == 5
    assert parts() == before and not Path(outer.removeprefix("file:")).exists()
    with pytest.raises(ZeroDivisionError), T.scratch_run(spark):
        T.stored(spark.range(5), "c")
        raise ZeroDivisionError
    with T.scratch_run(spark):
        pass
    assert parts() == before
    T.stored(spark.range(1), "kept")
    assert parts() > before


@pytest.mark.parametrize("whole_rows", [0, 5, 4096])
def test_average_cost_of_short_and_long_keys(spark, whole_rows):
    """Keys that are gone through at once, sliced ones and both at a time give the same; some never sell what they hold."""
    rng = random.Random(7)
    rows = []
    for key, n in enumerate((1, 1, 2, 4, 5, 6, 130, 400)):
        for k in sorted(rng.sample(range(900), n)):
            bq, sq = rng.choice((0, rng.randint(1, 50))), rng.choice((0, rng.randint(1, 90)))
            rows.append((key, on(k), bq, bq * rng.randint(1, 30), sq, sq * rng.randint(1, 30)))
    rows += [(8, on(1), 0, 0, 5, 50), (8, on(2), 5, 50, 0, 0), (9, on(1), 5, 50, 0, 0), (9, on(2), 5, 50, 0, 0), (10, on(1), 5, 50, 5, 60)]
    daily = spark.createDataFrame(rows, "key int, day date, buy_qty long, buy_amt long, sell_qty long, sell_amt long")
    want = [(key, *x) for key in range(11) for x in literal_costs([r[1:] for r in rows if r[0] == key])]
    got = sorted(map(tuple, report.wavg_cost_returns(daily, ["key"], 64, whole_rows).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(want) > 100
    assert [x for r in got for x in r[2:]] == pytest.approx([x for r in want for x in r[2:]], rel=1e-9, abs=1e-9)
