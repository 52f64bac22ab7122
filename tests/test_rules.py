"""Rules on rows made for them: missing and odd values, ties, several batches, and brute-force versions."""

from __future__ import annotations

import datetime
import random
import struct

import pytest
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import fifo, identity, monitor, prices, report
from flowlens.sources import tables
from flowlens.streaming import days as arriving

DAY = datetime.date(2024, 1, 1)


def day(k: int) -> datetime.date:
    return DAY + datetime.timedelta(days=k)


def test_amount_texts(spark):
    values = [0, 4500, 12345, 99_999_999, 1e8, 1e9, 100_500_000, 101_500_000, 123_450_000, -250_000_000, None, 1500.0, 2500.0, 3500.0]
    values += [random.Random(3).randint(10**7, 10**12) // 500 * 500 for _ in range(2000)]

    def text(v):
        v = float(v or 0)
        return f"{v / 1e8:.2f}".rstrip("0").rstrip(".") + " 億" if abs(v) >= 1e8 else f"{round(v / 1e4, 1):.1f} 萬"

    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["t"] for r in df.select("i", S.fmt_amount(F.col("v")).alias("t")).collect()}
    assert [got[i] for i in range(len(values))] == [text(v) for v in values]


def test_returns_and_settlements_that_are_missing(spark):
    df = spark.createDataFrame([("-", 100.0, True), ("-250%", None, True), ("12%", None, False), ("7", float("nan"), True)], "r string, settle double, recorded boolean")
    value = S.settlement_value(F.lit("call"), F.lit(90.0), F.col("settle"), F.lit(0.5), 0.0, F.col("recorded"))
    assert [tuple(r) for r in df.select(S.norm_return(F.col("r"), clamp=True), value).collect()] == [(None, 5.0), (-100.0, None), (12.0, 0.0), (7.0, None)]
    strict = S.settlement_value(F.lit("call"), F.lit(90.0), F.col("settle"), F.lit(0.5), 0.0, F.col("recorded"), strict=True)
    with pytest.raises(Exception, match="lacks a price"):
        df.select(strict).collect()


def brute_fifo(lots, sales):
    left, out = [list(x) for x in sorted(lots)], []
    for when, qty in sorted(sales):
        for lot in left:
            take = min(qty, lot[3]) if lot[0] < when else 0
            if take:
                out.append((lot[1], lot[2], when, take))
                lot[3] -= take
                qty -= take
    return out


def test_fifo_against_a_loop(spark):
    rng, lots, sales, want = random.Random(11), [], [], []
    for key in range(60):
        mine = [(day(rng.randint(0, 12)), f"{key}-{k}", k, rng.choice([0, 1, 5, 20])) for k in range(rng.randint(0, 8))]
        sold = {day(rng.randint(0, 15)): rng.randint(1, 30) for _ in range(rng.randint(0, 6))}
        lots += [(key, e, d, k, q, q * 10) for d, e, k, q in mine]
        sales += [(key, d, q, q * 12) for d, q in sold.items()]
        want += [(key, *x) for x in brute_fifo([(d, e, k, q) for d, e, k, q in mine], list(sold.items()))]
    a = spark.createDataFrame(lots, "key int, event_id string, event_day date, lot_no int, qty bigint, amount bigint")
    b = spark.createDataFrame(sales, "key int, day date, sell_qty bigint, sell_amt bigint")
    got = fifo.fifo_match(a, b, ["key"]).select("key", "event_id", "lot_no", "sale_day", "qty")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_last_closes_and_gaps_against_loops(spark):
    rng = random.Random(5)
    market = [k for k in range(60) if k % 7 < 5]
    closes = {s: {k: float(rng.randint(1, 99)) for k in market if rng.random() < 0.9} for s in "abc"} | {"none": {}}
    table = spark.createDataFrame([(s, day(k), v) for s, x in closes.items() for k, v in x.items()], "series string, date date, close double")
    calendar = spark.createDataFrame([(day(k),) for k in market], "date date")
    contracts = [(s, day(a), day(a + rng.randint(0, 20))) for s in closes for a in range(-3, 62, 4)]
    got = prices.last_close(spark.createDataFrame(contracts, "series string, list_date date, end_date date"), table, str(day(50)))
    for r in got.collect():
        inside = [(k, v) for k, v in closes[r["series"]].items() if r["list_date"] <= day(k) <= min(r["end_date"], day(50))]
        assert (r["close_day"], r["last_close"]) == ((day(max(inside)[0]), max(inside)[1]) if inside else (None, None))
    asked = spark.createDataFrame([(s, day(k)) for s in closes for k in range(60)], "series string, day date")
    for r in prices.calendar_complete(asked, table, calendar, 10).collect():
        k = (r["day"] - DAY).days
        if k not in market:
            want = "Missing: not a market day"
        elif market.index(k) < 9:
            want = "Missing: too early"
        else:
            lost = [str(day(x)) for x in market[market.index(k) - 9 : market.index(k) + 1] if x not in closes[r["series"]]]
            want = "Missing: " + ",".join(lost[:5]) if lost else "OK"
        assert r["status"] == want


def test_valuation_without_what_it_needs(spark):
    events = spark.createDataFrame([(i, DAY, "open", 100.0, 0.0, None, None) for i in range(6)], "event_id int, day date, status string, amount double, revenue double, ret double, exit_day date")
    early, late = datetime.date(2024, 2, 1), datetime.date(2030, 1, 1)
    lots = [(0, early, True, None, 5.0, True), (1, early, True, 110.0, 5.0, False), (2, None, False, None, 5.0, True), (3, late, False, None, None, True), (4, early, False, None, None, True), (5, early, True, 110.0, None, True)]
    lots = spark.createDataFrame([(e, 10, end, rec, "call", 100.0, s, 1.0, last, end, off) for e, end, rec, s, last, off in lots], "event_id int, remaining bigint, end_date date, recorded boolean, kind string, strike double, settle double, ratio double, last_close double, close_day date, official boolean")
    got = {r["event_id"]: (r["recog_status"], r["recog_ret"]) for r in prices.recognise(events, lots, "2024-06-30", tax=0.0).collect()}
    assert got == {0: ("failed", None), 1: ("failed", None), 2: ("failed", None), 3: ("failed", None), 4: ("lapsed", -100.0), 5: ("settled", 0.0)}


def test_prefixes_of_names(spark):
    master = spark.createDataFrame([("2330A", "台積電"), ("1101", "台泥 科技"), ("1102", "台泥國際"), ("9", "元大")], "target string, name string")
    aliases = identity.prefix_aliases(master)
    names = ["台積電元大01購", "台泥凱基02", "台灣50群益03", "台灣50正2購", "元大台灣50購", "元", "無", "台 積 電 購"]
    got = {r["name"]: r["target"] for r in identity.resolve_by_prefix(spark.createDataFrame([(n,) for n in names], "name string"), aliases, "name").collect()}
    assert got == {"台積電元大01購": "2330A", "台泥凱基02": "1101", "台灣50群益03": "0050", "台灣50正2購": "0050", "元大台灣50購": "0050", "台 積 電 購": "2330A"}


def test_order_by_list_of_odd_codes(spark):
    rows = [("b", 5, "03456P"), ("b", 5, "7"), ("b", 5, "X1"), ("a", 1, "2"), ("c", 9, None), ("b", 5, "7")]
    got = report.order_by_list(spark.createDataFrame(rows, "broker string, amount int, code string"), ["a", "b"]).orderBy("rank").collect()
    assert [(r["broker"], r["code"], r["rank"]) for r in got] == [("a", "2", 1), ("b", "7", 2), ("b", "7", 3), ("b", "03456P", 4), ("b", "X1", 5), ("c", None, 6)]
    assert report.order_by_list(spark.createDataFrame([], "broker string, amount int, code string"), ["a"]).count() == 0


def test_baseline_of_days_with_as_many_branches(spark):
    rows = [(day(k), k, k, rows, 0, True, n) for k, (rows, n) in enumerate([(100, 38), (900, 26), (110, 38), (120, 38)])]
    log = spark.createDataFrame(rows, "target_date date, probe_time int, probe_id int, raw_rows bigint, failed int, is_complete boolean, configured int")
    got = {r["target_date"]: (r["baseline"], r["history"]) for r in monitor.median_baseline(log).collect()}
    assert got == {day(0): (None, 0), day(1): (None, 0), day(2): (100.0, 1), day(3): (105.0, 2)}


def test_fingerprints_against_the_hash_itself(spark):
    import xxhash

    rows = [(k % 3, k, None if k % 5 == 0 else f"t{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "g int, k bigint, t string")
    mod, want = (1 << 61) - 1, {}
    for g, k, t in rows:
        seed = 42
        for x in (str(k), "\0" if t is None else t):
            seed = xxhash.xxh64_intdigest(x.encode(), seed)
        again = xxhash.xxh64_intdigest(struct.pack("<i", 1), xxhash.xxh64_intdigest(struct.pack("<Q", seed), 42))
        signed = again - (1 << 64) if again >> 63 else again
        n, mark, total = want.get(g, (0, 0, 0))
        want[g] = (n + 1, mark ^ seed, (total + signed % mod) % mod)
    got = {r["g"]: (r["rows"], r["mark"] % (1 << 64), r["total"]) for r in monitor.fingerprint(df, ["k", "t"], ["g"]).collect()}
    assert got == want


def test_days_that_arrive_in_several_batches(spark, tmp_path):
    schema = "broker int, code int, name string, day date, price double, buy bigint, sell bigint"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    assert arriving.compact_stream(stream(), target).count() == 0
    for k in (1, 2):
        spark.createDataFrame([(1, 7, "n", DAY, 2.0, 10 * k, 0), (1, 7, "n", day(k), 2.0, 1, 0)], schema).coalesce(1).write.mode("append").parquet(source)
        got = arriving.compact_stream(stream(), target)
    assert {r["trade_day"]: r["buy_qty"] for r in got.collect()} == {DAY: 30, day(1): 1, day(2): 1}


def test_checkpoint_with_allocations(spark, tmp_path):
    events = spark.sql("SELECT 'e' AS event_id, array(named_struct('code', 1, 'remaining', 0), named_struct('code', 2, 'remaining', 3)) AS lots UNION ALL SELECT 'f', array(named_struct('code', 1, 'remaining', 1))")
    sales = spark.createDataFrame([("e", 2, day(5), 4, 1.0, 1.0), ("e", 1, day(3), 2, 1.0, 1.0)], "event_id string, lot_no int, sale_day date, qty bigint, revenue double, cost double")
    tables.write_checkpoint(events, str(tmp_path / "c"), sales)
    got = {r["event_id"]: ([x["code"] for x in r["open_lots"]], [x["lot_no"] for x in r["allocations"]]) for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert got == {"e": ([2], [1, 2]), "f": ([1], [])}


def test_matching_deals_rows_once(spark):
    """Lots and sales travel once, outcomes once more beside the events; more rows are dealt to more partitions."""
    lots = spark.createDataFrame([(1, 7, "1-a", DAY, 7, 5, 50), (1, 8, "1-a", DAY, 8, 5, 50), (2, 7, "2-a", DAY, 7, 5, 50)], "broker int, code int, event_id string, event_day date, lot_no int, qty bigint, amount bigint")
    sales = spark.createDataFrame([(1, 7, day(1), 5, 60), (1, 8, day(2), 3, 30)], "broker int, code int, day date, sell_qty bigint, sell_amt bigint")
    events = spark.createDataFrame([(1, "1-a", DAY, 10, 100), (2, "2-a", DAY, 5, 50)], "broker int, event_id string, day date, qty bigint, amount bigint")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    sold = fifo.fifo_match(lots, sales, ["broker", "code"], 7)
    assert exchanges(sold) == 1 and sold.rdd.getNumPartitions() == 7
    done = fifo.event_outcomes(events, sold, 7)
    assert exchanges(done) <= 3
    got = {r["event_id"]: (r["sold"], r["status"], r["first_reduce"], r["exit_day"], r["ret"]) for r in done.collect()}
    assert got == {"1-a": (8, "reduced", day(1), None, 12.5), "2-a": (0, "open", None, None, None)}


def test_valuation_of_events_that_are_their_own_lots(spark):
    early, late = datetime.date(2024, 2, 1), datetime.date(2030, 1, 1)
    rows = [(0, 10, early, True, None, 5.0, True), (1, 10, early, True, 110.0, 5.0, False), (2, 10, None, False, None, 5.0, True), (3, 10, late, False, None, None, True), (4, 10, early, False, None, None, True), (5, 10, early, True, 110.0, None, True), (6, 0, early, True, 110.0, 5.0, True), (7, 10, late, True, 110.0, 5.0, None)]
    df = spark.createDataFrame([(e, DAY, "closed" if n == 0 else "open", 100.0, 0.0, 2.5 if n == 0 else None, early if n == 0 else None, n, end, rec, "call", 100.0, s, 1.0, last, end, off) for e, n, end, rec, s, last, off in rows], "event_id int, day date, status string, amount double, revenue double, ret double, exit_day date, remaining bigint, end_date date, recorded boolean, kind string, strike double, settle double, ratio double, last_close double, close_day date, official boolean")
    terms = list(prices.LOT_TERMS)
    want = prices.recognise(df.drop(*terms), df.where("remaining > 0").select("event_id", "remaining", *terms), "2024-06-30", tax=0.0)
    got = prices.recognise(df, None, "2024-06-30", tax=0.0)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_integrity_counts_read_the_outcomes_as_they_are(spark, monkeypatch):
    from flowlens.plans import registry, views

    names, stored = [], views.stored
    monkeypatch.setattr(views, "stored", lambda df, name: (names.append(name), stored(df, name))[1])
    assert registry.QUERIES["a10_integrity_counts"](spark, "/root/testdata/sf0.001").columns == ["item", "value"]
    assert names == ["facts", "events", "outcomes"]
