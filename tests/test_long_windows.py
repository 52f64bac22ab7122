"""Market states with all windows, on made prices."""

from __future__ import annotations

from flowlens.operators import prices
from flowlens.plans import long_window_queries, registry


def test_low_levels_of_all_windows(spark):
    rows = [(i, float(c), *map(float, ma)) for i, (c, ma) in enumerate([(9, (8, 10, 10, 10, 10, 10)), (9, (10, 10, 10, 8, 10, 10)), (9, (10, 10, 10, 10, 8, 10)), (9, (10, 10, 10, 10, 10, 8)), (9, (10,) * 6)])]
    df = spark.createDataFrame(rows, "id int, close double, " + ", ".join(f"ma{n} double" for n in prices.WINDOWS))
    df = df.selectExpr("*", "close AS prev_close", "ma5 AS prev_ma5", "ma10 AS prev_ma10", "ma20 AS prev_ma20", "ma20 AS ma20_back")
    got = prices.ma_states(df, (5, 10, 20), prices.LOWS).orderBy("id").collect()
    assert [r["low"] for r in got] == [0, 1, 2, 3, 4]
    assert [r["below240"] for r in got] == [True, True, True, False, True]


def test_all_windows_are_registered(spark):
    assert len(long_window_queries.CONDITIONS) == 25
    df = registry.QUERIES["w1_moving_averages_full"](spark, "/root/testdata/sf0.001")
    assert {f"ma{n}" for n in (5, 10, 20, 60, 120, 240)} <= set(df.columns)
    assert df.where("ma240 is not null").count() > 0
