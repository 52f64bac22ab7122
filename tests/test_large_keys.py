"""Queries on tables of many rows, whose keys have more digits than the given ones."""

from __future__ import annotations

import pytest

from flowlens.plans import registry

from .oracle import assert_same, connection


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Keys of 1 to 8 digits; parts 100000 and 1000000 to 1000039 have the same name and size in fours."""
    d = tmp_path_factory.mktemp("large")
    spark.range(1).selectExpr("explode(array(1, 99, 12345, 99999, 100000, 999999, 1000000, 1234567, 9000000, 12345678)) as o_orderkey").selectExpr("cast(o_orderkey as bigint) as o_orderkey").coalesce(1).write.parquet(f"{d}/raw/orders")
    spark.range(1).selectExpr("explode(array_append(sequence(1000000, 1000039), 100000)) as k").selectExpr("cast(k as bigint) as p_partkey", "concat('part ', k % 4) as p_name", "cast(k % 4 * 12 + 1 as int) as p_size").coalesce(1).write.parquet(f"{d}/raw/part")
    for name in ("orders", "part"):
        next((d / "raw" / name).glob("*.parquet")).rename(d / f"{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["p17_is_instrument_code", "s5_check_seed"])
def test_query(spark, large, name):
    assert_same(registry.QUERIES[name](spark, large), connection(large), registry.ORACLE_SQL[name])


def test_shares_of_tasks(spark):
    """More rows are dealt to more partitions, so that a task's share stays the same."""
    from flowlens.operators import trades

    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert trades.parts_for(spark.range(1), 10) == own
    assert [trades.parts_for(spark.range(1), n * trades.TASK_ROWS) for n in (100, 600)] == [100, 600]
    assert trades.dealt(spark.range(10), 7, "id").rdd.getNumPartitions() == 7
