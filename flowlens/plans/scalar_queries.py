"""One query for each scalar rule, over texts and numbers that Spark derives from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

ISSUERS = ["th", "an", "st"]
PATTERNS = [("#1$", "one"), ("[2-4]$", "low"), ("Supplier", "rest")]


def _padded(c: Column, n: int) -> Column:
    """``c`` with zeros before it up to ``n`` characters; ``lpad`` alone would cut longer ones."""
    return F.lpad(c, F.greatest(F.length(c), F.lit(n)), "0")


#: name: (table, key, Spark column, SQL expression); both give one value for each row of the table.
RULES: dict[str, tuple[str, str, Callable[[], Column], str]] = {
    "p1_norm_code": ("part", "p_partkey", lambda: S.norm_code(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" x.0 "))), "upper(replace(p_brand, ' ', '')) || 'X'"),
    "p2_norm_instrument": ("part", "p_partkey", lambda: S.norm_instrument(F.col("p_partkey").cast("string")), "CASE WHEN length(p_partkey::VARCHAR) = 5 THEN '0' || p_partkey ELSE p_partkey::VARCHAR END"),
    "p2_norm_underlying": ("part", "p_partkey", lambda: S.norm_underlying(F.col("p_size").cast("string"), F.col("p_brand"), {"Brand#1": "9999"}), "CASE WHEN contains(p_brand, 'Brand#1') THEN '9999' ELSE lpad(p_size::VARCHAR, 4, '0') END"),
    "p3_norm_official_code": ("part", "p_partkey", lambda: S.norm_official_code(F.concat(F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.when(F.col("p_size") % 2 == 0, "e").otherwise("Xc"))), "lpad(p_partkey::VARCHAR, 6, '0')"),
    "p4_norm_query_code": ("part", "p_partkey", lambda: S.norm_query_code(F.concat(F.lit("'"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 5 == 0, "-").otherwise(""))), "CASE WHEN p_size % 5 <> 0 THEN CASE WHEN p_partkey < 1000 THEN lpad(p_partkey::VARCHAR, 4, '0') WHEN p_partkey < 1000000 THEN p_partkey::VARCHAR END END"),
    "p5_parse_day": ("orders", "o_orderkey", lambda: S.parse_day(F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy/M/d")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy'年'M'月'd'日'")).when(F.col("o_orderkey") % 4 == 2, F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("string")).otherwise("n/a")), "CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END"),
    "p6_roc_to_date": ("orders", "o_orderkey", lambda: S.roc_to_date(F.concat_ws("/", (F.year("o_orderdate") - 1911).cast("string"), F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string"))), "o_orderdate::DATE"),
    "p6_month_seq": ("orders", "o_orderkey", lambda: F.size(S.month_seq(F.to_date("o_orderdate"), F.lit("2002-12-31").cast("date"))).cast("long"), "(year(DATE '2002-12-31') - year(o_orderdate)) * 12 + 12 - month(o_orderdate) + 1"),
    "p7_parse_period": ("orders", "o_orderkey", lambda: F.datediff(S.parse_period(F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" ~ "), F.date_format(F.date_add(F.to_date("o_orderdate"), 30), "yyyy-MM-dd"))).otherwise("")))["end"], F.to_date("o_orderdate")).cast("long"), "CASE WHEN o_orderkey % 2 = 0 THEN 30 ELSE 0 END"),
    "p8_safe_double": ("lineitem", "l_orderkey * 10 + l_linenumber", lambda: S.safe_double(F.when(F.col("l_linenumber") == 3, "壞值").otherwise(F.concat(F.lit("＋"), F.format_number(F.col("l_quantity") * 1000, 0))), -1.0), "CASE WHEN l_linenumber = 3 THEN -1.0 ELSE l_quantity * 1000 END"),
    "p9_norm_return": ("supplier", "s_suppkey", lambda: S.norm_return(F.concat(F.col("s_acctbal").cast("string"), F.lit("%")), clamp=True), "greatest(s_acctbal, -100.0)"),
    "p10_norm_win_rate": ("lineitem", "l_orderkey * 10 + l_linenumber", lambda: F.bround(S.norm_win_rate(F.concat(F.col("l_discount").cast("string"), F.when(F.col("l_linenumber") == 1, "%").otherwise(""))), 6), "round_even(CASE WHEN l_linenumber = 1 THEN l_discount ELSE l_discount * 100 END, 6)"),
    "p12_norm_branch_name": ("supplier", "s_suppkey", lambda: S.norm_branch_name(F.concat("s_name", F.lit(" 證券（分公司）"))), "regexp_replace(lower(s_name), '[#\\s]', '', 'g')"),
    "p13_label_branch": ("supplier", "s_suppkey", lambda: S.label_branch(F.col("s_name"), PATTERNS), "CASE WHEN regexp_matches(s_name, '#1$') THEN 'one' WHEN regexp_matches(s_name, '[2-4]$') THEN 'low' WHEN regexp_matches(s_name, 'Supplier') THEN 'rest' END"),
    "p14_split_names": ("part", "p_partkey", lambda: F.array_join(S.split_names(F.concat_ws("、", "p_type", "p_brand", "p_type", F.lit(" "))), "|"), "p_type || '|' || p_brand"),
    "p15_parse_items": ("part", "p_partkey", lambda: F.array_join(F.transform(S.parse_items(F.concat(F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_type"), F.lit("；9 x;"))), lambda x: F.concat_ws("=", x["code"], x["name"])), "|"), "p_partkey || '=' || p_type || '|9=x'"),
    "p15_count_items": ("part", "p_partkey", lambda: S.count_items(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("1 a；共 "), F.col("p_size").cast("string"), F.lit(" 檔"))).otherwise("1 a；2 b")).cast("long"), "CASE WHEN p_size % 2 = 0 THEN p_size ELSE 2 END"),
    "p16_underlying_name": ("part", "p_partkey", lambda: S.underlying_name(F.col("p_name"), ISSUERS), "substr(CASE WHEN least(CASE WHEN instr(p_name, 'th') > 1 THEN instr(p_name, 'th') END, CASE WHEN instr(p_name, 'an') > 1 THEN instr(p_name, 'an') END, CASE WHEN instr(p_name, 'st') > 1 THEN instr(p_name, 'st') END) IS NOT NULL THEN substr(p_name, 1, least(CASE WHEN instr(p_name, 'th') > 1 THEN instr(p_name, 'th') END, CASE WHEN instr(p_name, 'an') > 1 THEN instr(p_name, 'an') END, CASE WHEN instr(p_name, 'st') > 1 THEN instr(p_name, 'st') END) - 1) ELSE p_name END, 1, 12)"),
    "p17_is_instrument_code": ("orders", "o_orderkey", lambda: S.is_instrument_code(_padded(F.col("o_orderkey").cast("string"), 5)), "regexp_matches(lpad(o_orderkey::VARCHAR, greatest(5, length(o_orderkey::VARCHAR))::INT, '0'), '^\\d{5,6}$') AND NOT starts_with(lpad(o_orderkey::VARCHAR, greatest(5, length(o_orderkey::VARCHAR))::INT, '0'), '00')"),
    "p18_norm_event": ("part", "p_partkey", lambda: S.norm_event(F.concat(F.lit("事件 "), F.when(F.col("p_size") % 3 == 0, "A、C").when(F.col("p_size") % 3 == 1, "E大量").otherwise("ABLE"))), "CASE p_size % 3 WHEN 0 THEN 'A/C' WHEN 1 THEN 'E' ELSE '' END"),
    "p19_stat_event_kind": ("part", "p_partkey", lambda: S.stat_event_kind(F.when(F.col("p_size") % 3 == 0, "總事件 A").when(F.col("p_size") % 3 == 1, "A事件").otherwise("B")), "CASE p_size % 3 WHEN 0 THEN 'total' WHEN 1 THEN 'A' END"),
    "p20_amount_class": ("orders", "o_orderkey", lambda: S.amount_class(F.col("o_totalprice"), (50_000, 60_000, 75_000, 90_000, 105_000)), "CASE WHEN o_totalprice >= 105000 THEN 'E' WHEN o_totalprice >= 90000 THEN 'D' WHEN o_totalprice >= 75000 THEN 'C' WHEN o_totalprice >= 60000 THEN 'B' WHEN o_totalprice >= 50000 THEN 'A' END"),
    "p21_result_tag": ("supplier", "s_suppkey", lambda: S.result_tag(F.col("s_acctbal")), "CASE WHEN s_acctbal > 0 THEN 'win' WHEN s_acctbal < 0 THEN 'loss' WHEN s_acctbal = 0 THEN 'tie' ELSE '' END"),
    "p22_sample_grade": ("part", "p_partkey", lambda: S.sample_grade(F.col("p_size") * 2), "CASE WHEN p_size * 2 < 15 THEN 'tiny' WHEN p_size * 2 < 30 THEN 'small' WHEN p_size * 2 < 60 THEN 'fair' ELSE 'solid' END"),
    "p23_position_bits": ("part", "p_partkey", lambda: S.bits_code(F.col("p_size") > 10, F.col("p_size") > 20, F.col("p_retailprice") > 1000), "(p_size > 10)::INT::VARCHAR || (p_size > 20)::INT::VARCHAR || (p_retailprice > 1000)::INT::VARCHAR"),
    "p24_low_level": ("part", "p_partkey", lambda: S.low_level(F.col("p_size") < 40, F.col("p_size") < 30, F.col("p_size") < 20, F.col("p_size") < 10), "CASE WHEN p_size < 10 THEN 4 WHEN p_size < 20 THEN 3 WHEN p_size < 30 THEN 2 WHEN p_size < 40 THEN 1 ELSE 0 END"),
    "p25_slope": ("supplier", "s_suppkey", lambda: S.slope(F.col("s_acctbal"), F.col("s_nationkey").cast("double") * 100), "CASE WHEN s_nationkey = 0 THEN CASE WHEN abs(s_acctbal) <= 0.001 THEN 'flat' WHEN s_acctbal > 0 THEN 'up' ELSE 'down' END WHEN abs((s_acctbal - s_nationkey * 100.0) / (s_nationkey * 100.0)) <= 0.001 THEN 'flat' WHEN s_acctbal > s_nationkey * 100.0 THEN 'up' ELSE 'down' END"),
    "p28_fix_mojibake": ("part", "p_partkey", lambda: S.fix_mojibake(F.when(F.col("p_size") % 2 == 0, F.decode(F.encode(F.lit("台積電"), "UTF-8"), "ISO-8859-1")).otherwise(F.col("p_name"))), "CASE WHEN p_size % 2 = 0 THEN '台積電' ELSE p_name END"),
    "p29_fmt_amount": ("orders", "o_orderkey", lambda: S.fmt_amount(F.round("o_totalprice").cast("long") * F.when(F.col("o_orderkey") % 2 == 0, 10000).otherwise(1000)), "CASE WHEN (round(o_totalprice)::BIGINT * CASE WHEN o_orderkey % 2 = 0 THEN 10000 ELSE 1000 END) >= 1e8 THEN rtrim(rtrim(printf('%.2f', (round(o_totalprice)::BIGINT * CASE WHEN o_orderkey % 2 = 0 THEN 10000 ELSE 1000 END) / 1e8), '0'), '.') || ' 億' ELSE printf('%.1f', (round(o_totalprice)::BIGINT * CASE WHEN o_orderkey % 2 = 0 THEN 10000 ELSE 1000 END) / 1e4) || ' 萬' END"),
    "p33_settlement_value": ("part", "p_partkey", lambda: F.bround(S.settlement_value(F.when(F.col("p_size") % 2 == 0, "put").otherwise("call"), F.lit(1000.0), F.col("p_retailprice"), F.lit(0.1), 0.001, F.col("p_size") % 5 > 0), 6), "round_even(CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE greatest(CASE WHEN p_size % 2 = 0 THEN 1000.0 - p_retailprice ELSE p_retailprice - 1000.0 END, 0.0) * 0.1 * (1 - 0.001) END, 6)"),
    "p34_threshold_day": ("orders", "o_orderkey", lambda: S.threshold_day(F.to_date("o_orderdate"), 2), "(o_orderdate::DATE + INTERVAL 2 MONTH)::DATE"),
    "p35_target_day": ("events", "event_id", lambda: S.target_day(F.col("ts")), "CASE WHEN isodow(ts) < 6 AND hour(ts) >= 17 THEN ts::DATE ELSE ts::DATE - CASE isodow(ts) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END END"),
    "p36_safe_ratio": ("supplier", "s_suppkey", lambda: F.bround(S.safe_ratio(F.col("s_nationkey").cast("double"), F.col("s_acctbal")), 10), "round_even(CASE WHEN s_acctbal > 0 THEN s_nationkey / s_acctbal END, 10)"),
    "p38_parse_broker_text": ("supplier", "s_suppkey", lambda: F.aggregate(S.parse_broker_text(F.concat("s_name", F.lit(" 1,234.5萬（+5.2%）；x 2萬"))), F.lit(0.0), lambda a, x: a + x["amount"] + F.coalesce(x["ret"], F.lit(0.0))), "1241.7"),
    "p39_parse_bool": ("part", "p_partkey", lambda: S.parse_bool(F.when(F.col("p_size") % 3 == 0, " Yes").when(F.col("p_size") % 3 == 1, "是").otherwise("no")), "p_size % 3 < 2"),
}


def _query(table: str, key: str, value: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.expr(key).cast("long").alias("key"), value().alias("value"))


QUERIES = {name: _query(table, key, value) for name, (table, key, value, _) in RULES.items()}
ORACLE_SQL = {name: f"SELECT ({key})::BIGINT AS key, {sql} AS value FROM {table}" for name, (table, key, _, sql) in RULES.items()}
