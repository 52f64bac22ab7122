"""Queries of partitioned folders and logs on disk, nearest names, staged backfill, target texts and recomputed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity, monitor, quality, stats
from ..sources import tables as T
from . import flow_queries as Q
from . import identity_queries as I
from . import views as V

_DAILY = "l_orderkey long, l_partkey long, l_suppkey long, row_day date"


def _daily_folder(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Months as days: in May some rows are of another day, July lacks a column, and the year before has no folders."""
    path = T.shared_path(s, "daily")
    day = F.trunc("l_shipdate", "month")
    rows = V.table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.when((F.month(day) == 5) & (F.dayofmonth("l_shipdate") == 13), F.date_add(day, 1)).otherwise(day).alias("row_day"), day.alias("day"))
    rows.where("month(day) <> 7").write.partitionBy("day").parquet(path)
    rows.where("month(day) = 7").drop("l_suppkey").write.mode("append").partitionBy("day").parquet(path)
    ends = rows.agg(F.add_months(F.min("day"), -12).alias("a"), F.max("day").alias("z"))
    expected = ends.select(F.explode(F.expr("sequence(a, z, interval 1 month)")).alias("day"))
    return T.scan_daily_folder(s, path, _DAILY, ["l_orderkey", "l_suppkey"], "row_day", expected)


def _shard_folder(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = T.shared_path(s, "shards")
    o = V.table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderpriority")).alias("target"), F.col("o_orderpriority").alias("shard"))
    o.where("shard <> '1-URGENT' or target <> 'X'").write.partitionBy("shard").parquet(path)
    asked = V.table(s, d, "orders").select(F.col("o_orderpriority").alias("shard")).distinct().where("shard not like '2%'").union(s.range(1).select(F.lit("9-NONE")))
    return T.scan_shards(s, path, "o_orderkey long, day date, target string", asked, "target", "day", "1900-01-01", "2100-01-01")


def _log(s: SparkSession, d: str) -> DataFrame:
    path = T.shared_path(s, "log")
    o = V.table(s, d, "orders")
    T.append_run(o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus"), path, "a")
    T.append_run(o.where("o_orderkey % 3 = 1").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, "b")
    T.append_run(o.where("o_orderkey % 3 = 2").select("o_orderkey", "o_totalprice", "o_orderpriority"), path, "c")
    T.append_run(o.where("o_orderkey % 3 = 1").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, "b")
    return T.read_log(s, path).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "run")


def _near(s: SparkSession, d: str) -> DataFrame:
    """Misspelled names: a wrong first character, a missing third one, words the other way round."""
    p = V.table(s, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("n"))
    k = F.col("p_partkey") % 50
    bad = F.when(k == 0, F.concat(F.lit("q"), F.substring("n", 2, 99))).when(k == 1, F.concat(F.substring("n", 1, 2), F.substring("n", 4, 99))).when(k == 2, F.reverse("n"))
    return identity.nearest_names(p.where(k <= 2).select(bad.alias("name")), p.select(F.col("n").alias("dir_name")))


def _branches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(configured, directory, aliases): names with brackets and hyphens, some misspelled, some of several parts, some by an alias."""
    p = V.table(s, d, "part").select("p_partkey", F.concat_ws("-", "p_name", "p_brand").alias("n"))
    k = F.col("p_partkey") % 60
    said = F.when(k == 0, F.concat(F.lit("q"), F.substring("n", 2, 99))).when(k == 1, F.concat(F.lit("("), F.substring("n", 1, 2), F.substring("n", 4, 99), F.lit(")"))).when(k == 2, F.upper("n")).when(k == 3, F.concat(F.lit("other "), F.col("p_partkey").cast("string")))
    asked = p.where(k <= 3)
    return asked.select(said.alias("name")), p.select(F.col("p_partkey").alias("code"), F.col("n").alias("dir_name")), asked.where(k == 3).select(said.alias("name"), F.concat(F.col("n"), F.lit("x")).alias("alias"))


def _with_shard(s: SparkSession, d: str) -> DataFrame:
    nations = V.table(s, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_nationkey").cast("string").alias("shard"))
    return I.unique_intervals(s, d).join(nations, "code")


def shard_table(s: SparkSession, d: str) -> DataFrame:
    path = T.shared_path(s, "intervals")
    rows = _with_shard(s, d)
    rows.write.partitionBy("shard").parquet(path)
    return s.read.schema(rows.drop("shard").schema.add("shard", "string")).parquet(path)


def candidates(s: SparkSession, d: str) -> DataFrame:
    """Two thirds of the codes have a candidate shard; one in seven of these a wrong one."""
    c = V.table(s, d, "customer").where("c_custkey % 3 <> 0")
    return c.select(F.col("c_custkey").alias("code"), ((F.col("c_nationkey") + (F.col("c_custkey") % 7 == 0).cast("int")) % 25).cast("string").alias("shard"))


def _backfill(s: SparkSession, d: str) -> DataFrame:
    seed = I.unique_intervals(s, d).where("seq % 4 = 0")
    return identity.backfill_candidates(I.pair_facts(s, d), seed, shard_table(s, d), candidates(s, d)).select("o_orderkey", "l_linenumber", "id_status", "id_target")


def instrument_names(s: SparkSession, d: str) -> DataFrame:
    """Names of codes: of four, one begins with the whole name of its shard, one with three characters, one with two, which are too few, and one has none."""
    c = V.table(s, d, "customer").join(V.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat("n_name", F.lit(" Issuer"))).when(k == 1, F.concat(F.substring("n_name", 1, 3), F.lit("9 Issuer"))).when(k == 2, F.concat(F.substring("n_name", 1, 2), F.lit("9 Issuer")))
    return c.select(F.col("c_custkey").alias("code"), name.alias("name"))


def named_candidates(s: SparkSession, d: str, seed: DataFrame) -> DataFrame:
    master = V.table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("target"))
    return identity.candidate_shards(instrument_names(s, d), identity.prefix_aliases(master), seed)


def _backfill_by_names(s: SparkSession, d: str) -> DataFrame:
    seed = I.unique_intervals(s, d).where("seq % 4 = 0")
    return identity.backfill_candidates(I.pair_facts(s, d), seed, shard_table(s, d), named_candidates(s, d, seed)).select("o_orderkey", "l_linenumber", "id_status", "id_target")


def _target_texts(s: SparkSession, d: str) -> DataFrame:
    names = V.table(s, d, "nation").select((F.col("n_nationkey") + 1000).cast("string").alias("code"), F.col("n_name").alias("name"))
    c = V.table(s, d, "customer").join(V.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, own = F.col("c_custkey") % 7, (F.col("n_nationkey") + 1000).cast("string")
    rows = c.select(
        "c_custkey", F.when(k == 0, own).when(k.isin(2, 3), "51234").when(k == 6, "0050").alias("code"), F.when(k == 3, "Nowhere").when(k.isin(5, 6), F.col("n_name")).alias("name"),
        F.when(k == 1, F.concat(own, F.lit(" "), "n_name")).when(k == 4, "plain text").when(k == 5, F.concat(own, F.lit("-other"))).alias("raw_target"), F.when(k == 2, F.concat(F.lit("51234 "), "n_name", F.lit("IssuerX01 ; more"))).alias("instrument"),
    )
    return identity.resolve_target_texts(rows, names, ["IssuerX", "Other"]).select("c_custkey", "target_code", "target_name", "target_label")


def _tampered(s: SparkSession, d: str) -> DataFrame:
    """Published condition statistics, of which one branch's wins in one condition were changed and one branch's rows of another are gone."""
    done = V.outcomes(s, d)
    held = {k: F.expr(v) for k, v in Q.CONDITIONS.items()}
    shown = stats.condition_stats(done, held).where("not (broker = 3 and condition = 'monday')").withColumn("n_win", F.col("n_win") + ((F.col("broker") == 4) & (F.col("condition") == "large")).cast("int"))
    again = quality.recompute(done, "condition", held, ["ALL", "A", "B", "C", "D", "E"])
    off = quality.check_traceable(shown, again, ["broker", "condition", "code"])
    return off.groupBy("broker", "condition", "code").agg(F.max(F.when(F.col("column") == "n_win", 1).otherwise(0)).alias("win"))


def _tampered_positions(s: SparkSession, d: str) -> DataFrame:
    done = V.outcomes(s, d).withColumn("position", F.expr(Q._POSITION))
    shown = stats.position_stats(done, "position", Q.POSITIONS).withColumn("n_tie", F.col("n_tie") + ((F.col("broker") == 5) & (F.col("position") == "011")).cast("int"))
    again = quality.recompute(done, "position", {p: F.col("position") == p for p in Q.POSITIONS}, ["ALL", "A", "B", "C", "D", "E"])
    return quality.check_traceable(shown, again, ["broker", "position", "code"])


QUERIES = {
    "s1_scan_daily_folder": lambda s, d: _daily_folder(s, d)[1],
    "s1_good_days_folder": lambda s, d: _daily_folder(s, d)[0].select("l_orderkey", "l_partkey", "l_suppkey", "row_day", "day"),
    "s16_scan_shards": lambda s, d: _shard_folder(s, d)[1],
    "s16_accepted_rows": lambda s, d: _shard_folder(s, d)[0].select("o_orderkey", "day", "target", "shard"),
    "s10_append_runs": _log,
    "j13_nearest_names": _near,
    "j13_suggest_branches": lambda s, d: identity.suggest_branches(*_branches(s, d)),
    "j14_backfill_candidates": _backfill,
    "j14_candidate_shards": lambda s, d: named_candidates(s, d, I.unique_intervals(s, d).where("seq % 4 = 0")),
    "j14_backfill_by_names": _backfill_by_names,
    "p30_resolve_target_texts": _target_texts,
    "q3_recomputed_conditions": _tampered,
    "q3_recomputed_positions": _tampered_positions,
    "a12_md5_fingerprint": lambda s, d: monitor.md5_fingerprint(V.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"], ["l_suppkey"]),
}

_MONTHS = "m AS (SELECT l_orderkey, l_partkey, l_suppkey, date_trunc('month', l_shipdate)::DATE AS day, CASE WHEN month(l_shipdate) = 5 AND day(l_shipdate) = 13 THEN date_trunc('month', l_shipdate)::DATE + 1 ELSE date_trunc('month', l_shipdate)::DATE END AS row_day FROM lineitem), sums AS (SELECT day, count(*) AS raw_rows, count(*) FILTER (row_day <> day) AS invalid_rows FROM m GROUP BY day), st AS (SELECT e.day, coalesce(raw_rows, 0) AS raw_rows, coalesce(invalid_rows, 0) AS invalid_rows, CASE WHEN raw_rows IS NULL THEN NULL WHEN month(e.day) = 7 THEN 'l_suppkey' ELSE '' END AS missing, CASE WHEN raw_rows IS NULL THEN 'empty' WHEN month(e.day) = 7 THEN 'missing columns' WHEN invalid_rows > 0 THEN 'failed' ELSE 'success' END AS status FROM (SELECT unnest(generate_series((SELECT min(day) FROM sums) - INTERVAL 12 MONTH, (SELECT max(day) FROM sums), INTERVAL 1 MONTH))::DATE AS day) e LEFT JOIN sums USING (day))"
_SHARDS = "o AS (SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderpriority END AS target, o_orderpriority AS shard FROM orders), w AS (SELECT * FROM o WHERE (shard <> '1-URGENT' OR target <> 'X') AND shard NOT LIKE '2%')"


def _stage(n: int, intervals: str) -> str:
    """matched{n} and open{n} of the pairs that stage n - 1 has left, against ``intervals``."""
    key = "(i.list_date - DATE '1970-01-01') * 100000 - (i.end_date - DATE '1970-01-01')"
    return f"""hits{n} AS (SELECT p.code, p.day, CASE WHEN count(DISTINCT nullif(i.target, '')) > 1 THEN NULL ELSE arg_max(i.target, {key}) END AS id_target, CASE WHEN count(DISTINCT nullif(i.target, '')) > 1 THEN 'Ambiguous' ELSE arg_max(i.status, {key}) END AS id_status
    FROM open{n - 1} p JOIN ({intervals}) i ON p.code = i.code AND p.day BETWEEN i.list_date AND i.end_date GROUP BY p.code, p.day),
  matched{n} AS (SELECT * FROM hits{n} WHERE id_status <> 'Unmatched'), open{n} AS (SELECT code, day FROM open{n - 1} EXCEPT SELECT code, day FROM matched{n})"""


_CANDIDATES = "cand AS (SELECT c_custkey AS code, ((c_nationkey + (c_custkey % 7 = 0)::INT) % 25)::VARCHAR AS shard FROM customer WHERE c_custkey % 3 <> 0)"
_NAMED = """full_names AS (SELECT replace(n_name, ' ', '') AS nm, n_nationkey::VARCHAR AS target FROM nation),
  al0 AS (SELECT nm AS alias, target, nm, 1 AS exact FROM full_names UNION ALL SELECT substr(nm, 1, k), target, nm, 0 FROM full_names, (VALUES (2), (3), (4)) t(k) WHERE length(nm) > k AND substr(nm, 1, k) NOT IN (SELECT nm FROM full_names)),
  al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY exact DESC, length(nm) DESC, target) AS r FROM al0) WHERE r = 1),
  said AS (SELECT c_custkey AS code, replace(CASE c_custkey % 4 WHEN 0 THEN n_name || ' Issuer' WHEN 1 THEN substr(n_name, 1, 3) || '9 Issuer' WHEN 2 THEN substr(n_name, 1, 2) || '9 Issuer' END, ' ', '') AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
  begun AS (SELECT * FROM (SELECT s.code, a.target, a.exact, a.alias, row_number() OVER (PARTITION BY s.code ORDER BY length(a.alias) DESC) AS r FROM said s JOIN al a ON starts_with(s.name, a.alias)) WHERE r = 1),
  cand AS (SELECT code, target AS shard FROM begun WHERE exact = 1 OR length(alias) >= 3 UNION SELECT code, target FROM uniq WHERE seq % 4 = 0 AND target <> '')"""


def _backfill_sql(cand: str) -> str:
    return f"""WITH {I._RESOLVED}, sh AS (SELECT u.*, c_nationkey::VARCHAR AS shard FROM uniq u JOIN customer ON code = c_custkey), {cand},
  open0 AS (SELECT DISTINCT code, day FROM pairs), {_stage(1, "SELECT * FROM uniq WHERE seq % 4 = 0")},
  asked AS (SELECT DISTINCT shard FROM cand WHERE code IN (SELECT code FROM open1)), {_stage(2, "SELECT * FROM sh WHERE seq % 4 = 0 OR shard IN (SELECT shard FROM asked)")},
  {_stage(3, "SELECT * FROM uniq WHERE (SELECT count(*) FROM open2) > 0.05 * (SELECT count(*) FROM open0)")},
  found AS (SELECT * FROM matched1 UNION ALL SELECT * FROM matched2 UNION ALL SELECT * FROM matched3)
SELECT o_orderkey, l_linenumber, coalesce(f.id_status, 'Unmatched') AS id_status, f.id_target FROM pairs p LEFT JOIN found f ON p.code = f.code AND p.day = f.day"""


_SUGGEST = r"""WITH p AS (SELECT p_partkey, p_name || '-' || p_brand AS n, p_partkey % 60 AS k FROM part), d AS (SELECT p_partkey AS code, n, regexp_replace(lower(n), '[\s\-_()#]', '', 'g') AS m FROM p),
  w AS (SELECT DISTINCT CASE k WHEN 0 THEN 'q' || substr(n, 2) WHEN 1 THEN '(' || substr(n, 1, 2) || substr(n, 4) || ')' WHEN 2 THEN upper(n) ELSE 'other ' || p_partkey END AS name, CASE k WHEN 3 THEN n || 'x' END AS alias FROM p WHERE k <= 3),
  x AS (SELECT name, regexp_replace(lower(coalesce(alias, name)), '[\s\-_()#]', '', 'g') AS m FROM w),
  g AS (SELECT m, count(*) AS hits, string_agg(n || '(' || code || ')', ', ' ORDER BY code) AS every, arg_min(n || '(' || code || ')', code) AS first FROM d GROUP BY m),
  r AS (SELECT x.name, g.first, row_number() OVER (PARTITION BY x.name ORDER BY levenshtein(x.m, g.m), g.m) AS r FROM x, g WHERE x.m NOT IN (SELECT m FROM g) AND levenshtein(x.m, g.m) <= floor(0.55 * greatest(length(x.m), length(g.m)) + 1e-9))
SELECT name, 'several' AS reason, every AS suggestions FROM x JOIN g USING (m) WHERE hits > 1
UNION ALL SELECT x.name, 'none', coalesce((SELECT string_agg(first, ', ' ORDER BY r) FROM r WHERE r.name = x.name AND r <= 5), '') FROM x WHERE m NOT IN (SELECT m FROM g)"""

ORACLE_SQL = {
    "s1_scan_daily_folder": f"WITH {_MONTHS} SELECT * FROM st",
    "s1_good_days_folder": f"WITH {_MONTHS} SELECT l_orderkey, l_partkey, l_suppkey, row_day, day FROM m WHERE day IN (SELECT day FROM st WHERE status = 'success')",
    "s16_scan_shards": f"WITH {_SHARDS} SELECT *, CASE WHEN rows = 0 THEN 'empty' WHEN violations > 0 THEN 'violations' ELSE 'success' END AS status FROM (SELECT shard, count(*) AS rows, count(*) FILTER (target <> shard) AS violations FROM w GROUP BY shard UNION ALL SELECT '9-NONE', 0, 0)",
    "s16_accepted_rows": f"WITH {_SHARDS} SELECT * FROM w WHERE target = shard",
    "s10_append_runs": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice END AS o_totalprice, substr('abc', (o_orderkey % 3 + 1)::INT, 1) AS run FROM orders",
    "j13_nearest_names": "WITH p AS (SELECT p_partkey % 50 AS k, p_name || ' ' || p_brand AS n FROM part), w AS (SELECT DISTINCT CASE k WHEN 0 THEN 'q' || substr(n, 2) WHEN 1 THEN substr(n, 1, 2) || substr(n, 4) ELSE reverse(n) END AS name FROM p WHERE k <= 2), d AS (SELECT DISTINCT n AS dir_name FROM p), c AS (SELECT name, dir_name, levenshtein(name, dir_name)::INT AS distance FROM w, d) SELECT name, rank::INT AS rank, dir_name, distance FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, dir_name) AS rank FROM c WHERE distance <= floor(0.55 * greatest(length(name), length(dir_name)) + 1e-9)) WHERE rank <= 5",
    "j13_suggest_branches": _SUGGEST,
    "j14_backfill_candidates": _backfill_sql(_CANDIDATES),
    "j14_candidate_shards": f"WITH {I._RESOLVED}, {_NAMED} SELECT code, shard FROM cand",
    "j14_backfill_by_names": _backfill_sql(_NAMED),
    "p30_resolve_target_texts": "SELECT c_custkey, CASE c_custkey % 7 WHEN 3 THEN '' WHEN 4 THEN '' WHEN 6 THEN '0050' ELSE (n_nationkey + 1000)::VARCHAR END AS target_code, CASE c_custkey % 7 WHEN 3 THEN 'Nowhere' WHEN 4 THEN '' ELSE n_name END AS target_name, CASE c_custkey % 7 WHEN 3 THEN 'Nowhere' WHEN 4 THEN 'plain text' WHEN 6 THEN '0050 ' || n_name ELSE (n_nationkey + 1000) || ' ' || n_name END AS target_label FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "q3_recomputed_conditions": f"WITH {V.OUTCOMES}, {Q._GRID} SELECT broker, condition, code, CASE WHEN condition = 'large' THEN 1 ELSE 0 END::INT AS win FROM grid WHERE broker = 4 AND condition = 'large' UNION ALL SELECT g.broker, g.condition, g.code, 1 AS win FROM grid g WHERE broker = 3 AND condition = 'monday'",
    "q3_recomputed_positions": "SELECT 5::BIGINT AS broker, '011' AS position, code, 'n_tie' AS \"column\" FROM (VALUES ('ALL'), ('A'), ('B'), ('C'), ('D'), ('E')) t(code)",
    "a12_md5_fingerprint": "SELECT l_suppkey, count(*) AS rows, bit_xor(h) AS mark, (sum(h) % 2305843009213693951)::BIGINT AS total FROM (SELECT l_suppkey, ('0x' || substr(md5(l_orderkey || chr(1) || l_linenumber || chr(1) || l_returnflag), 1, 15))::BIGINT AS h FROM lineitem) GROUP BY l_suppkey",
}
