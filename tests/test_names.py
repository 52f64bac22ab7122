"""Nearest names, staged backfill, target texts, folders and logs against plain versions."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import identity, quality, stats
from flowlens.sources import tables as T

DAY = datetime.date(2021, 3, 1)


def on(k: int) -> datetime.date:
    return DAY + datetime.timedelta(days=k)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def literal_nearest(wanted, directory, near, cutoff):
    for name in sorted(set(wanted)):
        ranked = sorted((distance(name, d), d) for d in set(directory) if d and name)
        ranked = [(k, d) for k, d in ranked if k <= int((1 - cutoff) * max(len(name), len(d)) + 1e-9)]
        yield from ((name, r, d, k) for r, (k, d) in enumerate(ranked[:near], 1))


@pytest.mark.parametrize(("near", "cutoff"), [(5, 0.45), (1, 0.45), (3, 0.8), (50, 0.2)])
def test_nearest_names_against_all_names(spark, near, cutoff):
    rng = random.Random(near)
    words = ["台積電", "元大台灣50", "凱基台北", "凱基-台北", "富邦建國", "aaaa", "aaab", "abab", "b", "branch one", "branch two", ""]
    directory = [w + rng.choice(["", "分點", "x", " b"]) for w in words for _ in range(3)] + ["".join(rng.choices("abc字", k=rng.randint(1, 12))) for _ in range(60)]
    wanted = ["".join(rng.choices("abc字台", k=rng.randint(1, 14))) for _ in range(25)] + ["x積電分點", "日積電", "", "元大台50", "zzzzzzzzzzzzzzzzzzzz", directory[0]]
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = identity.nearest_names(frame(wanted, "name"), frame(directory, "dir_name"), near, cutoff)
    assert sorted(map(tuple, got.collect())) == sorted(literal_nearest(wanted, directory, near, cutoff))
    assert identity.nearest_names(frame([], "name"), frame(directory, "dir_name")).count() == 0


def test_suggestions_for_branches(spark):
    directory = [(3, "凱基-台北"), (1, "凱基台北分公司"), (5, "富邦建國"), (6, "富邦 建國2"), (7, "Alpha (One)"), (8, "證券"), (9, "alpha-two"), (2, "alpha one x")]
    asked = [("凱基台北",), ("富邦建國",), ("kgi",), ("x凱基台北y",), ("ALPHA ONE Y",), ("zzzzzzzzzz",), ("證券",), (None,), ("kgi",)]
    frames = (spark.createDataFrame(asked, "name string"), spark.createDataFrame(directory, "code int, dir_name string"), spark.createDataFrame([("kgi", "凱基 台北"), ("unused", "富邦建國")], "name string, alias string"))
    said = {r["name"]: (r["code"], r["status"]) for r in identity.resolve_branches(*frames).collect()}
    assert said["富邦建國"] == (5, "resolved") and all(v == (None, "unresolved") for k, v in said.items() if k != "富邦建國")
    got = identity.suggest_branches(*frames, near=2).collect()
    both = "凱基台北分公司(1), 凱基-台北(3)"
    assert {r["name"]: (r["reason"], r["suggestions"]) for r in got} == {
        "凱基台北": ("several", both), "kgi": ("several", both), "x凱基台北y": ("none", "凱基台北分公司(1)"), "ALPHA ONE Y": ("none", "Alpha (One)(7), alpha one x(2)"), "zzzzzzzzzz": ("none", ""), "證券": ("none", ""), None: ("none", ""),
    }
    assert len(got) == 7
    none = frames[0].limit(0)
    assert identity.suggest_branches(none, *frames[1:]).count() == 0 and identity.suggest_branches(frames[0], frames[1].limit(0), frames[2]).where("suggestions <> ''").count() == 0


INTERVALS = "code long, list_date date, end_date date, target string, name string, status string, seq long"


def intervals(spark, rows):
    return spark.createDataFrame([(c, on(a), on(z), t, f"n{t}", "Matched", k) for k, (c, a, z, t) in enumerate(rows)], INTERVALS)


def shards_at(spark, path, rows):
    intervals(spark, [r[:4] for r in rows]).join(spark.createDataFrame([(k, r[4]) for k, r in enumerate(rows)], "seq long, shard string"), "seq").write.partitionBy("shard").parquet(path)
    return spark.read.schema(INTERVALS + ", shard string").parquet(path)


def test_backfill_by_stages(spark, tmp_path):
    seed = intervals(spark, [(1, 0, 9, "A")])
    shards = shards_at(spark, str(tmp_path / "s"), [(1, 0, 9, "Z", "z"), (2, 0, 9, "B", "b"), (3, 0, 9, "C", "c"), (4, 0, 9, "D", "d")])
    candidates = spark.createDataFrame([(1, "z"), (2, "b"), (4, "c"), (9, "b")], "code long, shard string")
    facts = spark.createDataFrame([(c, None if d is None else on(d), k) for k, (c, d) in enumerate([(1, 3), (1, 3), (2, 3), (3, 3), (4, 3), (4, 30), (None, 3), (5, None)])], "code long, day date, k int")
    run = lambda most: {r["k"]: (r["id_status"], r["id_target"]) for r in identity.backfill_candidates(facts, seed, shards, candidates, most).collect()}
    none = ("Unmatched", None)
    after_two = {0: ("Matched", "A"), 1: ("Matched", "A"), 2: ("Matched", "B"), 3: ("Matched", "C"), 4: none, 5: none, 6: none, 7: none}
    assert run(1.0) == after_two  # code 3 is in a shard that was asked for code 4; 4 of 7 pairs are open
    assert run(4 / 7) == after_two
    assert run(0.5) == after_two | {4: ("Matched", "D")}


def test_backfill_resolves_what_is_open(spark):
    first, second = intervals(spark, [(1, 0, 9, "A")]), intervals(spark, [(1, 0, 9, "Z"), (2, 0, 9, "B"), (3, 0, 9, "C"), (3, 0, 8, "D")])
    facts = spark.createDataFrame([(c, None if d is None else on(d), k) for k, (c, d) in enumerate([(1, 3), (1, 3), (2, 3), (3, 3), (4, 3), (None, 3), (2, None)])], "code long, day date, k int")
    run = lambda sources, most: {r["k"]: (r["id_status"], r["id_target"]) for r in identity.backfill_identity(facts, sources, most).collect()}
    none = ("Unmatched", None)
    one = {0: ("Matched", "A"), 1: ("Matched", "A")} | dict.fromkeys(range(2, 7), none)
    assert run([first], 0.0) == run([first, second], 5 / 6) == one  # 5 of 6 pairs are open
    assert run([first, second], 0.5) == one | {2: ("Matched", "B"), 3: ("Ambiguous", None)}
    assert identity.backfill_identity(facts.limit(0), [first, second], 0.0).count() == 0


def test_candidate_shards_of_names(spark):
    aliases = identity.prefix_aliases(spark.createDataFrame([("台積電", "2330"), ("台達電子", "2308"), ("聯電", "2303")], "name string, target string"))
    names = spark.createDataFrame([(1, "台積電凱基01"), (1, "台積電凱基01"), (2, "台達元大"), (3, "台 達 電元大"), (4, "聯電群益"), (5, "無名"), (6, None), (None, "台積電"), (7, "元大台灣50購")], "code long, name string")
    known = intervals(spark, [(2, 0, 9, "X"), (5, 0, 9, ""), (8, 0, 9, None), (1, 0, 9, "2330")])
    got = sorted(tuple(r) for r in identity.candidate_shards(names, aliases, known).collect())
    assert got == [(1, "2330"), (2, "X"), (3, "2308"), (4, "2303"), (7, "0050")]  # two characters of 台達電子 are too few, all two of 聯電 are not


def test_candidates_read_their_folders_only(spark, tmp_path):
    shards = shards_at(spark, str(tmp_path / "s"), [(k, 0, 9, f"T{k}", f"s{k}") for k in range(12)])
    asked = T.stored(spark.createDataFrame([("s3",), ("s7",)], "shard string"), "asked")
    found = identity.candidate_intervals(shards, asked)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(r["code"] for r in found.collect()) == [3, 7]


def literal_target(row, names):
    code, name, raw, said = (x.strip() if x else "" for x in row)
    import re

    unfit = lambda c: not c or bool(re.fullmatch(r"\d{5,6}", c) and not c.startswith("00"))
    first = next((x for x in (said, raw, name) if x), "")
    item = next((x.strip() for x in re.split("[;；]", first) if x.strip()), "")
    item = re.sub(r"^\d+\s*", "", item).strip()
    places = [item.find(t) for t in ("Iss", "Other") if item.find(t) > 0]
    inferred = item[: min(places)].strip() if places and len(item[: min(places)].strip()) <= 12 else ""
    m = re.match(r"^(\d{4})(?:\s+|[-_])?(.*)$", raw, re.S)
    code = re.sub(r"\s+", "", re.sub(r"\.0$", "", code.upper()))
    code = code.zfill(4) if re.fullmatch(r"\d{1,3}", code) else code
    if unfit(code) and m:
        code = m[1]
    name = name or (m[2].strip() if m else "") or inferred
    if not unfit(code) and not name:
        name = min((n for c, n in names if c == code), default="")
    if unfit(code) and name:
        plain = lambda x: re.sub(r"\s+", "", x).replace("臺", "台")
        mapped = min((c for c, n in names if plain(n) == plain(name)), default="")
        code = mapped or ("" if re.fullmatch(r"\d{5,6}", code) else code)
    return code, name, f"{code} {name}".strip() if name else raw or code


def test_target_texts_against_a_literal_chain(spark):
    names = [("2330", "台積電"), ("0050", "元大台灣50"), ("1101", "台 泥"), ("2454", "聯發科"), ("9999", "台積電")]
    texts = [None, "", "2330", "50", "53021", "臺積電", "聯發科", "2330 台積電", "2454_聯發科", "1101", "047358 台積電Iss6C01；others", "；；53021聯發科Iss5B", "臺泥Other01", "a very long name beforeIss", "IssuerFirst", "99", "00631"]
    rng = random.Random(3)
    rows = [tuple(rng.choice(texts) for _ in range(4)) for _ in range(600)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, code string, name string, raw_target string, instrument string")
    got = {r["k"]: (r["target_code"], r["target_name"], r["target_label"]) for r in identity.resolve_target_texts(df, spark.createDataFrame(names, "code string, name string"), ["Iss", "Other"]).collect()}
    assert got == {k: literal_target(r, names) for k, r in enumerate(rows)}


def test_folder_scans_open_what_is_asked(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.createDataFrame([(k, on(k % 6), k) for k in range(60)], "x int, day date, y int").withColumn("row_day", F.when(F.col("x") == 7, F.lit(on(99))).otherwise(F.col("day")))
    rows.where("x % 6 <> 2").write.partitionBy("day").parquet(path)
    rows.where("x % 6 = 2").drop("y").write.mode("append").partitionBy("day").parquet(path)
    expected = spark.createDataFrame([(on(k),) for k in (0, 1, 2, 3, 50)], "day date")
    good, status = T.scan_daily_folder(spark, path, "x int, y int, row_day date", ["x", "y"], "row_day", expected)
    assert {(r["day"], r["status"], r["raw_rows"], r["invalid_rows"]) for r in status.collect()} == {(on(0), "success", 10, 0), (on(1), "failed", 10, 1), (on(2), "missing columns", 10, 0), (on(3), "success", 10, 0), (on(50), "empty", 0, 0)}
    assert {r["day"] for r in good.select("day").distinct().collect()} == {on(0), on(3)}
    assert "dynamicpruning" in good._jdf.queryExecution().executedPlan().toString().lower()


def test_shards_that_are_asked(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(k, on(k), f"T{k % 4}" if k != 9 else "T0", f"T{k % 4}") for k in range(40)], "x int, day date, target string, shard string")
    rows.write.partitionBy("shard").parquet(path)
    asked = spark.createDataFrame([("T1",), ("T2",), ("T9",), ("",)], "shard string")
    good, status = T.scan_shards(spark, path, "x int, day date, target string", asked, "target", "day", on(0), on(29))
    assert {tuple(r) for r in status.collect()} == {("T1", 10, 3, "violations"), ("T2", 10, 3, "violations"), ("T9", 0, 0, "empty")}
    assert sorted(r["x"] for r in good.collect()) == [k for k in range(30) if k % 4 in (1, 2) and k != 9]
    assert "dynamicpruning" in good._jdf.queryExecution().executedPlan().toString().lower()


def test_log_of_runs_with_added_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    for run, columns in (("r1", "a"), ("r2", "ab"), ("r3", "abc"), ("r2", "ab"), ("r1", "a")):
        T.append_run(spark.createDataFrame([tuple(range(len(columns)))] * 2, ", ".join(f"{c} int" for c in columns)), path, run)
    got = sorted((r["run"], r["a"], r["b"], r["c"]) for r in T.read_log(spark, path).collect())
    assert got == [("r1", 0, None, None)] * 2 + [("r2", 0, 1, None)] * 2 + [("r3", 0, 1, 2)] * 2


def test_an_error_in_the_published_statistics_shows(spark):
    rng = random.Random(8)
    rows = [(b, f"{b}-{k}", on(k), rng.choice("ABE"), rng.choice(["open", "reduced", "closed"]), rng.choice([None, 0.0, -1.5, 2.25]), rng.randint(1, 99), rng.randint(0, 9)) for b in (1, 2) for k in range(80)]
    events = spark.createDataFrame(rows, "broker int, event_id string, day date, event string, status string, ret double, amount long, hold_days int")
    held = {"all": F.lit(True), "big": F.col("amount") > 50, "none": F.lit(False)}
    shown = stats.condition_stats(events, held)
    again = quality.recompute(events, "condition", held, ["ALL", "A", "B", "C", "D", "E"])
    keys = ["broker", "condition", "code"]
    assert quality.check_traceable(shown, again, keys).count() == 0
    bad = shown.withColumn("win_rate", F.when((F.col("condition") == "big") & (F.col("code") == "A"), 1.0).otherwise(F.col("win_rate")))
    assert {tuple(r) for r in quality.check_traceable(bad, again, keys).collect()} == {(b, "big", "A", "win_rate") for b in (1, 2)}
