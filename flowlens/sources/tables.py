"""Sources and sinks: checked scans, text tables, seeds, logs, compact and checkpoint tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import non_blank, norm_query_code, parse_day, roc_to_date, safe_double
from ..operators import fifo
from ..operators.trades import require_columns


#: Session setting that ``scratch_run`` uses: the folder of the run that is going on.
_RUN = "flowlens.scratch.run"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: that of the ``scratch_run``, else spark.checkpoint.dir, else, on a local master only, beside the warehouse."""
    root = spark.conf.get(_RUN, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """The tables that operators write to the shared folder inside this block are removed at its end, also after an error.

    What operators return reads these tables: write or collect it inside the block, to a path of one's own.  Blocks nest.  The setting is
    the session's: runs at the same time need a session each (``spark.newSession()``).
    """
    before, path = spark.conf.get(_RUN, None), shared_path(spark, name)
    spark.conf.set(_RUN, path)
    try:
        yield path
    finally:
        if before is None:
            spark.conf.unset(_RUN)
        else:
            spark.conf.set(_RUN, before)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a new table in the shared folder: what several steps read is worked out once, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_daily(raw: DataFrame, columns: list[str], partition_day: str, row_day: str) -> tuple[DataFrame, DataFrame]:
    """(rows of good days, day_status): a day is good if every one of its rows carries the partition's day; others are rejected whole."""
    require_columns(raw, [*columns, partition_day, row_day])
    status = raw.groupBy(F.col(partition_day).alias("day")).agg(F.count("*").alias("raw_rows"), F.count_if(~F.col(row_day).eqNullSafe(F.col(partition_day))).alias("invalid_rows"))
    status = status.withColumn("status", F.when(F.col("invalid_rows") == 0, "success").otherwise("failed"))
    good = raw.join(status.where("status = 'success'").select(F.col("day").alias("_day")), F.col(partition_day) == F.col("_day"), "left_semi")
    return good, status


def scan_daily_folder(spark: SparkSession, path: str, schema: str, columns: list[str], row_day: str, expected: DataFrame, part: str = "day") -> tuple[DataFrame, DataFrame]:
    """(rows of good days, status of ``expected`` (day)) from a table partitioned by ``part``, of which only the expected days' folders are read.

    ``schema`` names the rows' columns, without ``part``.  A day is "empty" without rows or folder, "missing columns" if one of ``columns`` is in none of its
    files or holds nothing, "failed" if a row is of another day, else "success"; days that aren't good are rejected whole.
    """
    days = expected.select(F.col("day").cast("date").alias("_day")).where(F.year("_day") > 0).distinct()  # Spark prunes folders by a side that is filtered
    rows = spark.read.schema(f"{schema}, {part} date").parquet(path)
    within = rows.join(F.broadcast(days), F.col(part) == F.col("_day"), "left_semi")  # a calendar's days
    said = within.groupBy(F.col(part).alias("_d")).agg(F.count("*").alias("raw_rows"), F.count_if(~F.col(row_day).eqNullSafe(F.col(part))).alias("invalid_rows"), F.array_compact(F.array(*(F.when(F.count(c) == 0, F.lit(c)) for c in columns))).alias("missing"))
    status = F.when(F.col("raw_rows").isNull(), "empty").when(F.size("missing") > 0, "missing columns").when(F.col("invalid_rows") > 0, "failed").otherwise("success")
    out = days.join(said, F.col("_day") == F.col("_d"), "left").select(F.col("_day").alias("day"), F.coalesce("raw_rows", F.lit(0)).alias("raw_rows"), F.coalesce("invalid_rows", F.lit(0)).alias("invalid_rows"), F.array_join("missing", ",").alias("missing"), status.alias("status"))
    out = stored(out, "day-status")
    good = rows.join(F.broadcast(out.where("status = 'success'").select(F.col("day").alias("_day"))), F.col(part) == F.col("_day"), "left_semi")
    return good, out


def scan_shards(spark: SparkSession, path: str, schema: str, asked: DataFrame, target: str, day: str, first: str, last: str, shard: str = "shard") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, status of the shards ``asked`` (shard)) from a table partitioned by ``shard``, of which only the asked folders are read.

    Accepted are rows whose ``target`` is their folder's and whose ``day`` is in range; a shard without rows is "empty", one with others "violations", else
    "success".
    """
    shards = asked.select(F.col("shard").cast("string").alias("_shard")).where(F.length("_shard") > 0).distinct()  # Spark prunes folders by a side that is filtered
    rows = spark.read.schema(f"{schema}, {shard} string").parquet(path).join(F.broadcast(shards), F.col(shard) == F.col("_shard"), "left_semi")  # a market's targets
    accepted, bad = merge_shards(rows, shard, target, day, first, last)
    counts = rows.groupBy(F.col(shard).alias("_s")).agg(F.count("*").alias("rows")).join(bad.withColumnRenamed(shard, "_b"), F.col("_s") == F.col("_b"))
    out = shards.join(counts, F.col("_shard") == F.col("_s"), "left").select(F.col("_shard").alias("shard"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("violations", F.lit(0)).alias("violations"))
    return accepted, out.withColumn("status", F.when(F.col("rows") == 0, "empty").when(F.col("violations") > 0, "violations").otherwise("success"))


def write_compact(df: DataFrame, path: str, day: str = "trade_day") -> None:
    """Replaces exactly the days that ``df`` has; fails, and writes none, if its key isn't unique.  ``df`` is worked out once, into a table of its own."""
    df = stored(df, "compacting")
    twice = df.groupBy("code", "broker", day).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"key not unique: {twice}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_checkpoint(events: DataFrame, path: str, allocations: DataFrame | None = None, before: DataFrame | None = None) -> None:
    """Events with all lots, the lots still open and, if given, the sales matched to them in order, as nested columns; those of the checkpoint ``before`` come first."""
    out = events.withColumn("open_lots", F.filter("lots", lambda x: x["remaining"] > 0))
    if allocations is not None:
        sale = F.struct("sale_day", "lot_no", "qty", "revenue", "cost")
        matched = allocations.groupBy("event_id").agg(F.array_sort(F.collect_list(sale)).alias("allocations"))
        none = F.array().cast(matched.schema["allocations"].dataType)
        out = out.join(matched, "event_id", "left").withColumn("allocations", F.coalesce("allocations", none))
        if before is not None:
            out = out.join(before.select("event_id", F.col("allocations").alias("_before")), "event_id", "left").withColumn("allocations", F.concat(F.coalesce("_before", none), "allocations")).drop("_before")
    out.write.mode("overwrite").parquet(path)


def lots_of(events: DataFrame) -> DataFrame:
    """(broker, code, event_id, event_day, lot_no, qty, amount) of the events' ``lots``, and ``open`` if these have ``remaining``; sold out ones are left out."""
    lots = events.select("broker", "event_id", F.col("day").alias("event_day"), F.explode("lots").alias("l"))
    out = lots.select("broker", F.col("l.code").alias("code"), "event_id", "event_day", F.col("l.code").alias("lot_no"), F.col("l.qty").alias("qty"), F.col("l.amount").alias("amount"), *([F.col("l.remaining").alias("open")] if "remaining" in lots.schema["l"].dataType.names else []))
    return out.where("open > 0") if "open" in out.columns else out


def resume_checkpoint(old: str | None, events: DataFrame, sales: DataFrame, path: str) -> DataFrame:
    """Matches new ``sales`` to the open lots of the checkpoint ``old`` and those of new ``events``, writes the checkpoint ``path`` of all events, and returns it.

    ``sales`` (broker, code, day, sell_qty, sell_amt) and ``events`` are of days after all of ``old``; only these and the lots still open are matched, by
    (broker, code).  Each event keeps its ``allocations``, earlier runs' first.  ``old`` is None in the first run; ``path`` is another folder.
    """
    spark = events.sparkSession
    before = spark.read.parquet(old) if old else None
    known = stored(events if before is None else before.select(*events.columns).unionByName(events.withColumn("lots", F.transform("lots", lambda x: x.withField("remaining", x["qty"])))), "resumed")
    fresh = stored(fifo.fifo_match(lots_of(known), sales, ["broker", "code"]), "allocations")
    write_checkpoint(fifo.with_remaining(known, fresh), path, fresh, before)
    return spark.read.parquet(path)


def write_results(results: dict[str, DataFrame], path: str) -> None:
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


SEED_COLUMNS = ("code", "name", "list_date", "end_date", "status", "market", "settle_price", "ratio")


def check_seed(raw: DataFrame, min_rows: int, record: str | None = None) -> DataFrame:
    """Typed, valid and distinct seed rows from all-text columns; raises if fewer than ``min_rows`` are left.

    Rows of one code and period are one; with ``record``, the column of a source's own key, only if they have the same one.
    """
    of = [record] if record else []
    require_columns(raw, [*SEED_COLUMNS, *of])
    typed = raw.select(F.upper(F.trim("code")).alias("code"), "name", F.to_date("list_date").alias("list_date"), F.to_date("end_date").alias("end_date"), "status", F.col("market").try_cast("int").alias("market"), F.col("settle_price").try_cast("double").alias("settle_price"), F.col("ratio").try_cast("double").alias("ratio"), *of)
    ok = (F.length("code") == 6) & (F.col("list_date") <= F.col("end_date")) & F.col("status").isin("active", "ended") & F.col("market").isin(1, 2) & (F.coalesce("settle_price", F.lit(0.0)) >= 0) & (F.coalesce("ratio", F.lit(0.0)) >= 0)
    keys = ["code", "list_date", "end_date"]
    rest = [c for c in SEED_COLUMNS if c not in keys]
    out = typed.where(ok).groupBy(*keys, *of).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
    if min_rows and out.limit(min_rows).count() < min_rows:
        raise ValueError(f"fewer than {min_rows} seed rows")
    return out


def scan_seed(spark: SparkSession, path: str, min_rows: int) -> DataFrame:
    """Seed from (compressed) CSV, read as text throughout."""
    return check_seed(spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in SEED_COLUMNS)), min_rows)


def _cells(line: Column, sep: str) -> Column:
    return F.transform(F.split(line, sep, -1), lambda x: F.regexp_replace(F.trim(x), "^'", ""))


def scan_text_table(lines: DataFrame, wanted: list[str], header: list[str], sep: str = ",", brokers: list[str] | None = None, broker_col: str | None = None) -> DataFrame:
    """Text columns of a ragged table from (pos, line): short rows padded with nulls, long ones cut, leading quotes gone.

    Only wanted columns that the header has come out; ``brokers`` restricts the rows by ``broker_col``.
    """
    cells = lines.select("pos", _cells(F.col("line"), sep).alias("c"))
    there = [c for c in wanted if c in header]
    out = cells.select("pos", *(F.get("c", header.index(c)).alias(c) for c in there))
    return out if brokers is None or broker_col not in there else out.where(F.col(broker_col).isin(brokers))


def read_header(lines: DataFrame, sep: str = ",") -> list[str]:
    """Column names of the first line; no lines, no names."""
    first = lines.orderBy("pos").limit(1).select(_cells(F.col("line"), sep).alias("c")).collect()
    return list(first[0]["c"]) if first else []


def scan_sectioned(lines: DataFrame, group: str, required: list[str], least: int, sep: str = ",") -> DataFrame:
    """(group, pos, section, values): rows below repeated headers, each as a map from its own section's header.

    A header is a line with ``least`` of the ``required`` labels; lines before the first one are dropped.  Sections are sought within ``group``.
    """
    cells = lines.select(group, "pos", _cells(F.col("line"), sep).alias("c"))
    order = Window.partitionBy(group).orderBy("pos")
    is_header = F.size(F.array_intersect("c", F.array(*map(F.lit, required)))) >= least
    filled = cells.withColumn("h", is_header).withColumn("head", F.last(F.when(F.col("h"), F.col("c")), ignorenulls=True).over(order)).withColumn("section", F.sum(F.col("h").cast("int")).over(order))
    rows = filled.where("not h and head is not null")
    return rows.select(group, "pos", "section", F.map_from_entries(F.filter(F.transform("head", lambda name, i: F.struct(name.alias("k"), F.get(F.col("c"), i).alias("v"))), lambda e: e["k"] != "")).alias("values"))


def scan_stat_sheet(lines: DataFrame, group: str, roles: dict[str, list[str]], sep: str = ",") -> DataFrame:
    """(group, pos, scope, role columns): header roles found by normalised names, else by their order; scope set by title rows (one cell).

    ``roles`` maps a role to its accepted names; a row takes the roles' places from the nearest header above it.
    """
    norm = lambda x: F.lower(F.regexp_replace(x, r"[\s_％%()]", ""))
    cells = lines.select(group, "pos", _cells(F.col("line"), sep).alias("c"))
    order = Window.partitionBy(group).orderBy("pos")
    names = F.transform("c", norm)
    title = F.size(F.filter("c", lambda x: x != "")) == 1
    hits = sum(F.arrays_overlap(names, F.array(*map(F.lit, accepted))).cast("int") for accepted in roles.values())
    is_header = ~title & (hits >= 2)
    at = {r: F.greatest(*(F.array_position(names, a) for a in [*accepted, ""])) for r, accepted in roles.items()}
    filled = cells.withColumns({"t": title, "h": is_header, "scope": F.last(F.when(title, F.get("c", 0)), ignorenulls=True).over(order)} | {f"at_{r}": F.last(F.when(is_header, c), ignorenulls=True).over(order) for r, c in at.items()})
    place = {r: F.when(F.coalesce(F.col(f"at_{r}"), F.lit(0)) > 0, F.col(f"at_{r}") - 1).otherwise(F.lit(k)) for k, r in enumerate(roles)}
    return filled.where("not t and not h").select(group, "pos", "scope", *(F.get("c", p.cast("int")).alias(r) for r, p in place.items()))


def explode_json_detail(df: DataFrame, col: str, fields: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """A row for each object of a JSON list column; each field from the first of its alias keys with a value."""
    rows = df.select(*keep, F.explode_outer(F.from_json(col, "array<map<string,string>>")).alias("_m"))
    return rows.select(*keep, *(F.coalesce(*(non_blank(F.col("_m")[a]) for a in aliases)).alias(f) for f, aliases in fields.items()))


def append_log(old: DataFrame, new: DataFrame) -> DataFrame:
    """Log with columns added over time: what either lacks is null."""
    return old.unionByName(new, allowMissingColumns=True)


def append_run(new: DataFrame, path: str, run: str) -> None:
    """Appends the rows of a run to the log at ``path``; a run that is appended again replaces its own rows.  Columns may have been added since."""
    new.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole log, with the columns of all its runs: what a run lacks is null."""
    return spark.read.option("mergeSchema", True).option("partitionOverwriteMode", "dynamic").parquet(path).withColumn("run", F.col("run").cast("string"))


def stock_names(raw: DataFrame, code_names: list[str], name_names: list[str], seq: str) -> DataFrame:
    """(code, name) dimension: header aliases, normal codes, blank and unknown names dropped, the last wins."""
    pick = lambda names: F.coalesce(*(non_blank(F.col(c).cast("string")) for c in names if c in raw.columns))
    rows = raw.select(norm_query_code(pick(code_names)).alias("code"), pick(name_names).alias("name"), F.col(seq).alias("_s"))
    return rows.where("code is not null and name is not null and name <> '未知公司'").groupBy("code").agg(F.max_by("name", "_s").alias("name"))


def rows_from_html(pages: DataFrame, key: str, html: str, labels: dict[str, list[str]]) -> DataFrame:
    """(key, row, label columns) of all ``hasBorder`` tables: cells by the header's label aliases; rows without all of them are dropped.

    Columns whose name ends in ``_date`` are read as ROC days.
    """
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?s)<table[^>]*class="[^"]*hasBorder[^"]*"[^>]*>(.*?)</table>'), 1)).alias("table", "body"))
    rows = tables.select(key, "table", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)).alias("row", "tr"))
    cells = rows.withColumn("c", F.transform(F.regexp_extract_all("tr", F.lit(r"(?s)<t[hd][^>]*>(.*?)</t[hd]>"), 1), lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>|\s+", " "))))
    heads = cells.where("row = 0").select(F.col(key).alias("_k"), F.col("table").alias("_t"), *(F.greatest(*(F.array_position("c", a) for a in [*aliases, ""])).alias(f"_at_{n}") for n, aliases in labels.items()))
    met = cells.where("row > 0").join(heads, (F.col(key) == F.col("_k")) & (F.col("table") == F.col("_t")))
    value = lambda n: non_blank(F.get("c", (F.col(f"_at_{n}") - 1).cast("int")))
    out = met.select(key, "row", *((roc_to_date(value(n)) if n.endswith("_date") else value(n)).alias(n) for n in labels))
    return out.dropna(subset=list(labels))


def merge_sliced_history(slices: list[DataFrame], keys: list[str], day: str, first: str, last: str) -> DataFrame:
    """Overlapping slices as one: days out of range rejected, the later slice wins; raises if the first day isn't reached."""
    out = slices[0].withColumn("_slice", F.lit(0))
    for k, more in enumerate(slices[1:], 1):
        out = out.unionByName(more.withColumn("_slice", F.lit(k)))
    inside = out.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    rest = [c for c in inside.columns if c not in keys]
    merged = inside.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_slice").alias("_r")).select(*keys, "_r.*").drop("_slice")
    return merged


def check_reaches(df: DataFrame, day: str, first: str) -> None:
    earliest = df.agg(F.min(day).cast("string")).first()[0]
    if earliest is None or earliest > first:
        raise ValueError(f"history begins at {earliest}, after {first}")


def merge_shards(df: DataFrame, shard: str, target: str, day: str, first: str, last: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, violations per shard): a row must belong to its shard's target and lie in range."""
    ok = F.col(target).eqNullSafe(F.col(shard)) & F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    marked = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return marked.where("_ok").drop("_ok"), marked.groupBy(shard).agg(F.count_if(~F.col("_ok")).alias("violations"))


def typed_text(df: DataFrame, days: list[str], numbers: list[str]) -> DataFrame:
    """Days and numbers of an all-text table."""
    return df.withColumns({c: parse_day(F.col(c)) for c in days} | {c: safe_double(F.col(c)) for c in numbers})
