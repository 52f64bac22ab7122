"""Instrument identities: interval, prefix and name joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_instrument_code, norm_branch_name, norm_underlying
from ..sources.tables import stored
from .trades import dealt


def dedupe_identity(intervals: DataFrame) -> DataFrame:
    """One row per (code, list_date, end_date, target): matched first, then with a target, then the longer name, then the later ``seq``."""
    best = F.struct((F.col("status") == "Matched").cast("int").alias("a"), (F.coalesce("target", F.lit("")) != "").cast("int").alias("b"), F.length(F.coalesce("name", F.lit(""))).alias("c"), F.col("seq").alias("d"))
    keys = ["code", "list_date", "end_date", "target"]
    return intervals.groupBy(*keys).agg(F.max_by(F.struct("name", "status", "seq"), best).alias("_r")).select(*keys, "_r.*")


def resolve_identity(facts: DataFrame, intervals: DataFrame, code: str = "code", day: str = "day", parts: int | None = None) -> DataFrame:
    """``facts`` with id_target, id_name and id_status of the interval that holds the day.

    Only distinct (code, day) pairs are joined, in ``parts`` partitions.  No interval: Unmatched.  Several non-blank targets: Ambiguous, without target,
    with the name of the last by (list_date, end_date).  Else the latest list_date wins, of equal ones the earliest end_date.
    """
    # By code alone: pairs are told apart, meet their intervals and are decided where they are.
    pairs = dealt(facts.select(F.col(code).alias("_c"), F.col(day).alias("_d")), parts, "_c").distinct()
    hit = pairs.join(intervals, (F.col("_c") == F.col("code")) & F.col("_d").between(F.col("list_date"), F.col("end_date")))
    blank = F.nullif(F.col("target"), F.lit(""))
    first = F.struct(F.col("list_date"), -F.datediff("end_date", F.lit("1970-01-01").cast("date")))
    found = hit.groupBy("_c", "_d").agg((F.min(blank) != F.max(blank)).alias("_many"), F.max_by(F.struct("target", "name", "status"), first).alias("_b"), F.max_by("name", F.struct("list_date", "end_date")).alias("_last"))
    many = F.col("_many")
    best = found.select("_c", "_d", F.when(many, F.lit(None)).otherwise(F.col("_b.target")).alias("id_target"), F.when(many, F.col("_last")).otherwise(F.col("_b.name")).alias("id_name"), F.when(many, "Ambiguous").otherwise(F.col("_b.status")).alias("id_status"))
    out = facts.join(best, (F.col(code) == F.col("_c")) & (F.col(day) == F.col("_d")), "left").drop("_c", "_d")
    return out.withColumn("id_status", F.coalesce("id_status", F.lit("Unmatched")))


def resolve_contract(lots: DataFrame, contracts: DataFrame, code: str = "code", day: str = "buy_day") -> DataFrame:
    """``lots`` with the contract of their buy day: one per (code, list, end, target), official first, then the latest list_date."""
    keys = ["code", "list_date", "end_date", "target"]
    once = contracts.withColumn("_o", (F.col("source") == "official").cast("int"))
    once = once.groupBy(*keys).agg(F.max_by(F.struct("ratio", "settle", "source", "_o"), F.struct("_o", "ratio")).alias("_r")).select(*keys, "_r.*")
    pairs = lots.select(F.col(code).alias("_c"), F.col(day).alias("_d")).distinct()
    hit = pairs.join(once, (F.col("_c") == F.col("code")) & F.col("_d").between(F.col("list_date"), F.col("end_date")))
    best = hit.groupBy("_c", "_d").agg(F.max_by(F.struct("list_date", "end_date", "target", "ratio", "settle", "source"), F.struct("list_date", "_o", "target")).alias("contract"))
    return lots.join(best, (F.col(code) == F.col("_c")) & (F.col(day) == F.col("_d")), "left").drop("_c", "_d")


# Endings of company names that an alias may lack, aliases that name a market, and the index fund's code, name and beginnings.
SUFFIXES = ("半導體", "科技", "電子", "光電", "精密", "材料", "生技", "醫療", "資訊", "電腦", "通信", "通訊", "電機", "機械", "工業", "實業", "企業", "國際", "控股", "投控", "建設", "營造", "食品", "鋼鐵")
NO_ALIAS = ("台灣", "臺灣")
INDEX_FUND = {"target": "0050", "name": "元大台灣50", "aliases": ("台灣50", "臺灣50"), "begins": ("台灣50", "臺灣50", "元大台灣50", "元大臺灣50"), "not": ("台灣50正", "臺灣50正", "台灣50反", "臺灣50反")}


def compact_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[ \u3000]", "")


def prefix_aliases(master: DataFrame, least: int = 2, most: int = 4, suffixes: tuple[str, ...] = SUFFIXES, special: dict = INDEX_FUND, spaced: bool = False) -> DataFrame:
    """(alias, target, exact) from (target, name): full names, names without one of ``suffixes``, and prefixes that are no other full name.

    Per alias the exact, then the longer name, then the first target.  Blanks in names don't count, unless ``spaced``.  The index fund of
    ``special`` has aliases of its own.
    """
    full = master.select((F.col("name") if spaced else compact_name(F.col("name"))).alias("name"), "target").where(F.length("name") > 0)
    exact = full.select(F.col("name").alias("alias"), "target", "name", F.lit(1).alias("exact"))
    cut = full.withColumn("k", F.explode(F.sequence(F.lit(least), F.lit(most)))).where(F.length("name") > F.col("k")).select(F.substring(F.col("name"), F.lit(1), F.col("k")).alias("alias"), "target", "name", F.lit(0).alias("exact"))
    parts = [exact, cut.join(exact.select("alias").distinct(), "alias", "left_anti")]
    for suffix in suffixes:
        parts.append(full.where(F.col("name").endswith(suffix) & (F.length("name") > len(suffix) + 1)).select(F.expr(f"left(name, length(name) - {len(suffix)})").alias("alias"), "target", "name", F.lit(0).alias("exact")))
    if special:
        parts.append(master.sparkSession.createDataFrame([(x, special["target"], special["name"], 1) for x in special["aliases"]], "alias string, target string, name string, exact int"))
        parts = [x.withColumn("target", F.col("target").cast("string")) for x in parts]
    both = reduce(DataFrame.unionByName, parts).where((F.length("alias") >= least) & ~F.col("alias").isin(*NO_ALIAS))
    return both.groupBy("alias").agg(F.min_by(F.struct("target", "exact"), F.struct(-F.col("exact"), -F.length("name"), F.col("target"))).alias("_r")).select("alias", "_r.target", "_r.exact")


def resolve_by_prefix(names: DataFrame, aliases: DataFrame, name: str, least: int = 2, most: int | None = None, special: dict = INDEX_FUND) -> DataFrame:
    """Distinct names with the target of the longest alias that begins them: their prefixes meet the aliases in an equi-join.

    Without ``most``, aliases of any length are found.  Names that begin like the index fund of ``special`` are its own, if targets are texts.
    """
    own = F.col(name) if most else compact_name(F.col(name))
    once = names.select(name).distinct().withColumn("_c", own)
    upto = F.least(F.length("_c"), F.lit(most)) if most else F.length("_c")
    cut = once.where(F.length("_c") >= least).withColumn("_k", F.explode(F.sequence(F.lit(least), upto)))
    met = cut.withColumn("alias", F.substring(F.col("_c"), F.lit(1), F.col("_k"))).join(aliases, "alias")
    found = met.groupBy(name).agg(F.max_by(F.struct("target", "alias"), "_k").alias("_r")).select(name, "_r.target", "_r.alias")
    if not special or dict(aliases.dtypes)["target"] != "string":
        return found
    begins = lambda words: reduce(lambda a, b: a | b, (F.col("_c").startswith(x) for x in words))
    fund = once.where(begins(special["begins"]) & ~begins(special["not"])).select(name, F.lit(special["target"]).alias("target"), F.substring("_c", 1, 4).alias("alias"))
    return found.join(fund, name, "left_anti").unionByName(fund)


def normal_name(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"\s+", ""), F.lit("臺"), F.lit("台"))


def map_names(df: DataFrame, names: DataFrame, col: str) -> DataFrame:
    """``df`` with the code of its name; of names spelled alike the smallest ``seq`` is taken."""
    first = names.groupBy(normal_name(F.col("name")).alias("_n")).agg(F.min_by("code", "seq").alias("name_code"))
    return df.withColumn("_n", normal_name(F.col(col))).join(first, "_n", "left").drop("_n")


def _looked_up(configured: DataFrame, directory: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(configured names by their normalised alias or name, directory entries by theirs); entries whose name is blank are left out."""
    entries = directory.withColumn("_n", norm_branch_name(F.col("dir_name"))).where(F.length("_n") > 0)
    return configured.join(aliases, "name", "left").withColumn("_n", norm_branch_name(F.coalesce("alias", "name"))).drop("alias"), entries


def resolve_branches(configured: DataFrame, directory: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, code, status): the code of the one directory entry whose normalised name equals the alias or name; none or several are unresolved."""
    wanted, entries = _looked_up(configured, directory, aliases)
    exact = wanted.join(entries, "_n", "left").groupBy("name").agg(F.countDistinct("code").alias("_hits"), F.min("code").alias("code"))
    return exact.select("name", F.when(F.col("_hits") == 1, F.col("code")).alias("code"), F.when(F.col("_hits") == 1, "resolved").otherwise("unresolved").alias("status"))


def suggest_branches(configured: DataFrame, directory: DataFrame, aliases: DataFrame, near: int = 5, cutoff: float = 0.45) -> DataFrame:
    """(name, reason, suggestions) of the names that ``resolve_branches`` leaves unresolved: "several" with all entries of that name, by code, or
    "none" with the ``near`` nearest of the whole directory (``nearest_names``), nearest first.

    An entry reads ``dir_name(code)``; of entries whose normalised names are equal the smallest code stands for them among the nearest.
    Null and blank names are "none" without suggestions.
    """
    wanted, entries = _looked_up(configured.distinct(), directory, aliases)
    label = F.concat("dir_name", F.lit("("), F.col("code").cast("string"), F.lit(")"))
    grouped = entries.groupBy("_n").agg(F.countDistinct("code").alias("_hits"), F.array_sort(F.collect_set(F.struct("code", label.alias("said")))).alias("_all"))
    met = stored(wanted.join(grouped, "_n", "left").where("_hits is null or _hits > 1"), "unresolved")
    several = met.where("_hits > 1").select("name", F.lit("several").alias("reason"), F.array_join(F.transform("_all", lambda x: x["said"]), ", ").alias("suggestions"))
    none = met.where("_hits is null").select("name", "_n")
    close = nearest_names(none.select(F.col("_n").alias("name")), entries.select(F.col("_n").alias("dir_name")), near, cutoff)
    first = entries.groupBy(F.col("_n").alias("dir_name")).agg(F.min_by(label, "code").alias("said"))
    ranked = close.join(first, "dir_name").groupBy(F.col("name").alias("_n")).agg(F.array_sort(F.collect_list(F.struct("rank", "said"))).alias("_near"))
    nearest = none.join(ranked, "_n", "left").select("name", F.lit("none").alias("reason"), F.coalesce(F.array_join(F.transform("_near", lambda x: x["said"]), ", "), F.lit("")).alias("suggestions"))
    return several.unionByName(nearest)


def unmatched_pairs(enriched: DataFrame, code: str = "code", day: str = "day") -> DataFrame:
    return enriched.where("id_status = 'Unmatched'").select(code, day).distinct()


def backfill_identity(facts: DataFrame, sources: list[DataFrame], max_unmatched: float) -> DataFrame:
    """Resolves against the first source, then against it and the next, and so on, while more than ``max_unmatched`` of the pairs (code, day) are left.

    Pairs that a source has matched stay as they are: a step resolves what is open, from a stored table.  Facts are joined once, at the end.
    """
    open_ = stored(facts.select("code", "day").distinct(), "pairs")
    total, known, parts = open_.count(), None, []
    for source in sources:
        known = source if known is None else union_identity([known, source])
        now = stored(resolve_identity(open_.select("code", "day"), known), "resolved")
        parts.append(now.where("id_status <> 'Unmatched'"))
        open_ = now.where("id_status = 'Unmatched'")
        if open_.count() <= max_unmatched * total:
            break
    return _with_found(facts, reduce(DataFrame.unionByName, [*parts, open_]))


def _with_found(facts: DataFrame, found: DataFrame) -> DataFrame:
    """``facts`` with what was found for their (code, day); the rest is Unmatched."""
    found = found.select(F.col("code").alias("_c"), F.col("day").alias("_d"), "id_target", "id_name", "id_status")
    out = facts.join(found, (F.col("code") == F.col("_c")) & (F.col("day") == F.col("_d")), "left").drop("_c", "_d")
    return out.withColumn("id_status", F.coalesce("id_status", F.lit("Unmatched")))


def union_identity(sources: list[DataFrame]) -> DataFrame:
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return dedupe_identity(out)


def broker_map(directory: DataFrame, fallback: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(code, name): fallback rows overlaid by the directory's; a pattern that matches the name overrides it."""
    both = fallback.select("code", F.col("name").alias("_f")).join(directory.select("code", F.col("name").alias("_d")), "code", "full")
    name = F.coalesce("_d", "_f")
    for pattern, label in reversed(patterns):
        name = F.when(F.coalesce("_d", "_f").rlike(pattern), F.lit(label)).otherwise(name)
    return both.select("code", name.alias("name"))


def build_identity(summary: DataFrame, names: DataFrame, aliases: DataFrame, most: int | None = None) -> DataFrame:
    """Identity rows from a dated summary (code, list_date, end_date, target): display name is the longest directory name that resolves to the row's target, else the code.

    An official target is never overridden by a name; a blank one is filled from a name; still blank is Unmatched.
    """
    resolved = names.join(resolve_by_prefix(names, aliases, "name", most=most).withColumnRenamed("target", "name_target"), "name", "left")
    met = summary.join(resolved, "code", "left")
    fits = F.col("target").isNull() | (F.col("target") == F.col("name_target"))
    longest = F.max_by(F.struct("name", "name_target"), F.when(fits & F.col("name_target").isNotNull(), F.struct(F.length("name"), F.col("name"))))
    out = met.groupBy("code", "list_date", "end_date", "target").agg(longest.alias("_r"))
    target = F.coalesce("target", F.col("_r.name_target"))
    return out.select("code", "list_date", "end_date", target.alias("target"), F.coalesce(F.col("_r.name"), F.col("code").cast("string")).alias("name"), F.when(target.isNull(), "Unmatched").otherwise("Matched").alias("status"))


def identity_counts(enriched: DataFrame, kind: str = "kind", put: str = "put", top: int = 5, max_pct: float = 5.0) -> DataFrame:
    """(item, n): rows, matched ones, calls and puts among these, per cent unmatched, whether that stops a run (over ``max_pct``),
    the ``top`` most frequent reasons, and as many unmatched codes as examples."""
    good = F.col("id_status") == "Matched"
    is_put = F.coalesce(F.col(kind) == put, F.lit(False))
    sums = enriched.agg(F.count("*").alias("rows"), F.count_if(good).alias("matched"), F.count_if(good & ~is_put).alias("calls"), F.count_if(good & is_put).alias("puts"))
    pct = F.bround((F.col("rows") - F.col("matched")) * 100 / F.nullif(F.col("rows"), F.lit(0)), 2)
    sums = sums.select(*(F.col(c).cast("double") for c in sums.columns), pct.alias("pct"), (F.coalesce(pct, F.lit(0.0)) > max_pct).cast("double").alias("stops"))
    counted = sums.select(F.expr("stack(6, 'rows', rows, 'matched', matched, 'calls', calls, 'puts', puts, 'unmatched %', pct, 'stops', stops) as (item, n)"))
    bad = enriched.where(~F.coalesce(good, F.lit(False)))
    first = lambda c, name: bad.groupBy(F.concat(F.lit(f"{name} "), F.col(c).cast("string")).alias("item")).agg(F.count("*").cast("double").alias("n")).orderBy(F.desc("n"), "item").limit(top)
    return counted.unionByName(first("reason", "reason")).unionByName(first("code", "example"))


def identity_quality(enriched: DataFrame, top: int = 5) -> DataFrame:
    """(item, n): rows by status, and the ``top`` most frequent unmatched codes."""
    status = enriched.groupBy(F.concat(F.lit("status "), F.col("id_status")).alias("item")).agg(F.count("*").alias("n"))
    codes = enriched.where("id_status = 'Unmatched'").groupBy(F.concat(F.lit("code "), F.col("code").cast("string")).alias("item")).agg(F.count("*").alias("n"))
    return status.unionByName(codes.orderBy(F.desc("n"), "item").limit(top))


def resolve_targets(df: DataFrame, names: DataFrame) -> DataFrame:
    """Target identity chain over (code, name): own code, else its name's; own name, else its code's; ``names`` is (code, name), first of each."""
    by_name = names.groupBy(normal_name(F.col("name")).alias("_n")).agg(F.min("code").alias("_code"))
    by_code = names.groupBy(F.col("code").alias("_c")).agg(F.min("name").alias("_name"))
    met = df.withColumn("_n", normal_name(F.col("name"))).join(by_name, "_n", "left").withColumn("code", F.coalesce(F.nullif(F.col("code"), F.lit("")), "_code"))
    return met.join(by_code, F.col("code") == F.col("_c"), "left").withColumn("name", F.coalesce(F.nullif(F.col("name"), F.lit("")), "_name")).drop("_n", "_code", "_c", "_name")


def resolve_target_texts(df: DataFrame, names: DataFrame, tokens: list[str], known: dict[str, str] | None = None) -> DataFrame:
    """``df`` with target_code, target_name and target_label, from its texts ``code``, ``name``, ``raw_target`` and ``instrument``.

    The code is the row's own; if that is none or an instrument's, one of four digits that begins ``raw_target``; else that of the name.  The name is the row's own, else what follows
    the code in ``raw_target``, else what an instrument text says before an issuer of ``tokens``, else that of the code.  An
    instrument's code never stays where the name is known: it becomes the name's code, or blank.  ``names`` is (code, name), first of each;
    of names spelled alike the smallest code counts.
    """
    text = {c: F.coalesce(F.trim(F.col(c)), F.lit("")) for c in ("code", "name", "raw_target", "instrument")}
    filled = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))
    begins = lambda k: F.trim(F.regexp_extract(text["raw_target"], r"(?s)^(\d{4})(?:\s+|[-_])?(.*)$", k))
    said = F.regexp_replace(F.trim(F.split(F.regexp_replace(filled(text["instrument"], text["raw_target"], text["name"]), "^[;；\\s]+", ""), "[;；]")[0]), r"^\d+\s*", "")
    issuer = F.array_min(F.filter(F.array(*(F.locate(t, said) for t in tokens)), lambda at: at > 1))
    before = F.trim(F.substring(said, F.lit(1), issuer - 1))
    inferred = F.when(issuer.isNotNull() & (F.length(before) <= 12), before)
    unfit = lambda c: (c == "") | F.coalesce(is_instrument_code(c), F.lit(False))
    own = F.coalesce(norm_underlying(text["code"], filled(text["name"], text["raw_target"], text["instrument"]), known), F.lit(""))
    first = df.withColumn("_own", own).withColumn("_begin", begins(1))
    code = F.when(unfit(F.col("_own")) & ~unfit(F.col("_begin")), F.col("_begin")).otherwise(F.col("_own"))
    first = first.withColumn("_code", code).withColumn("_name", filled(text["name"], begins(2), inferred))
    by_code = names.groupBy(F.col("code").alias("_c")).agg(F.min("name").alias("_of_code"))
    met = first.join(by_code, (F.col("_code") == F.col("_c")) & ~unfit(F.col("_code")), "left").withColumn("_name", filled(F.col("_name"), F.col("_of_code")))
    by_name = names.groupBy(normal_name(F.col("name")).alias("_n")).agg(F.min("code").alias("_of_name"))
    met = met.join(by_name, normal_name(F.col("_name")) == F.col("_n"), "left")
    found = F.when(unfit(F.col("_code")) & (F.col("_name") != ""), F.coalesce("_of_name", F.when(~F.coalesce(is_instrument_code(F.col("_code")), F.lit(False)), F.col("_code")), F.lit(""))).otherwise(F.col("_code"))
    both = met.withColumn("target_code", found).withColumn("target_name", F.col("_name"))
    label = F.when(F.col("target_name") != "", F.trim(F.concat_ws(" ", "target_code", "target_name"))).otherwise(filled(text["raw_target"], F.col("target_code")))
    return both.withColumn("target_label", label).select(*df.columns, "target_code", "target_name", "target_label")


def _grams(name: str, q: int) -> Column:
    """The runs of ``q`` characters of a name, each with how many equal ones stand before it."""
    at = lambda i: F.substring(F.col(name), i, F.lit(q))
    places = F.sequence(F.lit(1), F.length(name) - (q - 1))
    one = lambda i: F.struct(F.lit(q).alias("q"), at(i).alias("gram"), F.size(F.filter(places, lambda j: (j < i) & (at(j) == at(i)))).alias("nth"))
    return F.when(F.length(name) >= q, F.transform(places, one)).otherwise(F.array())


def nearest_names(wanted: DataFrame, directory: DataFrame, near: int = 5, cutoff: float = 0.45) -> DataFrame:
    """(name, rank, dir_name, distance): for each of ``wanted`` (name) the ``near`` closest of ``directory`` (dir_name) by edit distance, ties by dir_name.

    Similarity, 1 - distance / the longer one's length, is ``cutoff`` or more.  Exact, by inverted lists of q-grams: names within distance r share
    all grams but 2 r of pairs of characters, or all but r single characters, so that of the rarest 2 r + 1 (or r + 1) of both one is
    shared.  r doubles until a name has its ``near`` ones or no name can be similar enough; names that have them leave.  Blank names have none.
    """
    tokens = lambda df, name: df.withColumn("_g", F.explode(F.concat(_grams(name, 2), _grams(name, 1)))).select(name, "_g.*")
    theirs = directory.select("dir_name").where(F.length("dir_name") > 0).distinct()
    lists = stored(tokens(theirs, "dir_name"), "grams")
    counts = lists.groupBy("q", "gram", "nth").agg(F.count("*").alias("df"))

    def ranked(grams: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy(name, "q").orderBy("df", "gram", "nth")
        return grams.join(counts, ["q", "gram", "nth"], "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", F.row_number().over(order)).drop("df")

    lists = stored(ranked(lists, "dir_name"), "lists")
    open_ = stored(wanted.select("name").where(F.length("name") > 0).distinct(), "wanted")
    most = lambda a, b: F.floor(F.lit(1.0 - cutoff) * F.greatest(F.length(a), F.length(b)) + 1e-9)
    longest = theirs.agg(F.max(F.length("dir_name"))).first()[0] or 0
    found, r = None, 1
    while not open_.isEmpty():
        pairs = F.length("name") - 1 > 2 * r
        mine = ranked(tokens(open_, "name"), "name").where(F.col("q") == F.when(pairs, 2).otherwise(1))
        prefix = F.col("rank") <= F.col("q") * r + 1
        met = mine.where(prefix).drop("rank").join(lists.where(prefix).drop("rank"), ["q", "gram", "nth"]).select("name", "dir_name").distinct()
        close = met.where(F.abs(F.length("name") - F.length("dir_name")) <= r).withColumn("distance", F.levenshtein("name", "dir_name", r))
        close = close.where((F.col("distance") >= 0) & (F.col("distance") <= most("name", "dir_name")))
        order = Window.partitionBy("name").orderBy("distance", "dir_name")
        close = stored(close.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= near), "near")
        # Names whose distance bound is reached, whichever directory name they are compared with, or who have all, are done.
        full = close.groupBy("name").agg(F.count("*").alias("n"))
        counted = open_.join(full, "name", "left")
        longer = F.greatest(F.length("name"), F.least(F.lit(longest), F.floor(F.length("name") / cutoff + 1e-9)))  # none that is longer is similar enough
        done = (F.coalesce("n", F.lit(0)) >= near) | (F.floor(F.lit(1.0 - cutoff) * longer + 1e-9) <= r)
        finished = stored(counted.where(done).select("name"), "finished")
        part = close.join(finished, "name", "left_semi")
        found = part if found is None else found.unionByName(part)
        open_, r = stored(open_.join(finished, "name", "left_anti"), "wanted"), 2 * r
    if found is None:
        return wanted.select("name", F.lit(0).alias("rank"), F.lit("").alias("dir_name"), F.lit(0).alias("distance")).limit(0)
    return found.select("name", "rank", "dir_name", "distance")


def _resolve_open(pairs: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, open) of (code, day), the first with what was found."""
    out = stored(resolve_identity(pairs, intervals), "resolved")
    return out.where("id_status <> 'Unmatched'"), out.where("id_status = 'Unmatched'").select("code", "day")


def backfill_candidates(facts: DataFrame, seed: DataFrame, shards: DataFrame, candidates: DataFrame, max_unmatched: float = 0.05, shard: str = "shard") -> DataFrame:
    """``facts`` resolved in stages: against ``seed``; then, for pairs (code, day) that are open, against the shards that ``candidates``
    (code, shard) name for their codes; then, if more than ``max_unmatched`` of all pairs are still open, against all ``shards``.

    ``shards`` is a table partitioned by ``shard``: the second stage reads the candidates' folders alone (dynamic partition pruning).  A stage sees the
    seed's intervals and its own; pairs that an earlier one has matched stay as they are.  Facts are joined once, at the end.
    """
    pairs = stored(facts.select("code", "day").distinct(), "pairs")
    total = pairs.count()
    matched, open_ = _resolve_open(pairs, seed)
    columns = [c for c in shards.columns if c != shard]
    for stage in ("candidates", "all"):
        left = open_.count()
        if not left or (stage == "all" and left <= max_unmatched * total):
            break
        codes = open_.select("code").distinct()
        asked = stored(codes.join(candidates, "code").select(shard).distinct(), "shards") if stage == "candidates" else None
        rows = shards if asked is None else candidate_intervals(shards, asked, shard)
        rows = rows.join(codes, "code", "left_semi").select(columns)
        known = union_identity([seed.join(codes, "code", "left_semi"), rows])
        more, open_ = _resolve_open(open_, known)
        matched = matched.unionByName(more)
    return _with_found(facts, matched)


def candidate_shards(names: DataFrame, aliases: DataFrame, known: DataFrame, least: int = 3, shard: str = "shard") -> DataFrame:
    """(code, shard): the targets whose shards may have intervals of a code, for ``backfill_candidates``.

    These are the targets of its ``known`` intervals of any day, and those that its ``names`` (code, name) begin with: a whole alias of
    ``aliases`` (alias, target, exact), or one of ``least`` characters or more.  They only say where to look: an interval of the shard itself decides.  Blank targets are none.
    """
    once = names.select("code", "name").where("code is not null and name is not null").distinct()
    begun = resolve_by_prefix(once, aliases, "name").join(aliases.select("alias", F.col("exact")), "alias", "left")
    sure = begun.where((F.col("exact") == 1) | (F.length("alias") >= least)).select("name", F.col("target").cast("string").alias(shard))
    both = once.join(sure, "name").select("code", shard).unionByName(known.select("code", F.col("target").cast("string").alias(shard)))
    return both.where(F.length(shard) > 0).distinct()


def candidate_intervals(shards: DataFrame, asked: DataFrame, shard: str = "shard") -> DataFrame:
    """The rows of ``shards`` in the ``asked`` ones; there is one row for each, and a shard is a target of the market, so that these can be broadcast.

    Blank ones name no folder; Spark prunes folders by a side that is filtered.
    """
    return shards.join(F.broadcast(asked.where(F.length(shard) > 0)), shard, "left_semi")
