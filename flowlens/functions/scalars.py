"""Scalar rules as Spark columns: codes, dates, numbers, names, classes.  All stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half-open amount classes A-E (lower bounds), and the list separators of name lists.
AMOUNT_BOUNDS = (1_000_000, 1_600_000, 2_500_000, 5_000_000, 10_000_000)
CLASSES = ("A", "B", "C", "D", "E")
SEPARATORS = "[,，;；、\\n\\t]"


def norm_code(c: Column) -> Column:
    """Trimmed, upper case, without a trailing ``.0`` or any white space."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"\.0$", ""), r"\s+", "")


def norm_instrument(c: Column) -> Column:
    """Report-side instrument code: five digits become six."""
    code = norm_code(c)
    return F.when(code.rlike(r"^\d{5}$"), F.lpad(code, 6, "0")).otherwise(code)


def norm_underlying(c: Column, text: Column | None = None, known: dict[str, str] | None = None) -> Column:
    """Report-side underlying code: digits padded to four; a known name in ``text`` overrides."""
    code = norm_code(c)
    out = F.when(code.rlike(r"^\d{1,3}$"), F.lpad(code, 4, "0")).otherwise(code)
    for name, fixed in (known or {}).items():
        out = F.when(F.coalesce(text.contains(name), F.lit(False)), F.lit(fixed)).otherwise(out)
    return out


def norm_official_code(c: Column) -> Column:
    """A trailing lower-case e or c is a marker; then the first six characters."""
    return F.substring(F.regexp_replace(F.trim(c), "[ec]$", ""), 1, 6)


def norm_query_code(c: Column) -> Column:
    """Front-end code: a leading quote goes, short digits are padded to four; null if it is no code then."""
    code = F.upper(F.regexp_replace(F.trim(c), "^'", ""))
    padded = F.when(code.rlike(r"^\d{1,3}$"), F.lpad(code, 4, "0")).otherwise(code)
    return F.when(padded.rlike(r"^(\d{4,6}|\d{5}[A-Z])$"), padded)


def serial_day(c: Column) -> Column:
    """Sheet serial day, accepted in 20000..80000; day 0 is 1899-12-30."""
    n = c.try_cast("double")
    return F.when((n >= 20000) & (n <= 80000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")))


def parse_day(c: Column) -> Column:
    """ISO, slashes, year-month-day characters, date-times and sheet serials, else null."""
    text = F.regexp_replace(F.trim(c), r"^'", "")
    y, m, d = (F.regexp_extract(text, r"^(\d{4})[-/年.](\d{1,2})[-/月.](\d{1,2})", k) for k in (1, 2, 3))
    iso = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    return F.coalesce(F.when(y != "", iso), serial_day(text))


def roc_to_date(c: Column) -> Column:
    """``112/11/30`` is 2023-11-30."""
    y, m, d = (F.regexp_extract(F.trim(c), r"^(\d{2,3})/(\d{1,2})/(\d{1,2})$", k) for k in (1, 2, 3))
    year = F.lpad((y.try_cast("int") + 1911).cast("string"), 4, "0")
    return F.when(y != "", F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))


def month_seq(a: Column, b: Column) -> Column:
    """The first days of all months from ``a`` to ``b``."""
    return F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month"))


def parse_period(c: Column) -> Column:
    """(start, end): the first two dates of a text; one date stands for both."""
    found = F.regexp_extract_all(c, F.lit(r"(\d{4}[-/年.]\d{1,2}[-/月.]\d{1,2})"), 1)
    first, second = parse_day(F.get(found, 0)), parse_day(F.get(found, 1))
    return F.struct(first.alias("start"), F.coalesce(second, first).alias("end"))


def safe_double(c: Column, default: float | None = None) -> Column:
    """Tolerant number: thousands marks, percent signs and full-width signs are taken off; ``default`` on failure."""
    text = F.translate(F.trim(c), "＋－，％,% ", "+-")
    n = F.regexp_replace(text, "[，％]", "").try_cast("double")
    return F.coalesce(n, F.lit(default).cast("double"))


def norm_return(c: Column, clamp: bool = False) -> Column:
    """Return in per cent as written (never times 100); ``clamp`` holds it at -100 or above."""
    n = safe_double(c)
    return F.when(n < -100, -100.0).otherwise(n) if clamp else n


def norm_win_rate(c: Column) -> Column:
    """Without a percent sign, an absolute value in (0, 1] is a share and becomes per cent."""
    n = safe_double(c)
    return F.when(~c.contains("%") & (F.abs(n) > 0) & (F.abs(n) <= 1), n * 100).otherwise(n)


def non_blank(c: Column) -> Column:
    return F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("-"))


def first_value(df: DataFrame, names: list[str], fuzzy: bool = False) -> Column:
    """First non-blank of the candidate columns that ``df`` has; ``fuzzy`` ignores spaces and percent signs in names."""
    plain = (lambda x: x.replace(" ", "").replace("％", "%")) if fuzzy else (lambda x: x)
    there = [c for n in names for c in df.columns if plain(c) == plain(n)]
    return F.coalesce(*(non_blank(F.col(c).cast("string")) for c in there)) if there else F.lit(None).cast("string")


def norm_branch_name(c: Column, suffixes: tuple[str, ...] = ("證券", "分公司", "股份有限公司")) -> Column:
    """Suffixes and separators dropped, lower case."""
    return F.regexp_replace(F.lower(c), "|".join([*suffixes, r"[\s\-_()（）#]"]), "")


def label_branch(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """Label of the first pattern that matches, else null."""
    return F.coalesce(*(F.when(c.rlike(p), F.lit(label)) for p, label in patterns))


def split_names(c: Column) -> Column:
    """Unique non-blank names in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, SEPARATORS), lambda x: F.trim(x)), lambda x: x != ""))


def parse_items(c: Column) -> Column:
    """(code, name) items of an instrument list text."""
    parts = F.filter(F.transform(F.split(c, "[；;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("code"), F.trim(F.regexp_replace(x, r"^\S+", "")).alias("name")))


def count_items(c: Column) -> Column:
    """``共 N 檔`` if stated, else the number of items."""
    stated = F.regexp_extract(c, r"共\s*(\d+)\s*檔", 1)
    return F.when(stated != "", stated.try_cast("int")).otherwise(F.size(parse_items(c)))


def underlying_name(c: Column, tokens: list[str], most: int = 12) -> Column:
    """What stands before the earliest issuer token, at most ``most`` characters."""
    at = F.array_min(F.filter(F.array(*(F.locate(t, c) for t in tokens)), lambda x: x > 1))
    return F.substring(F.when(at.isNotNull(), F.substring(c, F.lit(1), at - 1)).otherwise(c), 1, most)


def is_instrument_code(c: Column) -> Column:
    return c.rlike(r"^\d{5,6}$") & ~c.startswith("00")


def norm_event(c: Column) -> Column:
    """Event codes A-E found as single letters, joined by a slash."""
    return F.array_join(F.filter(F.array(*(F.when(c.rlike(rf"(^|[^A-Za-z]){x}([^A-Za-z]|$)"), F.lit(x)) for x in CLASSES)), lambda x: x.isNotNull()), "/")


def stat_event_kind(c: Column) -> Column:
    """Statistic event class: total before A, else null."""
    return F.when(F.lower(c).contains("total") | c.contains("總"), "total").when(c.rlike(r"(^|[^A-Za-z])A([^A-Za-z]|$)"), "A")


def amount_class(c: Column, bounds: tuple[float, ...] = AMOUNT_BOUNDS, labels: tuple[str, ...] = CLASSES) -> Column:
    """Half-open classes from their lower bounds; null below the first."""
    return reduce(lambda out, pair: F.when(c >= pair[0], F.lit(pair[1])).otherwise(out), zip(bounds, labels, strict=True), F.lit(None).cast("string"))


def result_tag(c: Column) -> Column:
    return F.when(c > 0, "win").when(c < 0, "loss").when(c == 0, "tie").otherwise("")


def sample_grade(c: Column) -> Column:
    return F.when(c < 15, "tiny").when(c < 30, "small").when(c < 60, "fair").otherwise("solid")


def bits_code(*flags: Column) -> Column:
    """Position code: one bit for each flag, null if any flag is."""
    return F.concat(*(f.cast("int").cast("string") for f in flags))


# What the position codes and low levels are called.
POSITION_NAMES = {
    "000": "短線弱勢（低於MA5、MA10、MA20）",
    "001": "僅高於MA20",
    "010": "僅高於MA10",
    "011": "高於MA10與MA20",
    "100": "僅高於MA5",
    "101": "高於MA5與MA20",
    "110": "高於MA5與MA10",
    "111": "高於MA5、MA10、MA20",
}
LOW_NAMES = {
    0: "非低檔分級",
    1: "1-短線弱勢（低於MA5、MA10、MA20）",
    2: "2-中期低檔（低於MA5～MA60）",
    3: "3-長期低檔（低於MA5～MA120）",
    4: "4-全週期低檔（低於MA5～MA240）",
}


def named(c: Column, names: dict) -> Column:
    """The name of a code; null for codes without one."""
    return reduce(lambda out, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(out), names.items(), F.lit(None).cast("string"))


def low_level(*below: Column) -> Column:
    """0 to n: how many of the nested conditions, from the first on, hold."""
    return reduce(lambda out, k: F.when(reduce(lambda a, b: a & b, below[:k]), F.lit(k)).otherwise(out), range(1, len(below) + 1), F.lit(0))


def slope(now: Column, before: Column, tolerance: float = 0.001) -> Column:
    """flat within ``tolerance`` of the value before (absolute when that is 0), else up or down."""
    change = F.when(before == 0, now - before).otherwise((now - before) / F.abs(before))
    return F.when(change.isNull(), None).when(F.abs(change) <= tolerance, "flat").when(change > 0, "up").otherwise("down")


def has_keyword(df: DataFrame, keywords: list[str]) -> Column:
    """Whether any column of a row holds one of ``keywords``."""
    return F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns)).rlike("|".join(keywords))


def fix_mojibake(c: Column) -> Column:
    """UTF-8 read as Latin-1 is repaired where that gives CJK characters."""
    latin = c.rlike(r"^[\x00-\xFF]*$")
    repaired = F.when(latin, F.decode(F.encode(F.when(latin, c).otherwise(""), "ISO-8859-1"), "UTF-8"))
    return F.when(repaired.rlike("[\\u4e00-\\u9fff]") & ~repaired.contains("�"), repaired).otherwise(c)


def fmt_amount(c: Column) -> Column:
    """億 from 1e8 on, with two places and no zeros at their end, else 萬 with one place; null counts as 0."""
    v = F.coalesce(c.cast("double"), F.lit(0.0))
    large = F.regexp_replace(F.format_string("%.2f", rounded_quotient(v, 8, 2)), r"\.?0+$", "")
    return F.when(F.abs(v) >= 1e8, F.concat(large, F.lit(" 億"))).otherwise(F.concat(F.format_string("%.1f", rounded_quotient(v, 4, 1)), F.lit(" 萬")))


def rounded_quotient(v: Column, power: int, places: int) -> Column:
    """``v / 10**power`` to ``places``, by the exact value of the quotient's double: a tie in decimals is seldom one in binary.

    The quotient times the divisor is taken as a sum of two doubles without error (its high 27 bits and the rest apart), and compared with ``v``.
    """
    divisor, unit = 10.0**power, 10.0 ** (power - places)
    a = F.abs(v)
    low = F.floor(a / unit)
    rest, quotient = a - low * unit, a / divisor
    split = quotient * 134217729.0
    high = split - (split - quotient)
    product = quotient * divisor
    over = (product - a) + ((high * divisor - product) + (quotient - high) * divisor)
    up = F.when(rest != unit / 2, rest > unit / 2).when(over != 0, over > 0).otherwise(low % 2 == 1)
    return F.signum(v) * (low + up.cast("int")) / 10.0**places


def settlement_value(kind: Column, strike: Column, settle: Column, ratio: Column, tax: float, recorded: Column, strict: bool = False) -> Column:
    """Cash value of one unit: intrinsic value times ratio after tax; 0 without a record.

    A record without a finite strike, settlement price or ratio has no value: null, or an error if ``strict``.
    """
    inputs = [x.cast("double") for x in (strike, settle, ratio)]
    known = reduce(lambda a, b: a & b, (x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) for x in inputs))
    gain = F.when(kind == "put", strike - settle).otherwise(settle - strike)
    missing = F.raise_error(F.lit("a settlement record lacks a price or a ratio")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(~F.coalesce(recorded, F.lit(False)), 0.0).when(known, F.when(gain > 0, gain).otherwise(0.0) * ratio * (1 - tax)).otherwise(missing)


def threshold_day(day: Column, months: int = 2) -> Column:
    return F.add_months(day, months)


def target_day(ts: Column, hour: int = 17) -> Column:
    """A weekday from ``hour`` on is its own target, else the weekday before."""
    day = F.to_date(ts)
    wd = F.weekday(day)
    before = F.date_sub(day, F.when(wd == 0, 3).when(wd == 6, 2).otherwise(1))
    return F.when((wd < 5) & (F.hour(ts) >= hour), day).otherwise(before)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def mask_view(df: DataFrame, columns: list[str]) -> DataFrame:
    """Public view: the named columns show no content."""
    return df.select(*(F.when(F.col(c).isNotNull(), F.lit("***")).alias(c) if c in columns else F.col(c) for c in df.columns))


def parse_broker_text(c: Column) -> Column:
    """(name, amount in 萬, return %) of each ``名稱 123.4萬（+5.2%…）`` part."""
    parts = F.filter(F.split(c, "[；;、]"), lambda x: F.trim(x) != "")
    grab = lambda x, k: F.regexp_extract(x, r"^\s*(.+?)\s+([-+]?[\d,.]+)萬(?:（([-+]?[\d.]+)%)?", k)
    return F.transform(parts, lambda x: F.struct(grab(x, 1).alias("name"), F.regexp_replace(grab(x, 2), ",", "").try_cast("double").alias("amount"), F.nullif(grab(x, 3), F.lit("")).try_cast("double").alias("ret")))


def parse_bool(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("1", "true", "yes", "y", "t", "是")


def resolve_target(code: Column, name: Column, code_of_name: Column, name_of_code: Column) -> Column:
    """Target identity: own code, else the code of the name; own name, else the name of the code."""
    return F.struct(F.coalesce(non_blank(code), code_of_name).alias("code"), F.coalesce(non_blank(name), name_of_code).alias("name"))
