"""Chat formatting after collapsing cumulative snapshots, in DataFrame operations only.

A log that writes a conversation anew after each turn holds many conversations that are the beginning of a
longer one.  Every turn gets a rolling hash of the turns up to it: the exclusive or, over these turns, of a 128-bit hash
of place, role and text.  A conversation whose last hash is that of an earlier turn of another one is
dropped by an anti-join; of equal conversations the smallest conv_id stays.  What stays is rendered.

Turns are ordered by (turn, role, text); rows equal in conv_id, turn, role and text are one turn.  A null
role is rendered as "unknown", a null text as an empty one, and both differ from each other's spelling in the hash.
A row without a conv_id is a conversation of its own, of one turn: such rows have nothing in common, and there may be any number of them.  Roles and texts that hold the markers themselves are rendered
with the marker's first character doubled, so that a rendering has one reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

OPEN, CLOSE = "<|turn|>", "<|end|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, lone, at, role, text, ha, hb, n): place from 1, the hash of the turns up to it, and the number of turns.

    ``lone``: the row itself where it has no conv_id, so that (conv_id, lone) names a conversation.
    """
    whole = Window.partitionBy("conv_id", "lone")
    order = whole.orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    placed = rows.withColumn("lone", F.when(F.col("conv_id").isNull(), F.struct("turn", "role", "text"))).withColumn("at", F.row_number().over(order))
    parts = [F.col("at"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    hashed = placed.withColumn("a", F.xxhash64(F.lit(1), *parts)).withColumn("b", F.conv(F.substring(F.md5(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))))), 1, 15), 16, 10).cast("long"))
    return hashed.select("conv_id", "lone", "at", "role", "text", F.bit_xor("a").over(upto).alias("ha"), F.bit_xor("b").over(upto).alias("hb"), F.count("*").over(whole).alias("n"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, lone, n_turns, n_equal) of the conversations that are no proper beginning of another one."""
    return _maximal(prefix_hashes(turns))


def _maximal(hashed: DataFrame) -> DataFrame:
    ends = hashed.where("at = n").groupBy("at", "ha", "hb").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "lone")).alias("c"), F.count("*").alias("n_equal"))
    inside = hashed.where("at < n").select("at", "ha", "hb").distinct()
    return ends.join(inside, ["at", "ha", "hb"], "left_anti").select("c.conv_id", "c.lone", F.col("at").cast("long").alias("n_turns"), "n_equal")


def _plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<" + OPEN)), F.lit(CLOSE), F.lit("<" + CLOSE))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, rendered) of the conversations in ``kept``; ``turns`` as from ``prefix_hashes``."""
    line = F.concat(F.lit(OPEN), _plain(F.coalesce("role", F.lit("unknown"))), F.lit("\n"), _plain(F.coalesce("text", F.lit(""))), F.lit(CLOSE))
    named = kept.withColumnsRenamed({"conv_id": "_kept", "lone": "_lone"})
    wanted = turns.join(named, F.col("conv_id").eqNullSafe(F.col("_kept")) & F.col("lone").eqNullSafe(F.col("_lone")))
    lines = wanted.groupBy("conv_id", "lone", "n_turns", "n_equal").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"))
    return lines.select("conv_id", "n_turns", "n_equal", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("rendered"))


def formatted_chats(turns: DataFrame) -> DataFrame:
    """The maximal conversations of ``turns`` (conv_id, turn, role, text; other columns are left out), rendered."""
    hashed = written(prefix_hashes(turns), "turns")
    kept = written(_maximal(hashed), "maximal")
    return render(hashed, kept)


#: The same in DuckDB's SQL: turns as lists, compared whole.
ORACLE = """
WITH placed AS (
  SELECT conv_id, lone, role, text, row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text, CASE WHEN conv_id IS NULL THEN {'t': turn, 'r': role, 'x': text} END AS lone FROM conversations)
), convs AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS turns,
    string_agg('<|turn|>' || replace(replace(coalesce(role, 'unknown'), '<|turn|>', '<<|turn|>'), '<|end|>', '<<|end|>') || chr(10)
      || replace(replace(coalesce(text, ''), '<|turn|>', '<<|turn|>'), '<|end|>', '<<|end|>') || '<|end|>', chr(10) ORDER BY pos) AS rendered
  FROM placed GROUP BY conv_id, lone
), kinds AS (
  SELECT turns, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_equal, any_value(rendered) AS rendered FROM convs GROUP BY turns
), inside AS (
  SELECT DISTINCT turns[1:k] AS part FROM kinds, LATERAL (SELECT unnest(range(1, n)) AS k)
)
SELECT conv_id, n AS n_turns, n_equal, rendered FROM kinds WHERE turns NOT IN (SELECT part FROM inside)
"""
