"""What the operators of this subpackage share: the scratch folder and its tables."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_path

#: Broadcast sides are counted first; above this many narrow rows the join is left to shuffle.
BROADCAST_ROWS = 200_000
#: Rows that hold texts or lists are measured instead, as JSON text.
BROADCAST_BYTES = 32 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``), or in that of the ``scratch_run`` going on."""
    return shared_path(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint on ``df`` if its counted ``rows`` are within ``limit``; else ``df`` as it is."""
    return F.broadcast(df) if rows <= limit else df


def small_by_bytes(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint on the written table ``df`` if its rows, as JSON text, have at most ``limit`` bytes; else ``df`` as it is."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df


class Remembered(dict):
    """Words and what an operator has found for them: at most ``limit`` bytes, about; beyond, all are forgotten.

    ``learned`` is called after words were added.  A Python worker holds the words of one operator only (``remembered``).
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.used = limit, 0

    def learned(self, words: Iterable[bytes] | Iterable[str]) -> None:
        self.used += sum(sys.getsizeof(w) + sys.getsizeof(self[w]) + 100 for w in words)  # 100: the slot in the table

    def make_room(self) -> None:
        if self.used > self.limit:
            self.clear()
            self.used = 0


_held: tuple[str, Remembered | None] = ("", None)


def remembered(owner: str, limit: int = 64 << 20) -> Remembered:
    """This Python worker's words of the operator ``owner``, kept from task to task; those of any other operator are dropped."""
    global _held
    if _held[0] != owner:
        _held = ("", None)
        _held = (owner, Remembered(limit))
    return _held[1]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python ``rows`` at a time, at most: Arrow's buffers of both sides are of a batch's size.

    A setting of the session that only makes batches smaller; results don't depend on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def ascii_words(text: Column) -> Column:
    """Words between ASCII white space (space and U+0009 to U+000D); null text has no words."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")
