"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its ``PREFIX`` nearest pivots out of ``PIVOTS``.  Distinct vectors are dealt
to blocks; a block keeps its vectors and an inverted file: for each pivot the rows that have it in their prefix and
at which place.  A query goes through the postings of its own prefix's pivots and adds up the footrule distance
(places apart; a pivot that one of the two lacks counts as at place ``PREFIX``).  Of each block the ``RERANK`` share that is nearest by
footrule, ``RERANK_LEAST`` rows at least, is measured exactly.

Blocks are written once and never move: queries go to them, ``QUERY_BYTES`` of packed query vectors a round, which is all that
the driver and a task hold of them.  A task keeps each query's nearest over all its blocks, and only these are shuffled.

Vectors of each length are a space and an index of their own.  Rows with equal vectors are one entry of the index with their ``top + 1``
smallest vec_ids, which is as many as any query can return.  A vector that is null, zero or holds null or non-finite
components takes no part, nor does a null vec_id.  Rows that repeat a vec_id with the same vector are one row; with different vectors,
each is a candidate and each a query, and none is near to another of its own vec_id.  With fewer than ``top`` candidates a query
returns all of them.  Distances are those of the vectors as doubles; one that overflows is infinite and comes last.  Empty tables give no
rows.  Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, written

PIVOTS, PREFIX, RERANK, RERANK_LEAST = 256, 96, 0.05, 200
BLOCK_ROWS, QUERY_BYTES = 4096, 8 << 20
TOP = 10

_BLOCK = "block long, gids binary, firsts binary, vectors binary, starts binary, rows binary, places binary"
_PARTS = ("gids", "firsts", "vectors", "starts", "rows", "places")
_FOUND = "q_gid long, gid long, first long, score double"
_RESULT = "query_id long, rank int, vec_id long, score double"


def usable_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    return good.where(finite & F.exists("embedding", lambda x: x != 0)).distinct()


def distinct_vectors(rows: DataFrame, top: int) -> DataFrame:
    """(gid, embedding, ids): each distinct vector with its ``top + 1`` smallest vec_ids; ``gid`` numbers the vectors."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= top + 1)
    return first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("gid"), "embedding", "ids")


def pick_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """``pivots`` vectors (all, if fewer) by smallest hash: a bounded sample of the distinct vectors."""
    rows = vectors.orderBy(F.xxhash64("embedding"), "embedding").limit(pivots).select("embedding").collect()
    return np.array([r[0] for r in rows], np.float64)


def prefixes(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each row of ``x``, nearest first, ties to the earlier pivot."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = (x * x).sum(axis=1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(axis=1)
    return np.argsort(apart, axis=1, kind="stable")[:, :prefix]


def build_index(vectors: DataFrame, n: int, pivots: np.ndarray, prefix: int, block_rows: int) -> DataFrame:
    """A row for each block: its gids, vectors and pivot inverted file, as a written table."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        near = prefixes(x, pivots, prefix)
        order = np.argsort(near.ravel(), kind="stable")
        starts = np.searchsorted(near.ravel()[order], np.arange(len(pivots) + 1)).astype(np.int32)
        arrays = rows["gid"].to_numpy(np.int64), rows["first"].to_numpy(np.int64), x, starts, (order // near.shape[1]).astype(np.int32), (order % near.shape[1]).astype(np.int16)
        return pd.DataFrame([[key[0], *(a.tobytes() for a in arrays)]], columns=["block", *_PARTS])

    blocks = max(1, math.ceil(n / block_rows))
    dealt = vectors.select("gid", F.element_at("ids", 1).alias("first"), "embedding", F.pmod(F.xxhash64("gid"), F.lit(blocks)).alias("block"))
    return written(dealt.groupBy("block").applyInPandas(build, _BLOCK), "blocks")


class Block:
    """One row of the index, opened for searching."""

    def __init__(self, gids: bytes, firsts: bytes, vectors: bytes, starts: bytes, rows: bytes, places: bytes):
        self.gids, self.firsts, self.starts = np.frombuffer(gids, np.int64), np.frombuffer(firsts, np.int64), np.frombuffer(starts, np.int32)
        self.x = np.frombuffer(vectors, np.float64).reshape(len(self.gids), -1)
        self.rows, self.places = np.frombuffer(rows, np.int32), np.frombuffer(places, np.int16)

    def search(self, query: np.ndarray, near: np.ndarray, want: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and places in the block of the ``top`` nearest of the ``want`` rows that the footrule puts first; ``near`` is the query's prefix."""
        if want < len(self.gids):
            # Footrule, less the constant that a row without any shared pivot has: shared ones earn back what they are charged.
            gain = np.zeros(len(self.gids), np.int32)
            for place, pivot in enumerate(near.tolist()):
                a, b = self.starts[pivot], self.starts[pivot + 1]
                there = self.places[a:b]
                gain[self.rows[a:b]] += 2 * (len(near) - np.maximum(there, place))
            some = np.argpartition(-gain, want - 1)[:want]
        else:
            some = np.arange(len(self.gids))
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.sqrt(((self.x[some] - query) ** 2).sum(axis=1))
        best = np.lexsort((self.firsts[some], exact))[:top]
        return exact[best], some[best]


def search_index(index: DataFrame, asked: DataFrame, pivots: np.ndarray, prefix: int, share: float, least: int, top: int) -> DataFrame:
    """(q_gid, gid, first, score): the ``top`` nearest found of each row of ``asked`` (gid, embedding), as a written table."""
    spark, path = index.sparkSession, scratch_path(index.sparkSession, "found")
    per_round = max(1, QUERY_BYTES // (8 * pivots.shape[1]))
    rounds = max(1, math.ceil(asked.count() / per_round))
    dealt = asked.withColumn("round", F.pmod(F.xxhash64("gid"), F.lit(rounds)).cast("int"))
    to = scratch_path(spark, "queries")
    dealt.write.partitionBy("round").parquet(to)
    for k in range(rounds):
        rows = spark.read.schema(dealt.schema).parquet(to).where(F.col("round") == k).select("gid", "embedding").toPandas()  # QUERY_BYTES, about
        if not len(rows):
            continue
        sent = spark.sparkContext.broadcast((rows["gid"].to_numpy(np.int64), np.stack(rows["embedding"].to_numpy()).astype(np.float64)))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, queries = sent.value
            near = prefixes(queries, pivots, prefix)
            scores, gids, firsts = np.full((len(ids), top), np.nan), np.full((len(ids), top), -1, np.int64), np.zeros((len(ids), top), np.int64)  # nan sorts last
            for batch in batches:
                for row in range(batch.num_rows):
                    block = Block(*(batch.column(c)[row].as_py() for c in _PARTS))
                    want = max(least, math.ceil(share * len(block.gids)))
                    for i, query in enumerate(queries):
                        got, of = block.search(query, near[i], want, top)
                        both, first, gid = np.concatenate([scores[i], got]), np.concatenate([firsts[i], block.firsts[of]]), np.concatenate([gids[i], block.gids[of]])
                        best = np.lexsort((first, both))[:top]
                        scores[i], firsts[i], gids[i] = both[best], first[best], gid[best]
            q, at = np.nonzero(gids >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(gids[q, at]), pa.array(firsts[q, at]), pa.array(scores[q, at])], names=["q_gid", "gid", "first", "score"])

        index.mapInArrow(search, _FOUND).write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(_FOUND).parquet(path)


def _nearest_of_length(rows: DataFrame, is_query: str, top: int, pivots: int, prefix: int, share: float, least: int, block_rows: int) -> DataFrame:
    vectors = written(distinct_vectors(rows, top), "distinct")
    chosen = pick_pivots(vectors, pivots)
    index = build_index(vectors, vectors.count(), chosen, prefix, block_rows)
    queries = rows.where(is_query)
    own = queries.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    depth = top + own  # so many may be the query's own
    asked = written(queries.join(vectors.select("embedding", "gid"), "embedding").select(F.col("vec_id").alias("query_id"), "gid"), "asked")
    wanted = asked.select("gid").distinct().join(vectors.select("gid", "embedding"), "gid")
    found = search_index(index, wanted, chosen, prefix, share, least, depth)
    best = Window.partitionBy("q_gid").orderBy("score", "first")
    near = found.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= depth)
    hit = F.transform("ids", lambda v: F.struct(F.col("score").alias("score"), v.alias("vec_id")))
    hits = near.join(vectors.select("gid", "ids"), "gid").groupBy("q_gid").agg(F.array_sort(F.flatten(F.collect_list(hit))).alias("hits"))
    hits = written(hits, "hits")
    mine = asked.join(hits, asked["gid"] == hits["q_gid"]).select("query_id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, top).alias("hits"))
    return mine.select("query_id", F.posexplode("hits").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def nearest(table: DataFrame, is_query: str, top: int = TOP, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = RERANK, least: int = RERANK_LEAST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``table`` (vec_id, embedding) where ``is_query`` holds, against all other rows."""
    rows = written(usable_vectors(table).withColumn("d", F.size("embedding")), "vectors")
    out = table.sparkSession.createDataFrame([], _RESULT)
    for (d,) in rows.where(is_query).select("d").distinct().orderBy("d").collect():  # one index for each length that is asked for
        out = out.union(_nearest_of_length(rows.where(F.col("d") == d).drop("d"), is_query, top, pivots, prefix, share, least, block_rows))
    return out
