"""Substring dedup: passages that also stand in an earlier document, found by super-k-mers.

A window is ``width`` consecutive words of a document.  Its minimiser is the smallest hash of its runs of ``MINI`` words.  Consecutive windows of
one minimiser are a super-k-mer: their words travel once, as one packed string, to the bucket of that
minimiser, where all windows of equal words meet whatever stands around them.  Before that, only the minimisers travel, and super-k-mers whose bucket would have one document alone
stay where they are.  In the bucket the strings are sorted, those that no earlier document has are opened into windows, and these are sorted; equal ones
stand together, and the smallest doc_id among them is known.  Windows are told apart by bucket and 128 bits of hash over all their words.

Hot groups: documents of equal words are one from the start, that of the smallest doc_id.  A minimiser with more than about
one in ``HOT`` of all super-k-mers is hot; there are fewer than 4/3 ``HOT`` of these, found by counts of each batch whose error has a bound (a batch's
minimisers below a quarter of that share aren't counted).  Its super-k-mers are dealt out evenly instead; their strings, and the windows of each string's first document, are sorted over ranges, where one
string or window may take up several tasks.  Results don't depend on which are hot.

``doc_id`` names a document: rows that repeat one are judged each, on their own text, against smaller doc_ids only.  Rows without a doc_id
keep all words and make no others go.  Null or blank texts have no words.  Texts of less than ``width`` words have no windows.
Columns other than doc_id and text are left out.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, small_batches, small_by_bytes, written

WIDTH = 13
#: Words of the runs that minimisers are taken from.
MINI = 4
#: Windows that travel in one string at most; longer runs of one minimiser are cut.
MOST_RUN = 64
HOT = 1000
#: Bytes of texts that are hashed at once.
CHUNK = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: A number for each byte.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class _Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as many as have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(2 * n, _BASE))])
            self.down = np.concatenate([one, np.cumprod(np.full(2 * n, inverse))])
        return self.up[:n], self.down[:n]


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x, have = np.minimum(x[: len(x) - step], x[step:]), have + step
    return x


class Runs:
    """The super-k-mers of some texts: ``minimiser``, ``doc`` (the text's place), ``start`` (its first word in the text), and its words as one string."""

    def __init__(self, texts: list[bytes], width: int, powers: _Powers):
        """``texts`` are words joined by one space."""
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        gaps = np.flatnonzero((data == 32) | (data == 10))
        begins = np.concatenate([[0], gaps[:-1] + 1])
        lines = np.cumsum(data[gaps] == 10)
        doc = np.concatenate([[0], lines[:-1]])  # of each word; an empty text has one, of no bytes
        up, down = powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:-1])])
        words = _mix((sums[gaps] - sums[begins]) * down[begins])
        self.minimiser, self.doc, self.start, self.packed = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        if len(words) < width:
            return
        grams = words[: len(words) - MINI + 1]
        for k in range(1, MINI):
            grams = _mix(grams * _BASE + words[k : len(words) - MINI + 1 + k])
        least = _sliding_min(grams, width - MINI + 1)
        at = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])
        if not len(at):
            return
        value = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1])
        first = np.flatnonzero(new)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        first = np.flatnonzero(place % MOST_RUN == 0)
        last = np.append(first[1:], len(at)) - 1
        first_word = np.searchsorted(doc, np.arange(len(texts)))
        self.minimiser, self.doc = value[first].view(np.int64), doc[at[first]]
        self.start = at[first] - first_word[self.doc]
        self.bounds = begins[at[first]], gaps[at[last] + width - 1]
        self.joined = joined

    def strings(self, picked: np.ndarray) -> list[bytes]:
        joined = self.joined
        return [joined[a:b] for a, b in zip(*(x[picked].tolist() for x in self.bounds), strict=True)]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text) + 1
        if size >= CHUNK:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


_FEATURES = "doc_id long, text_key long, n_words long, print binary, minimiser long, times long, total long"


def _features(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds, as a written table: each document's length and print, and batches' counts of frequent minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        powers = _Powers()
        names = [x.split()[0] for x in _FEATURES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            words = [split_words(t) for t in batch.column(2).to_pylist()]
            texts = [b" ".join(w) for w in words]
            found = [Runs(texts[a:b], width, powers).minimiser for a, b in _chunks(texts)]
            seen, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            total = int(times.sum())
            often = times * 4 * HOT >= total
            n, more = len(words), int(often.sum()) + 1
            columns = [
                batch.column(0).to_pylist() + [None] * more, batch.column(1).to_pylist() + [None] * more, [len(w) for w in words] + [None] * more, [xxhash.xxh3_128_digest(t) for t in texts] + [None] * more,
                [None] * n + seen[often].tolist() + [None], [None] * n + times[often].tolist() + [None], [None] * (n + more - 1) + [total],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return written(docs.select("doc_id", "text_key", "text").mapInArrow(run, _FEATURES), "features")


def _hot(features: DataFrame) -> list[int]:
    """Minimisers that make up more than one in ``HOT`` super-k-mers, and some of more than three quarters of that share: 4/3 ``HOT`` at most."""
    total = features.agg(F.sum("total")).first()[0] or 0
    counted = features.where("minimiser is not null").groupBy("minimiser").agg(F.sum("times").alias("times"))
    return [r["minimiser"] for r in counted.where(F.col("times") * 4 * HOT >= 3 * total).select("minimiser").collect()]


_PLACES = "hot boolean, bucket long, doc_id long, text_key long, start int"


def _dealt(ids: np.ndarray, keys: np.ndarray, start: np.ndarray) -> np.ndarray:
    return _mix(keys.view(np.uint64) + _mix(start.view(np.uint64) + ids.view(np.uint64) * _BASE)).view(np.int64)


def _runs(batch: pa.RecordBatch, width: int, powers: _Powers, hot: np.ndarray) -> Iterator[tuple[Runs, np.ndarray, list[pa.Array]]]:
    """Of each chunk of a batch (doc_id, text_key, text): its super-k-mers, the rows they are of, and the columns of ``_PLACES``."""
    ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    texts = [b" ".join(split_words(t)) for t in batch.column(2).to_pylist()]
    for a, b in _chunks(texts):
        runs = Runs(texts[a:b], width, powers)
        if len(runs.minimiser):
            of = a + runs.doc
            is_hot = np.isin(runs.minimiser, hot)
            bucket = np.where(is_hot, _dealt(ids[of], keys[of], runs.start), runs.minimiser)
            yield runs, of, [pa.array(is_hot), pa.array(bucket), pa.array(ids[of]), pa.array(keys[of]), pa.array(runs.start.astype(np.int32))]


def shared_places(docs: DataFrame, hot: list[int], width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, starts) of the super-k-mers that may hold a window of two documents, as a written table.

    They travel to their buckets by number alone first: the windows of a bucket that one document has alone stand in no other.
    """
    known = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            for _, _, columns in _runs(batch, width, powers, known):
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PLACES.split(", ")])

    places = docs.select("doc_id", "text_key", "text").mapInArrow(run, _PLACES)
    bucket = Window.partitionBy("bucket")
    met = places.withColumns({"lo": F.min("doc_id").over(bucket), "hi": F.max("doc_id").over(bucket)}).where("hot or lo < hi")
    return written(met.groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts")), "places")


def super_kmers(docs: DataFrame, hot: list[int], width: int = WIDTH) -> DataFrame:
    """(hot, bucket, doc_id, text_key, start, packed) of the super-k-mers that begin at ``starts``, from (doc_id, text_key, text, starts).

    A super-k-mer is a document's windows, joined where one minimiser follows on itself; ``start`` is its first word's place, from 0, and ``packed``
    the words of all its windows.  The bucket is the minimiser, or, for hot ones, any.
    """
    known = np.array(sorted(hot), np.int64)
    schema = _PLACES + ", packed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            wanted = batch.column(3)
            of_list, starts = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy())), wanted.flatten().to_numpy()
            asked = (of_list << 32) + starts
            for runs, of, columns in _runs(batch, width, powers, known):
                picked = np.isin((of << 32) + runs.start, asked)
                columns = [c.filter(pa.array(picked)) for c in columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(runs.strings(picked), pa.string())], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text_key", "text", "starts").mapInArrow(run, schema)


def _keys(i: Column, width: int) -> Column:
    """128 bits of hash of the window of the words ``w`` that begins at the ``i``-th."""
    words = F.slice("w", i, width)
    return F.struct((F.col("start") + i - 1).alias("a"), F.lit(1).alias("n"), F.xxhash64(words).alias("k1"), F.xxhash64(F.lit(1), words).alias("k2"))


def _opened(width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("w") - (width - 1)), lambda i: _keys(i, width))


_CLAIM, _HOT, _WINDOW = "claim", "hot window", "window"
_PLACE = ["doc_id", "text_key", "a", "n"]


def _bucket_claims(runs: DataFrame, width: int) -> DataFrame:
    """(kind, doc_id, text_key, a, n, k1, k2), as a written table: places that an earlier document has as well, as first word and number of windows, and hot windows.

    In a bucket, strings are sorted first: all windows of a string that an earlier document has are that document's.  The others are
    opened, and their windows sorted.
    """
    words = runs.withColumn("least", F.min("doc_id").over(Window.partitionBy("bucket", "packed"))).withColumn("w", F.split("packed", " "))
    whole = F.array(F.struct(F.col("start").alias("a"), (F.size("w") - (width - 1)).alias("n"), F.col("text_key").alias("k1"), F.xxhash64("doc_id", "start").alias("k2")))
    kind = F.when(F.col("hot"), _HOT).when(F.col("doc_id") > F.col("least"), _CLAIM).otherwise(_WINDOW)
    rows = words.withColumn("kind", kind).select("kind", "bucket", "doc_id", "text_key", F.explode(F.when(F.col("kind") == _CLAIM, whole).otherwise(_opened(width))).alias("x"))
    rows = rows.select("kind", "bucket", "doc_id", "text_key", "x.*")
    first = F.min(F.when(F.col("kind") == _WINDOW, F.col("doc_id"))).over(Window.partitionBy("bucket", "k1", "k2"))
    return written(rows.withColumn("first", first).where((F.col("kind") != _WINDOW) | (F.col("doc_id") > F.col("first"))).drop("bucket", "first"), "bucket-claims")


_SCANNED = "part int, kind int, doc_id long, text_key long, a int, n int, k1 long, k2 long, packed string"
_LATER, _EARLIEST, _OPEN, _FIRST, _LAST = range(5)


def _by_ranges(rows: DataFrame, parts: int, earliest: bool) -> tuple[DataFrame, DataFrame]:
    """(later, earliest): ``rows`` (k1, k2, doc_id, text_key, a, n, packed) of whose key (k1, k2) a smaller doc_id has a row, and, if asked for, the rest.

    Rows are sorted by key and doc_id over ranges of about equal size, so that a key with very many documents is spread over several
    tasks.  A task knows the smallest doc_id of each of its keys but, maybe, the first one, which may have begun before: rows of that are left
    ``_OPEN``, and the task hands on how it begins and ends.  The driver follows these ends, two for each task, from range to range.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, last = TaskContext.get().partitionId(), None, None
        names = [x.split()[0] for x in _SCANNED.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

        def table(kind: np.ndarray, packed: pa.Array, *columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip([np.full(len(kind), part), kind, *columns], kinds, strict=True)), packed], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, doc, key, a, n = (batch.column(c).to_numpy() for c in range(6))
            new = np.ones(len(k1), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            new[0] = last is None or last[:2] != (k1[0], k2[0])
            least = np.concatenate([[0 if last is None else last[2]], doc[np.flatnonzero(new)]])[np.cumsum(new)]
            first = first or (k1[0], k2[0], doc[0])
            last = (k1[-1], k2[-1], least[-1])
            kind = np.where((k1 == first[0]) & (k2 == first[1]), _OPEN, np.where(doc > least, _LATER, _EARLIEST))
            kept = slice(None) if earliest else kind != _EARLIEST
            packed = batch.column(6) if earliest else batch.column(6).filter(pa.array(kept))
            yield table(kind[kept], packed, *(c[kept] for c in (doc, key, a, n, k1, k2)))
        if first:
            ends = [np.array(x, np.int64) for x in zip(first, last, strict=True)]
            none = np.zeros(2, np.int64)
            yield table(np.array([_FIRST, _LAST]), pa.array([None, None], pa.string()), ends[2], none, none.astype(np.int32), none.astype(np.int32), ends[0], ends[1])

    order = ["k1", "k2", "doc_id"]
    ranged = rows.select(*order, "text_key", "a", "n", "packed").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    scanned = written(ranged.mapInArrow(scan, _SCANNED), "ranges")
    least, ended, first = {}, None, None
    for r in sorted(scanned.where(F.col("kind") >= _FIRST).select("part", "kind", "k1", "k2", "doc_id").collect()):
        if r["kind"] == _FIRST:
            first = r
            least[r["part"]] = ended["doc_id"] if ended and (ended["k1"], ended["k2"]) == (r["k1"], r["k2"]) else r["doc_id"]
        else:
            same = (first["k1"], first["k2"]) == (r["k1"], r["k2"])
            ended = {"k1": r["k1"], "k2": r["k2"], "doc_id": least[r["part"]] if same else r["doc_id"]}
    by_part = F.array(*(F.lit(least.get(k, 0)).cast("long") for k in range(max(least, default=0) + 1)))
    is_later = (F.col("kind") == _LATER) | ((F.col("kind") == _OPEN) & (F.col("doc_id") > F.get(by_part, F.col("part"))))
    return scanned.where(is_later), scanned.where((F.col("kind") < _FIRST) & ~is_later)


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, spans, whole) of the texts that have windows of earlier documents; ``text_key`` is ``xxhash64`` of the text.

    ``spans``: (first, last) words of runs of such windows, from 0, in order.  ``whole``: the text's words are all those of an earlier document.
    """
    spark = docs.sparkSession
    small_batches(spark, 250)
    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    features = _features(keyed, width)
    each = features.where("n_words is not null")
    least = each.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    least = written(least, "prints")
    copies = each.where(f"n_words >= {width}").join(small(least, least.count()), "print").where("doc_id > first").select("doc_id", "text_key").distinct()
    copies = written(copies, "copies")
    own = keyed.join(small(copies, copies.count()), ["doc_id", "text_key"], "left_anti")
    hot = _hot(features)
    met = shared_places(own, hot, width)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = written(super_kmers(keyed.join(met, ["doc_id", "text_key"]), hot, width), "super-k-mers")
    strings = runs.where("hot").select(F.xxhash64("packed").alias("k1"), F.xxhash64(F.lit(1), "packed").alias("k2"), "doc_id", "text_key", F.col("start").alias("a"), (F.size(F.split("packed", " ")) - (width - 1)).alias("n"), "packed")
    again, firsts = _by_ranges(strings, parts, earliest=True)
    firsts = firsts.select(F.lit(True).alias("hot"), F.xxhash64("k1", "doc_id", "a").alias("bucket"), "doc_id", "text_key", F.col("a").alias("start"), "packed")
    met = _bucket_claims(runs.where("not hot").unionByName(firsts).repartition(parts, "bucket"), width)
    windows, _ = _by_ranges(met.where(F.col("kind") == _HOT).withColumn("packed", F.lit(None).cast("string")), parts, earliest=False)
    places = met.where(F.col("kind") != _HOT).select(_PLACE).union(again.select(_PLACE)).union(windows.select(_PLACE))
    until = F.max(F.col("a") + F.col("n")).over(Window.partitionBy("doc_id", "text_key").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("a") <= F.col("until"), 0).otherwise(1)).over(Window.partitionBy("doc_id", "text_key").orderBy("a").rowsBetween(Window.unboundedPreceding, 0))
    islands = places.withColumn("until", until).withColumn("island", island).groupBy("doc_id", "text_key", "island").agg(F.min("a").alias("a"), (F.max(F.col("a") + F.col("n")) + width - 2).alias("b"))
    spans = islands.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct(F.col("a").alias("first"), F.col("b").alias("last")))).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return written(spans.withColumn("whole", F.lit(False)).unionByName(copies.select("doc_id", "text_key", none.alias("spans"), F.lit(True).alias("whole"))), "spans")


_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_removed, kept (the words that are left, joined by one space)."""
    spans = repeated_spans(docs, width)
    found = small_by_bytes(spans.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"}))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = rows.join(found, (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_key")), "left").select("doc_id", "text", "spans.first", "spans.last", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, first, last, whole in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                words = split_words(text)
                left, upto = [], 0
                for a, b in zip(first or (), last or (), strict=True):
                    left += words[upto : max(a, upto)]
                    upto = max(upto, b + 1)
                left = [] if whole else left + words[upto:]
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[x.split()[0] for x in _KEPT.split(", ")])

    return met.mapInArrow(run, _KEPT)
