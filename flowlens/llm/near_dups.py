"""Near-duplicate documents by one-permutation hashing with optimal densification.

A document's word shingles are hashed once; the hash's low half picks one of ``BANDS * ROWS`` bins and the
smallest hash of a bin is its value.  Empty bins copy a filled bin that a fixed pseudo-random walk over the
bins meets first (optimal densification), so documents agree in a bin as often as their sets overlap.  Bins
are taken together in bands; documents that agree in a whole band share a bucket.

A bucket proposes a star: its smallest document against each other one.  Links are confirmed on the full
sets of shingles, taken from the texts.  A bucket whose members the confirmed links do not yet join is not left
there: its members are joined again by their sets' rarest shingles, which leaves the pairs of different components that an
exact prefix, size, position and bit filter can't rule out; each of these is compared.  No bucket is capped.

``doc_id`` names a document: rows that repeat one are one node with the links of all their texts, and each gets
the result.  Other columns are left out, or kept by ``deduplicated``.  Documents of equal sets are one node from the start.  Null or blank texts, and null doc_ids, are
linked with nothing (``component_id`` is the doc_id).  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remembered, small, small_batches, written

BANDS, ROWS = 48, 6
THRESHOLD = 80
#: Steps of the densifying walk; documents with bins still empty then take the next filled bin.
WALK = 2048

#: Bits of a set's parity print, in words of 64.
PRINT_WORDS = 4

FEATURES = "doc_id long, n_shingles long, fingerprint binary, bands array<long>"

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of ``width`` words; all words as one run if there are fewer."""
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def _densify(signatures: np.ndarray, filled: np.ndarray) -> None:
    n, k = signatures.shape
    base = signatures.copy()
    rows, cols = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for step in range(1, WALK):
        if not len(rows):
            return
        seed = cols.astype(np.uint64) * np.uint64(WALK) + np.uint64(step)
        source = ((_mix(seed * _A) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        got = filled[rows, source]
        signatures[rows[got], cols[got]] = base[rows[got], source[got]]
        rows, cols = rows[~got], cols[~got]
    for row, col in zip(rows.tolist(), cols.tolist(), strict=True):
        places = np.flatnonzero(filled[row])
        signatures[row, col] = base[row, places[np.searchsorted(places, col) % len(places)]]


class Signer:
    """Set size, set fingerprint and band keys of texts.  A Python worker remembers words from task to task."""

    def __init__(self, width: int):
        self.width, self.known = width, remembered("near_dups", 32 << 20)

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            known.make_room()
            fresh = {w for w in words if w not in known}
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in fresh)
            known.learned(fresh)
            return np.array([known[w] for w in words], np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        words = split_words(text)
        if not words:
            return np.zeros(0, np.uint64)
        h = self.word_hashes(words)
        width = min(self.width, len(words))
        total = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            total = _mix(total * _A + h[k : len(h) - width + k + 1])
        return np.unique(total)

    def __call__(self, texts: list[str | None]) -> tuple[list[int], list[bytes], list[list[int]]]:
        import xxhash

        k = BANDS * ROWS
        signatures, filled = np.zeros((len(texts), k), np.uint64), np.zeros((len(texts), k), bool)
        sizes, prints = [], []
        for i, text in enumerate(texts):
            u = self.shingles(text)
            sizes.append(len(u))
            prints.append(xxhash.xxh3_128_digest(u.tobytes()))
            bins = ((u & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            signatures[i, bins[::-1]] = u[::-1]  # sorted, so that the smallest of a bin is set last
            filled[i, bins] = True
        _densify(signatures, filled)
        parts = signatures.reshape(len(texts), BANDS, ROWS)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(texts), BANDS))
        for j in range(ROWS):
            keys = _mix(keys * _A + parts[:, :, j])
        return sizes, prints, [row if size else [] for row, size in zip(keys.view(np.int64).tolist(), sizes, strict=True)]


def features(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, fingerprint, bands) for each row of ``docs``, as a written table."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                some = batch.slice(at, 250)
                sizes, prints, bands = signer(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fingerprint", "bands"])

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, FEATURES), "features")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose full shingle sets overlap by ``threshold`` per cent or more, as a written table."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, set] = ("", set())
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if text_a != last[0]:
                    last = (text_a, shingle_set(split_words(text_a), width))
                other = shingle_set(split_words(text_b), width)
                shared = len(last[1] & other)
                keep.append(shared > 0 and 100 * shared >= threshold * (len(last[1]) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(compare, "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches, by minima over links and pointer jumps."""
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        moved = written(lower.join(jump, "label").select("node", F.least("label", "beyond").alias("label"), "was"), "labels")
        changed = moved.where("label <> was").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def _fit(a: str, b: str, threshold: int) -> str:
    return f"100 * least({a}, {b}) >= {threshold} * greatest({a}, {b})"


def _bucket_members(spark: SparkSession, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, node, n, center, center_n) of the buckets that hold two nodes or more, as a written table."""
    nodes = rows.join(reps, "fingerprint").where("doc_id = node").select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    nodes = written(nodes, "bands")
    buckets = nodes.groupBy("key").agg(F.min("node").alias("center"), F.min_by("n", "node").alias("center_n"), F.max("node").alias("last")).where("center <> last")
    buckets = written(buckets.drop("last"), "buckets")
    return written(nodes.join(buckets, "key").select("key", "node", "n", "center", "center_n").distinct(), "members")


def parity_print(u: np.ndarray) -> np.ndarray:
    """Bits that each member of a set flips one of: two sets' prints differ in no more bits than the sets in members."""
    size = 64 * PRINT_WORDS
    flips = np.bincount((_mix(u ^ _A) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(bool), bitorder="little").view(np.int64)


def _prefix_members(nodes: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """(key, node, n, ahead, bits): the shingles of each node's prefix, as a written table.

    Shingles are ordered by how many of ``nodes`` have them, rarest first.  Sets that overlap enough share one of the first
    ``n - ceil(threshold * n) + 1`` of each; a passage that many documents share stands at the end of that order.  ``ahead``
    counts the set's shingles from this one on; ``bits`` is the set's parity print.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                some = batch.slice(at, 250)
                sets = [signer.shingles(x) for x in some.column(1).to_pylist()]
                columns = [some.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([parity_print(x) for x in sets], pa.list_(pa.int64())), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "bits", "keys"])

    wanted = texts.join(nodes, "node", "left_semi").select("node", "text")
    rows = written(wanted.mapInArrow(cut, "node long, n long, bits array<long>, keys array<long>").select("node", "n", "bits", F.explode("keys").alias("key")), "shingles")
    shared = written(rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    order = Window.partitionBy("node", "n", "bits").orderBy("df", "key")
    ranked = rows.join(shared, "key", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("rank", F.row_number().over(order))
    prefix = ranked.where(f"rank <= n - ceil({threshold} * n / 100.0 - 1e-9) + 1 and df > 1")
    return written(prefix.select("key", "node", "n", F.expr("n - rank + 1").alias("ahead"), "bits").distinct(), "prefixes")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")


def _open_keys(known: DataFrame) -> DataFrame:
    """Keys whose members aren't one component."""
    return known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi")


def _sizes(n: str) -> str:
    """The class of a set's size: its own for small ones, then by quarters; classes grow with sizes."""
    return f"cast(if({n} <= 32, {n}, 33 + floor(ln({n} / 32D) / ln(1.25D))) as bigint)"


def _as_smaller(rows: DataFrame, mark: str, threshold: int) -> DataFrame:
    """``rows`` that can be the smaller set of a pair at their shingle, under the class of their size."""
    return rows.where(f"{mark}ahead * {100 + threshold} >= {2 * threshold} * {mark}n").withColumn("sizes", F.expr(_sizes(f"{mark}n")))


def _as_larger(rows: DataFrame, mark: str, threshold: int) -> DataFrame:
    """``rows`` under each class of sizes that the smaller set of a pair can be of at their shingle."""
    least, most = f"ceil({threshold} * {mark}n / 100.0 - 1e-9)", f"least({mark}n, floor({100 + threshold} * {mark}ahead / {threshold}.0 + 1e-9) - {mark}n)"
    return rows.where(f"{most} >= {least}").withColumn("sizes", F.explode(F.expr(f"sequence({_sizes(least)}, {_sizes(most)})")))


def _resolve_open(members: DataFrame, texts: DataFrame, links: DataFrame, labels: DataFrame, width: int, threshold: int) -> DataFrame:
    """``labels`` after all that the star has left open has been compared.

    The members of buckets that hold several components are joined anew by the prefixes of their sets.  In each key those outside
    its largest component meet the members of other components.  The larger set of a pair is looked for under the sizes that its
    shingle's place leaves for the smaller one; the smaller set stands there only for those shingles that are early enough for a set as large as
    itself.  A pair goes on to be compared if its first common shingle
    leaves room for the overlap in both sets and the parity prints differ in no more bits than the sets may in shingles.
    """
    tried = members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    known = written(_labelled(members.select("key", "node", "n"), labels), "labelled")
    left = written(known.join(_open_keys(known).where("size > 2").select("key"), "key", "left_semi").select("node").distinct(), "open")
    if left.isEmpty():
        return labels
    known = written(_labelled(_prefix_members(left, texts, width, threshold), labels), "prefix-labelled")
    parts = known.groupBy("key", "comp").agg(F.count("*").alias("size"))
    main = parts.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    inside = known.join(written(main, "main"), "key")
    unlike = " + ".join(f"bit_count(bits[{k}] ^ c_bits[{k}])" for k in range(PRINT_WORDS))
    may_link = f"least(ahead, c_ahead) * {100 + threshold} >= {threshold} * (n + c_n) and ({unlike}) * {100 + threshold} <= {100 - threshold} * (n + c_n)"
    met = f"comp <> c_comp and {_fit('n', 'c_n', threshold)} and {may_link}"
    outside = inside.where("comp <> main").select("key", "main", *(F.col(c).alias(f"c_{c}") for c in ("node", "n", "ahead", "bits", "comp")))
    larger = _as_larger(outside, "c_", threshold).join(_as_smaller(inside, "", threshold), ["key", "sizes"]).where(met).select("c_node", "node")
    smaller = _as_smaller(outside, "c_", threshold).join(_as_larger(inside.where("comp = main"), "", threshold), ["key", "sizes"]).where(met).select("c_node", "node")
    pairs = larger.union(smaller).select(F.least("c_node", "node").alias("a"), F.greatest("c_node", "node").alias("b")).distinct()
    fresh = confirmed(written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs"), texts, width, threshold)
    return labels if fresh.isEmpty() else components(links.union(fresh))


def near_duplicates(docs: DataFrame, width: int, threshold: int = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links documents whose sets of ``width``-word shingles have a Jaccard similarity of ``threshold`` per cent or more.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = features(docs, width)
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    reps = written(usable.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "nodes")
    members = _bucket_members(spark, usable, reps)
    involved = written(members.select("node").distinct(), "involved")
    repeated = usable.groupBy("doc_id").agg(F.count_distinct("fingerprint").alias("sets")).where("sets > 1").select(F.col("doc_id").alias("node"))
    texts = docs.select(F.col("doc_id").alias("node"), "text").where("text is not null").join(small(involved, involved.count()), "node", "left_semi")
    texts = written(texts, "texts")
    star = members.where(f"node <> center and {_fit('n', 'center_n', threshold)}").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(star, texts, width, threshold)
    same_id = usable.join(repeated.withColumnRenamed("node", "doc_id"), "doc_id").join(reps, "fingerprint").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = links.union(written(same_id.distinct(), "repeated"))
    labels = components(links)
    labels = _resolve_open(members, texts, links, labels, width, threshold)
    found = written(reps.join(labels, "node", "left").select("fingerprint", F.coalesce("label", "node").alias("component_id")), "classes")
    out = rows.drop("bands").join(found, "fingerprint", "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their own columns, of one document of each group: that of the smallest doc_id.

    Of rows that repeat this doc_id the first stays, by all their columns as JSON.  Rows without a doc_id all stay.
    """
    marked = written(near_duplicates(docs, width, threshold), "marked")
    gone = marked.where("not kept").select("doc_id").distinct()
    kept = docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)
    again = marked.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    row = F.struct(*docs.columns)
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)
