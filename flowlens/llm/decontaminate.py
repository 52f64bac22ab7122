"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index holds the training tokens' postings (term, document, position) of the terms that the test windows
are looked up by: each window's ``PROBES`` rarest terms by corpus frequency.  A window's lists are intersected
from its rarest term on, each shifted by the term's offset in the window; what is left is compared with the
whole window at that place of the document's words.

Rows: a document is its (doc_id, text).  Repeated rows are searched once and each gets the result; a null text
has no words.  Items that repeat an item_id count once.  Empty tables give no hits.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, small_by_bytes, written

WINDOW = 10
PROBES = 3

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_BREAK_PATTERN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The term of the posting after a document's last word; no word can hold its first character.
END = "\x00end"


def words_of(text: Column) -> Column:
    """Lower-cases A-Z; words are runs of digits, letters a-z and characters beyond ASCII."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    return F.array_remove(F.split(plain, " "), "")


def rough_words(text: Column) -> Column:
    """The same words, but beyond ASCII in lower case too: cheaper, and enough to look terms up by."""
    return F.array_remove(F.split(rough_case(F.coalesce(text, F.lit(""))), _BREAK_PATTERN), "")


def rough_case(text: Column) -> Column:
    """Lower case in which a sigma doesn't depend on what follows, so that texts and single words come out alike."""
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def keyed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, words)."""
    return docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), rough_words(F.col("text")).alias("words"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def term_id(term: Column) -> Column:
    """Postings carry a term's 64-bit hash; terms that share one only add places to compare."""
    return F.xxhash64(term)


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window_id, phrase, terms, item_ids): the distinct windows of all items, with the items that have them.

    An item of fewer words than ``window``, but not none, is one window.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    each = items.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at"), F.lit(window)).alias("terms"))
    phrases = each.groupBy(F.array_join("terms", " ").alias("phrase")).agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    return phrases.select(F.xxhash64("phrase").alias("window_id"), "phrase", F.split("phrase", " ").alias("terms"), "item_ids")


def term_counts(words: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, n): how often each of ``terms`` occurs in all documents; 0 for those that don't."""
    tokens = words.select(F.explode("words").alias("word")).select(term_id(F.col("word")).alias("term"))
    seen = tokens.join(small(terms, n_terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def window_terms(windows: DataFrame) -> DataFrame:
    """(window_id, offset, term) for all words of all windows, from offset 0."""
    return windows.select("window_id", F.posexplode("terms").alias("offset", "word")).select("window_id", "offset", term_id(rough_case(F.col("word"))).alias("term"))


def window_probes(windows: DataFrame, counts: DataFrame, probes: int = PROBES) -> DataFrame:
    """(window_id, probe, term, offset): each window's rarest distinct terms, rarest first, with their first offset."""
    placed = window_terms(windows).groupBy("window_id", "term").agg(F.min("offset").alias("offset"))
    order = Window.partitionBy("window_id").orderBy("n", "term")
    return placed.join(counts, "term").withColumn("probe", F.row_number().over(order)).where(F.col("probe") <= probes).select("window_id", "probe", "term", "offset")


def build_index(words: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The positional index of ``terms``: (term, doc_id, text_hash, pos), positions from 0, as a written table.

    Each row of documents has one posting of ``END`` more, at the position after its last word.
    """
    tokens = words.select("doc_id", "text_hash", F.posexplode(F.concat("words", F.array(F.lit(END)))).alias("pos", "word"))
    kept = terms.unionByName(terms.sparkSession.range(1).select(term_id(F.lit(END)).alias("term")))
    postings = tokens.select(term_id(F.col("word")).alias("term"), "doc_id", "text_hash", "pos")
    return written(postings.join(small(kept, n_terms + 1), "term", "left_semi"), "postings")


def look_up(docs: DataFrame, benchmark: DataFrame, window: int, probes: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(windows, probes, index, number of probes): what both kinds of matches read."""
    windows = written(test_windows(benchmark, window), "windows")
    words = keyed_words(docs)
    terms = written(window_terms(windows).select("term").distinct(), "terms")
    probe_rows = written(window_probes(windows, term_counts(words, terms, terms.count()), probes), "probes")
    n_probes = probe_rows.count()
    return windows, probe_rows, build_index(words, probe_rows.select("term").distinct(), n_probes), n_probes


def aligned(index: DataFrame, probes: DataFrame, n_probes: int, depth: int = PROBES) -> DataFrame:
    """(doc_id, text_hash, window_id, start) where the first ``depth`` lists of a window agree on its start.

    The rarest list is read first; every further one only keeps or drops what the lists before have left.
    """
    at = lambda k: small(probes.where(F.col("probe") == k).select("term", "window_id", "offset"), n_probes)
    held = index.join(at(1), "term").select("doc_id", "text_hash", "window_id", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0").distinct()
    for k in range(2, depth + 1):
        need = small(probes.where(F.col("probe") == k).select("window_id", "term", "offset"), n_probes)
        asked = held.join(need, "window_id", "left").withColumn("pos", F.col("start") + F.col("offset"))
        there = index.select("term", "doc_id", "text_hash", "pos", F.lit(True).alias("there")).distinct()
        met = asked.join(there, [asked[c].eqNullSafe(there[c]) if c == "doc_id" else asked[c] == there[c] for c in ("doc_id", "text_hash", "term", "pos")], "left")
        held = met.where(asked["term"].isNull() | F.col("there")).select(asked["doc_id"], asked["text_hash"], asked["window_id"], asked["start"])
    return held


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, probes: int = PROBES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact phrase matches (doc_id, text_hash, window_id, start, length), the windows they name, and the index."""
    windows, probe_rows, index, n_probes = look_up(docs, benchmark, window, probes)
    found = written(aligned(index, probe_rows, n_probes, probes), "aligned")
    asked = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("window_id", "start")).alias("asked"))
    asked = small(asked, found.count())
    texts = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    whole = texts.join(asked, same_document(texts, asked)).select(texts["doc_id"], texts["text_hash"], words_of(F.col("text")).alias("words"), F.explode("asked").alias("a"))
    placed = whole.select("doc_id", "text_hash", "a.window_id", "a.start", F.slice("words", F.col("a.start") + 1, F.lit(window)).alias("there"))
    full = placed.join(small_by_bytes(windows.select("window_id", "terms")), "window_id")
    exact = full.where(F.slice("there", F.lit(1), F.size("terms")) == F.col("terms"))
    # Repeated rows of a document are one document here.
    return exact.select("doc_id", "text_hash", "window_id", "start", F.size("terms").alias("length")).distinct(), windows, index


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 5, window: int = WINDOW, probes: int = PROBES) -> DataFrame:
    """(doc_id, text_hash, window_id, start): windows whose rarest terms all lie within ``slop`` words of their places.

    The places count from the rarest term's.  These are leads for review; they don't mark a document by themselves.
    """
    _, probe_rows, index, n_probes = look_up(docs, benchmark, window, probes)
    first = small(probe_rows.where("probe = 1").select("term", "window_id", "offset"), n_probes)
    held = index.join(first, "term").select("doc_id", "text_hash", "window_id", (F.col("pos") - F.col("offset")).alias("start")).distinct()
    for k in range(2, probes + 1):
        need = small(probe_rows.where(F.col("probe") == k).select("window_id", F.col("term").alias("next_term"), "offset"), n_probes)
        asked = held.join(need, "window_id", "left").withColumn("near", F.explode(F.sequence(F.col("start") + F.coalesce("offset", F.lit(0)) - slop, F.col("start") + F.coalesce("offset", F.lit(0)) + slop)))
        there = index.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("pos").alias("p")).distinct().withColumn("there", F.lit(True))
        met = asked.join(there, asked["doc_id"].eqNullSafe(there["d"]) & (asked["text_hash"] == there["h"]) & (asked["next_term"] == there["t"]) & (asked["near"] == there["p"]), "left")
        held = met.where(F.col("next_term").isNull() | F.col("there")).select("doc_id", "text_hash", "window_id", "start").distinct()
    return held


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, probes: int = PROBES) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_hash, n_words, n_hit, item_ids (sorted), contaminated.

    Items without an id mark documents like any other, but aren't in ``item_ids``.
    """
    exact, windows, index = phrase_matches(docs, benchmark, window, probes)
    exact = written(exact, "matches")
    hit = exact.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("runs"))
    places = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    hit = hit.select("doc_id", "text_hash", F.size(F.array_distinct(places)).cast("long").alias("n_hit"))
    items = exact.join(windows.select("window_id", F.explode_outer("item_ids").alias("item_id")), "window_id").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    found = hit.join(items, same_document(hit, items)).select(hit["doc_id"], hit["text_hash"], "n_hit", "item_ids")
    sizes = index.where(F.col("term") == term_id(F.lit(END))).select("doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    joined = sizes.join(found, same_document(sizes, found), "left").select(sizes["doc_id"], sizes["text_hash"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return joined.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, probes: int = PROBES) -> DataFrame:
    """The rows of ``docs``, with their own columns, that hold no test window."""
    exact, _, _ = phrase_matches(docs, benchmark, window, probes)
    bad = written(exact.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct(), "contaminated")
    bad = small(bad, bad.count())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (text_hash(docs["text"]) == bad["_bad_hash"]), "left_anti")
