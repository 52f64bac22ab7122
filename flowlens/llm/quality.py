"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word of a text stands for two terms, its letters in lower case and its shape (case, digits and
marks, runs collapsed; one shape of its own for a word that repeats the one before), both dealt by hash to a fixed number of terms.  Each term has a fixed sparse random index
vector; a term's word vector is the sum, over the whole corpus, of the index vectors around its occurrences:
the neighbouring words' terms and the word's shape.  Sums are of integers, so they don't depend on the order
of tasks.  A document is the mean of its words' letter vectors, rarer ones weighing more, and the mean of its
shape vectors.

The network (numpy, on the driver) is fitted on the pooled vectors of at most ``TRAIN_ROWS`` labelled documents,
those of the smallest hash of doc_id.  A part of these is held back to fit the temperature that its
probabilities are calibrated with.  Only the text is an input of a score.

Null and blank texts get the score of the zero vector.  Rows that repeat a doc_id are scored each by its own text;
labels that repeat a doc_id count as often as they occur.  With no labels of one of the two classes, every score is the
share of label 1 (0.5 without any).  Other columns are left out, or kept by ``keep_good``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remembered, small_batches

LETTER_TERMS, SHAPE_TERMS, DIMENSIONS, NONZERO = 7168, 1024, 32, 2
TERMS = LETTER_TERMS + SHAPE_TERMS
#: The shape term of a word that is the same as the one before it.
REPEATED = TERMS - 1
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH = 32, 30, 256
KEEP_AT = 0.7
SEED = 11


class _Shape(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


class Terms:
    """Terms of words: letter term and shape term of each word of a text.  A Python worker remembers words from task to task."""

    def __init__(self) -> None:
        self.known = remembered("quality", 48 << 20)
        self.shapes, self.runs, self.marks = _Shape(), re.compile(r"(.)\1+", re.S), re.compile(r"[\W_]+")

    def learn(self, word: str) -> int:
        shape = self.runs.sub(r"\1", word.translate(self.shapes))
        letters = self.marks.sub("", word).lower()
        return (zlib.crc32(letters.encode("utf-8", "replace")) % LETTER_TERMS) * TERMS + LETTER_TERMS + zlib.crc32(shape.encode("utf-8", "replace")) % (SHAPE_TERMS - 1)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        known, words = self.known, (text or "").split()
        try:
            codes = np.array([known[w] for w in words], np.int64)
        except KeyError:
            known.make_room()
            fresh = {w for w in words if w not in known}
            known.update((w, self.learn(w)) for w in fresh)
            known.learned(fresh)
            codes = np.array([known[w] for w in words], np.int64)
        shapes = codes % TERMS
        shapes[1:][codes[1:] == codes[:-1]] = REPEATED
        return codes // TERMS, shapes


def index_vectors(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), each TERMS x NONZERO: the fixed sparse random vectors."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((TERMS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice(np.array([-1, 1], np.int64), (TERMS, NONZERO))


def _sum_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, (places, signs) = Terms(), index_vectors()
    sums, counts = np.zeros(TERMS * DIMENSIONS, np.int64), np.zeros(TERMS, np.int64)

    def add(of: np.ndarray, around: np.ndarray) -> None:
        for k in range(NONZERO):
            at, sign = of * DIMENSIONS + places[around, k], signs[around, k]
            up = sign > 0
            sums[:] += np.bincount(at[up], minlength=len(sums)) - np.bincount(at[~up], minlength=len(sums))

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if not held:
            return
        letters, shapes = (np.concatenate(x) for x in zip(*held, strict=True))
        ends = np.cumsum([len(x) for x, _ in held])
        inner = np.ones(max(len(letters) - 1, 0), bool)  # pairs of neighbours within a document
        inner[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(letters))] - 1] = False
        a, b = np.flatnonzero(inner), np.flatnonzero(inner) + 1
        add(np.concatenate([letters[a], letters[b], letters]), np.concatenate([letters[b], letters[a], shapes]))
        add(np.concatenate([shapes[a], shapes[b], shapes]), np.concatenate([shapes[b], shapes[a], shapes]))
        counts[:] += np.bincount(letters, minlength=TERMS) + np.bincount(shapes, minlength=TERMS)

    for batch in batches:
        held, n = [], 0
        for text in batch.column(0).to_pylist():
            held.append(terms(text))
            n += len(held[-1][0])
            if n > 400_000:
                flush(held)
                held, n = [], 0
        flush(held)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen]), *(pa.array(x[seen]) for x in sums.reshape(TERMS, DIMENSIONS).T)], names=["term", "n", *(f"d{k}" for k in range(DIMENSIONS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """TERMS x (DIMENSIONS + 1): word vectors of unit length, and each term's weight in a document's mean."""
    schema = ", ".join(["term long", "n long", *(f"d{k} long" for k in range(DIMENSIONS))])
    partial = docs.select("text").mapInArrow(_sum_contexts, schema)
    total = partial.groupBy("term").agg(*(F.sum(c).alias(c) for c in partial.columns[1:])).toPandas()  # TERMS rows at most
    out = np.zeros((TERMS, DIMENSIONS + 1), np.float32)
    if len(total):
        vectors = total.iloc[:, 2:].to_numpy(np.float64)
        at, n = total["term"].to_numpy(), total["n"].to_numpy(np.float64)
        out[at, :-1] = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        out[at, -1] = np.where(at < LETTER_TERMS, 1e-3 / (1e-3 + n / max(n[at < LETTER_TERMS].sum(), 1)), 1.0)
    return out


def pooled(texts: list[str | None], terms: Terms, vectors: np.ndarray) -> np.ndarray:
    """A row of 2 * DIMENSIONS for each text."""
    out = np.zeros((len(texts), 2 * DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        letters, shapes = terms(text)
        for k, of in enumerate((letters, shapes) if len(letters) else ()):
            n = np.bincount(of - k * LETTER_TERMS, minlength=(LETTER_TERMS, SHAPE_TERMS)[k])
            used = np.flatnonzero(n)
            rows = vectors[used + k * LETTER_TERMS]
            weight = rows[:, -1] * n[used]
            out[i, k * DIMENSIONS : (k + 1) * DIMENSIONS] = weight @ rows[:, :-1] / weight.sum()
    return out


class Network:
    """Two layers; probabilities at a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        self.share, self.layers, self.temperature = float(y.mean()) if len(y) else 0.5, None, 1.0
        if len(np.unique(y)) < 2:
            return
        rng = np.random.default_rng(seed)
        deal = rng.permutation(len(y))
        cut = max(1, len(y) // 5)
        rest = deal[cut:] if len(np.unique(y[deal[cut:]])) == 2 else deal
        self.mean, self.scale = x[rest].mean(axis=0), x[rest].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        self.layers = layers
        moments, step = [[np.zeros_like(w), np.zeros_like(w)] for w in layers], 0
        epochs = max(EPOCHS, 20_000 // max(len(rest), 1))
        for _ in range(min(epochs, 300)):
            for at in np.array_split(rng.permutation(rest), max(1, len(rest) // BATCH)):
                hidden = np.maximum(z[at] @ layers[0] + layers[1], 0)
                error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -40, 40))) - y[at]) / len(at)
                back = np.outer(error, layers[2]) * (hidden > 0)
                step += 1
                for w, g, m in zip(layers, (z[at].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)), moments, strict=True):
                    g = g + 1e-4 * w
                    m[0][:], m[1][:] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                    w -= 0.004 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        logits, truth = self.logits(x[deal[:cut]]), y[deal[:cut]]
        loss = lambda t: np.mean(np.logaddexp(0, logits / t) - truth * logits / t)
        self.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.layers
        return np.maximum((x - self.mean) / self.scale @ w[0] + w[1], 0) @ w[2] + w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Word vectors over all of ``docs`` and a network fitted on ``labels`` (doc_id, quality) outside the held-out part."""

    def __init__(self, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
        small_batches(docs.sparkSession)
        self.vectors = vectors = word_vectors(docs)
        usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
        some = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)

        def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = Terms()
            for batch in batches:
                rows = pooled(batch.column(2).to_pylist(), terms, vectors)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(rows), pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

        rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text").mapInArrow(pool, "doc_id long, quality int, x array<float>")
        # Rows that repeat a doc_id could exceed the bound that ``some`` has.
        got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(2 * train_rows).toPandas()
        x = np.array(got["x"].tolist(), np.float64).reshape(len(got), 2 * DIMENSIONS)
        self.network = Network(x, got["quality"].to_numpy(np.float64))

    def scorer(self):
        """A function from texts to scores, for tasks."""
        vectors, network, terms = self.vectors, self.network, []

        def score(texts: list[str | None]) -> np.ndarray:
            if not terms:
                terms.append(Terms())
            return network(pooled(texts, terms[0], vectors).astype(np.float64))

        return score


def scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""
    score = Model(docs, labels, train_rows).scorer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, at: float = KEEP_AT, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``at`` or more."""
    score, place = Model(docs, labels, train_rows).scorer(), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(place).to_pylist()) >= at))

    return docs.mapInArrow(run, docs.schema)
