"""Word-piece counts by a linear longest-match automaton.

Greedy longest-match-first word pieces of a word are counted in one pass over its bytes.  The vocabulary is a trie with two
roots, one for pieces that begin a word and one for pieces that go on in it (with ``prefix`` in front, or the
same pieces if the vocabulary marks none).  Where the vocabulary marks word ends, the end is one more symbol (``END``) after the bytes of
the pieces that have the mark and of each word, so that such a piece fits at a word's end only and a piece without the
mark not there.  A node's failure link leads to the node of what is left after the
longest-match pieces of the node's string are taken off its front; their number is kept with the link.  Counting a word
adds these numbers up; no piece is ever built.

Words of a whole batch go through the automaton together, byte by byte (numpy); a Python worker remembers words from task to
task.  A word that the vocabulary can't cover counts as one unknown piece.  Null and blank texts have 0 pieces.  Each row is
counted by itself, whatever its doc_id; other columns are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, small_batches

#: Bytes of words and their counts that a Python worker remembers.
CACHE_BYTES = 160 << 20
#: The symbol of a word's end, beyond all bytes, and how many symbols there are.
END, SYMBOLS = 256, 257
_NONE = -1


def _ended(first: set[tuple[int, ...]], inside: set[tuple[int, ...]]) -> dict[tuple[int, ...], int]:
    """How many pieces a word's rest takes that is a piece of ``first`` without the mark, by the rest with ``END``.

    Such a piece doesn't fit there, so that the longest that does is a shorter one, and others after it.
    """
    found = {}
    for rest in first:
        if rest[-1] == END or (*rest, END) in first:
            continue
        word, at, n, pieces = (*rest, END), 0, 0, first
        while at < len(word):
            fit = next((e for e in range(len(word), at, -1) if e != len(word) - 1 and word[at:e] in pieces), None)
            if fit is None:
                break
            at, n, pieces = fit, n + 1, inside
        if at == len(word):
            found[word] = n
    return found


class PieceCounter:
    """The automaton of a vocabulary of strings of symbols; with ``marked``, each word is followed by ``END``."""

    def __init__(self, begin: set[bytes] | set[tuple[int, ...]], inside: set[bytes] | set[tuple[int, ...]], marked: bool = False):
        self.marked = marked
        weights = [_ended(begin, inside), _ended(inside, inside)] if marked else [{}, {}]
        roots = {0: begin | weights[0].keys(), 1: inside | weights[1].keys()}
        next_: list[dict[int, int]] = [{}, {}]
        ends = [0, 0]
        parents: list[tuple[int, int]] = [(_NONE, 0), (_NONE, 0)]
        for root, pieces in roots.items():
            for piece in sorted(pieces):
                at = root
                for byte in piece:
                    if byte not in next_[at]:
                        next_[at][byte] = len(next_)
                        next_.append({})
                        ends.append(0)
                        parents.append((at, byte))
                    at = next_[at][byte]
                ends[at] = weights[root].get(piece, 1) if at > 1 else 0
        fail, pops = [_NONE] * len(next_), [0] * len(next_)
        level = [x for root in (0, 1) for x in next_[root].values()]
        while level:  # parents before children
            for node in level:
                if ends[node]:
                    fail[node], pops[node] = 1, ends[node]
                else:
                    up, byte = parents[node]
                    at, popped = fail[up], pops[up]
                    while at != _NONE and byte not in next_[at]:
                        at, popped = fail[at], popped + pops[at]
                    if at != _NONE:
                        fail[node], pops[node] = next_[at][byte], popped
            level = [x for node in level for x in next_[node].values()]
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        pairs = sorted((node * SYMBOLS + byte, child) for node, children in enumerate(next_) for byte, child in children.items())
        self.keys, self.children = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64))

    def step(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The child of each node, or -1."""
        key = nodes * SYMBOLS + data
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.children[at], _NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; 1 for a word that can't be covered, 0 for an empty one."""
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if self.marked:  # an empty word stays empty
            ends = (starts + lengths)[lengths > 0]
            data, lengths = np.insert(data, ends, END), lengths + (lengths > 0)
            starts = np.cumsum(lengths) - lengths
        state, out = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max()) if len(words) else 0
        fall = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # how many words are longer than k
        for k in range(longest):
            live = order[: fall[k]]
            live = live[state[live] != _NONE]
            byte = data[starts[live] + k]
            while len(live):
                child = self.step(state[live], byte)
                hit = child != _NONE
                state[live[hit]] = child[hit]
                live, byte = live[~hit], byte[~hit]
                out[live] += self.pops[state[live]]
                state[live] = self.fail[state[live]]
                there = state[live] != _NONE
                live, byte = live[there], byte[there]
        live = np.flatnonzero((state != _NONE) & (lengths > 0))
        while len(live := live[(state[live] != 1) & (state[live] != _NONE)]):
            out[live] += self.pops[state[live]]
            state[live] = self.fail[state[live]]
        return np.where(lengths == 0, 0, np.where(state == _NONE, 1, out))


def marked_vocabulary(tokenizer_file: str, end: str = "</w>") -> set[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary file as symbols: their bytes, and ``END`` for the word-end mark."""
    from tokenizers import Tokenizer

    of, pieces = _byte_of(), Tokenizer.from_file(tokenizer_file).get_vocab(with_added_tokens=False)
    split = ((piece.removesuffix(end), piece.endswith(end)) for piece in pieces)
    return {(*(of[c] for c in piece), *[END] * marked) for piece, marked in split if piece and set(piece) <= of.keys()}


def _byte_of() -> dict[str, int]:
    """The byte of each character that a byte-level vocabulary shows bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


def word_end_vocabulary(tokenizer_file: str, end: str = "</w>") -> set[bytes]:
    """The pieces of a byte-level vocabulary file, as bytes, without their word-end marks."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    shown = set(ByteLevel.alphabet())
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    pieces = (piece.removesuffix(end) for piece in Tokenizer.from_file(tokenizer_file).get_vocab(with_added_tokens=False))
    return {bytes(of[c] for c in piece) for piece in pieces if piece and set(piece) <= shown}


@functools.cache
def _counter(tokenizer_file: str) -> PieceCounter:
    """The one of this Python worker."""
    pieces = marked_vocabulary(tokenizer_file)
    return PieceCounter(pieces, pieces, any(p[-1] == END for p in pieces))


def piece_counts(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, n_words, n_pieces): words between ASCII white space in lower case A-Z, and their greedy word pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = _counter(tokenizer_file), remembered(f"piece_counts {tokenizer_file}", CACHE_BYTES)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                split = [(x or "").encode("utf-8", "surrogatepass").lower().split() for x in some.column(1).to_pylist()]
                known.make_room()
                fresh = list({w for words in split for w in words if w not in known})
                if fresh:
                    known.update(zip(fresh, counter.counts(fresh).tolist(), strict=True))
                    known.learned(fresh)
                sums = [sum([known[w] for w in words]) for words in split]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(w) for w in split], pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "n_words", "n_pieces"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_pieces long")
