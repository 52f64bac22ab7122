"""Token-id output as directly addressable codes.

An id is cut into chunks of ``LEVEL_BYTES`` bytes, lowest first.  Level k holds the k-th chunk of every
id that has one, in order, and a bitmap that says which of them go on in level k + 1.  A rank directory
(ones before each block of ``RANK_BITS`` bits) leads from an id's place in one level to its place in the
next, so any single id is read with one chunk and one popcount a level; no block is decoded.

The store is a Parquet table of segments.  A segment holds whole documents in ascending doc_id order and
is addressable by itself; ``part`` and ``seq`` give the segments' order.  Null doc_ids sort first.  A null
or empty text is stored as the end id alone.  Rows that repeat a doc_id (or have none) are stored one after the other, by their
texts' hashes; a doc_id of many rows spreads over many tasks.  Other columns are left out.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, remembered, scratch_path, small_batches

LEVEL_BYTES = (1, 1, 2)
RANK_BITS = 512
MAGIC = b"DAC1"
#: Ids after which a segment is closed; a document is never split.
SEGMENT_IDS = 1 << 18
#: Bytes of words and their ids that a Python worker remembers, from task to task.
CACHE_BYTES = 160 << 20

SEGMENT_SCHEMA = "part int, seq int, n_docs int, n_tokens long, doc_ids array<long>, lengths array<int>, payload binary"
DOC_SCHEMA = "part int, seq int, doc_id long, rel_start long, n_tokens long, ids_crc32 long"


def dac_encode(ids: np.ndarray, level_bytes: tuple[int, ...] = LEVEL_BYTES) -> bytes:
    """One segment's bytes: header, then chunks, bitmap and rank directory of each level."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32).astype(np.uint64)
    out = [MAGIC, struct.pack("<BI", len(level_bytes), len(rest))]
    for k, width in enumerate(level_bytes):
        chunk = (rest & ((1 << 8 * width) - 1)).astype(f"<u{width}")
        rest >>= np.uint64(8 * width)
        more = rest > 0
        if k == len(level_bytes) - 1:
            if more.any():
                raise ValueError("an id is too large for the chunk levels")
            bitmap, ranks = b"", b""
        else:
            bits = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
            bitmap, ranks = bits.tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes()
        out += [struct.pack("<BIII", width, len(chunk), len(bitmap), len(ranks)), chunk.tobytes(), bitmap, ranks]
        rest = rest[more]
    return b"".join(out)


class DacReader:
    """Reads a segment's bytes: ``reader[i]`` for any single id, ``all()`` for the whole of them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        n_levels, self.n = struct.unpack_from("<BI", data, 4)
        at, self.levels = 9, []
        for _ in range(n_levels):
            width, count, n_bits, n_ranks = struct.unpack_from("<BIII", data, at)
            at += 13
            chunks = np.frombuffer(data, f"<u{width}", count, at)
            at += count * width
            bitmap = np.frombuffer(data, np.uint8, n_bits, at)
            at += n_bits
            ranks = np.frombuffer(data, "<u4", n_ranks // 4, at)
            at += n_ranks
            self.levels.append((width, chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for width, chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += 8 * width
            if not len(bitmap) or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            head = int.from_bytes(bitmap[block * RANK_BITS // 8 : i // 8 + 1].tobytes(), "little")
            i = int(ranks[block]) + (head & ((1 << (i - block * RANK_BITS)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        value, at, shift = np.zeros(self.n, np.uint32), slice(None), 0
        for width, chunks, bitmap, _ in self.levels:
            value[at] |= chunks.astype(np.uint32) << np.uint32(shift)
            shift += 8 * width
            if len(bitmap):
                more = np.flatnonzero(np.unpackbits(bitmap, count=len(chunks), bitorder="little"))
                at = more if isinstance(at, slice) else at[more]
        return value


# The tokenizer file's rules under which a text's ids are those of its words, one after the other.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Marks (no apostrophe), letters, marks: three pieces at most.  The letters are those below U+0250, without the one whose lower case is no letter.
SIMPLE = re.compile(r"""([!-&(-/:-@\[-`{-~]*)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-/:-@\[-`{-~]*)""")


def _byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary shows a byte as, where it isn't the byte's own."""
    odd = [*range(33), 127, *range(128, 161), 173]
    return {b: chr(256 + k) for k, b in enumerate(odd)}


class WordEncoder:
    """Ids of whole texts through a remembered table of words.

    Only if the file's rules are those above: these neither merge across white space nor keep it.  A word is what lies between spaces and
    line feeds.  The pieces of a simple word go to the tokenizer's model by themselves, any other word goes to the tokenizer.  With
    other rules whole texts go to it.
    """

    def __init__(self, tokenizer_file: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        rules = json.loads(self.tokenizer.to_str())
        added = rules["added_tokens"]
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or len(x["content"].split()) != 1 or "<" not in x["content"] for x in added)
        model = rules["model"]
        self.by_words = plain and rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER and model["type"] == "BPE" and not model.get("dropout")
        self.added, self.model, self.characters = tuple(x["content"] for x in added), self.tokenizer.model, _byte_characters()
        self.owner, self.cache_bytes = f"token_store {tokenizer_file}", cache_bytes

    @classmethod
    @functools.cache
    def of(cls, tokenizer_file: str, cache_bytes: int) -> WordEncoder:
        """The one of this Python worker."""
        return cls(tokenizer_file, cache_bytes)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, piece: str, known: Remembered) -> bytes:
        """The ids of letters or marks alone, which are one piece; a word of the same characters has the same ids."""
        if (ids := known.get(piece)) is not None:
            return ids
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.characters)
        return array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()

    def learn(self, words: set[str], known: Remembered) -> None:
        other, marks = [], set()
        for word in words:
            m = SIMPLE.fullmatch(word)
            if m is None or ("<" in word and any(x in word for x in self.added)):
                other.append(word)
                continue
            head, core, tail = m.groups()
            ids = self.piece(core.lower(), known)
            for some in (head, tail):
                if some and some not in known:
                    known[some] = self.piece(some, known)
                    marks.add(some)
            known[word] = known[head] + ids + known[tail]
        for i in range(0, len(other), 20_000):
            known.update(zip(other[i : i + 20_000], self.whole(other[i : i + 20_000]), strict=True))
        known.learned(words | marks)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return self.whole(texts)
        split = [x.replace("\n", " ").split(" ") for x in texts]
        known = remembered(self.owner, self.cache_bytes)
        known.make_room()
        known[""] = b""
        if fresh := {w for words in split for w in words if w not in known}:
            self.learn(fresh, known)
        return [b"".join([known[w] for w in words]) for words in split]


def segment_writer(tokenizer_file: str, end_id: int, segment_ids: int = SEGMENT_IDS, cache_bytes: int = CACHE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc_id, text) in doc_id order: segments of directly addressable codes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = WordEncoder.of(tokenizer_file, cache_bytes), np.array([end_id], "<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        n = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [[part], [seq], [len(held)], [len(ids)], [doc_ids], [[len(x) // 4 for x in held]], [dac_encode(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["part", "seq", "n_docs", "n_tokens", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                encoded = encoder.encode([x or "" for x in some.column(1).to_pylist()])
                for doc_id, ids in zip(some.column(0).to_pylist(), encoded, strict=True):
                    doc_ids.append(doc_id)
                    held.append(ids + end)
                    n += len(ids) // 4 + 1
                    if n >= segment_ids:
                        yield close()
                        doc_ids, held, n, seq = [], [], 0, seq + 1
        if held:
            yield close()

    return write


def write_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, cache_bytes: int = CACHE_BYTES) -> None:
    """Encodes ``docs`` (doc_id, text; other columns are left out) into the segment table at ``path``."""
    order = ("doc_id", "text_hash", "place")  # the place only parts equal rows
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    small_batches(docs.sparkSession)
    ordered.mapInArrow(segment_writer(tokenizer_file, end_id, cache_bytes=cache_bytes), SEGMENT_SCHEMA).write.parquet(path)


def read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over segments: a row for each document, decoded from the codes."""
    for batch in batches:
        for row in range(batch.num_rows):
            x = {k: batch.column(k)[row] for k in ("part", "seq", "doc_ids", "lengths", "payload")}
            ids, lengths = DacReader(x["payload"].as_py()).all(), np.array(x["lengths"].values, np.int64)
            ends = np.cumsum(lengths)
            data, starts = memoryview(ids.astype("<u4").tobytes()), ends - lengths
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["part"].as_py()] * n, pa.int32()), pa.array([x["seq"].as_py()] * n, pa.int32()), x["doc_ids"].values, pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())],
                names=["part", "seq", "doc_id", "rel_start", "n_tokens", "ids_crc32"],
            )


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, seq, seg_start): ids before each segment; one task sees the parts' totals only, never segments."""
    sizes = segments.select("part", "seq", "n_tokens")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return sizes.withColumn("in_part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("seg_start"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A row for each stored document: doc_id, start, n_tokens, ids_crc32, all from the files at ``path``."""
    segments = spark.read.parquet(path)
    docs = segments.mapInArrow(read_documents, DOC_SCHEMA)
    return docs.join(segment_starts(segments), ["part", "seq"]).select("doc_id", (F.col("seg_start") + F.col("rel_start")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at one global ``position``: finds its segment by the segments' sizes, then reads one code of its payload."""
    segments = spark.read.parquet(path)
    at = segment_starts(segments).where(F.col("seg_start") <= position).orderBy(F.desc("seg_start"), F.desc("part"), F.desc("seq")).first()
    if at is None or position < 0:
        raise IndexError(position)
    # Each file is of one part: all others are skipped by their statistics.
    row = segments.where((F.col("part") == at["part"]) & (F.col("seq") == at["seq"])).select("payload").first()
    return DacReader(bytes(row["payload"]))[position - at["seg_start"]]


def token_output(docs: DataFrame, tokenizer_file: str, end_id: int = 2, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Writes ``docs`` to a new store in the shared folder and returns its documents as read back.

    An empty table gives an empty store and no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_store(docs, path, tokenizer_file, end_id, cache_bytes)
    return read_store(spark, path)
