"""Fill-in-the-middle documents, cut at line boundaries that a learned index finds.

A text is cut into lines (each with its line feed; offsets count code points).  Boundary k is the offset at which line k begins; the last one is the
text's end.  A document's boundaries are indexed by line segments over (k, offset), each no further than ``ERROR`` code points from any of
its boundaries, fitted from left to right in one pass; what a segment misses a boundary by is stored as a residual of one byte.
A cut finds its segment, predicts the offset and adds the residual, which gives the boundary exactly.  A line longer than the
bound breaks a segment or bends it; a segment of one boundary is always within the bound, so that every text can be indexed.

Which lines are prefix, middle and suffix, and the order they are written in, is drawn from a hash of the seed and doc_id: reruns agree.
A null doc_id is drawn as an empty one.  Null and empty texts, and texts that hold one of the markers, stay plain.  Rows that
repeat a document are each given the same result.  Other columns are left out.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that a segment may be away from a boundary: residuals take one byte.
ERROR = 100
#: Boundaries that a segment is first tried on; each further try takes twice as many.
FIRST_LOOK = 64

SCHEMA = "doc_id long, n long, form string, prefix string, middle string, suffix string, output string, n_segments long, residual_bytes long"


def line_boundaries(text: str) -> np.ndarray:
    """0 and the offset behind each line, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    if len(points) and (not len(ends) or ends[-1] != len(points)):
        ends = np.append(ends, len(points))
    return np.concatenate([[0], ends]).astype(np.int64)


class RankIndex:
    """Boundary offsets by number: segments (first number, offset there, slope) and a residual of one byte for each boundary."""

    def __init__(self, boundaries: np.ndarray, error: int = ERROR):
        firsts, slopes, at, n = [], [], 0, len(boundaries)
        while at < n:
            end, slope = self._longest(boundaries, at, error)
            firsts.append(at)
            slopes.append(slope)
            at = end
        self.firsts = np.array(firsts, np.int64)
        self.offsets = boundaries[self.firsts]
        self.slopes = np.array(slopes, np.float64)
        self.n = n
        self.residuals = (boundaries - self._predicted(np.arange(n))).astype(np.int8)

    @staticmethod
    def _longest(boundaries: np.ndarray, at: int, error: int) -> tuple[int, float]:
        """The end of the longest segment from ``at`` on, and a slope within the cone that all its boundaries leave open."""
        low, high, done, look = -np.inf, np.inf, at + 1, FIRST_LOOK
        while done < len(boundaries):
            some = np.arange(done, min(done + look, len(boundaries)))
            rise, run = boundaries[some] - boundaries[at], some - at
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            closed = np.flatnonzero(lows > highs)
            good = closed[0] if len(closed) else len(some)
            if good:
                low, high = lows[good - 1], highs[good - 1]
            done += good
            if good < len(some):
                break
            look *= 2
        return int(done), float((low + high) / 2) if done > at + 1 else 0.0

    def _predicted(self, k: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.firsts, k, side="right") - 1
        return self.offsets[segment] + np.rint(self.slopes[segment] * (k - self.firsts[segment])).astype(np.int64)

    def offset(self, k: int) -> int:
        """Boundary ``k``, exactly."""
        return int(self._predicted(np.array([k]))[0]) + int(self.residuals[k])


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transformed(doc_id: int | None, text: str | None, seed: int, share: int, spm_share: int) -> tuple:
    """n, form, prefix, middle, suffix, output, segments and bytes of residuals of one document."""
    text = text or ""
    index = RankIndex(line_boundaries(text))
    n = index.n - 1
    h1, h2, h3, h4 = _draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= share:
        return n, "plain", None, None, None, text, len(index.firsts), index.n
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = index.offset(first), index.offset(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_share:
        return n, "spm", prefix, middle, suffix, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", len(index.firsts), index.n
    return n, "psm", prefix, middle, suffix, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", len(index.firsts), index.n


def fill_in_middle(docs: DataFrame, seed: int = 7, share: int = 100, spm_share: int = 50) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n (lines), form, prefix, middle, suffix, output, n_segments, residual_bytes.

    form: "plain" (output is the text; no parts), "psm" or "spm" (suffix first); ``share`` per cent of the documents are cut, ``spm_share`` per cent of these suffix first.
    """
    small_batches(docs.sparkSession, 250)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            found = [transformed(d, t, seed, share, spm_share) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*found, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  No marker is in it, so that each marker in the output is the operator's own."""
    upto = lambda mark: F.substring_index(output, mark, 1)
    after = lambda mark: F.substring_index(output, mark, -1)
    psm = F.concat(F.replace(upto(SUFFIX), F.lit(PREFIX), F.lit("")), after(MIDDLE), F.substring_index(F.substring_index(output, SUFFIX, -1), MIDDLE, 1))
    spm = F.concat(F.substring_index(F.substring_index(output, PREFIX, -1), MIDDLE, 1), after(MIDDLE), F.replace(upto(PREFIX), F.lit(SUFFIX), F.lit("")))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines FROM documents
), drawn AS (
  SELECT *, len(lines)::BIGINT AS n, ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2, ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM d
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m, array_to_string(lines[b + 1:], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
