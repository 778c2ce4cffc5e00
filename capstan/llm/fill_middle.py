"""Fill-in-the-middle: texts cut at two token boundaries and put in another order.

A token is a word with the white space before it, or white space at the end of a
text.  The byte offsets of all token boundaries of a text are kept as a learned rank
index: straight segments, each grown from its first boundary as long as one slope
foresees every offset within ``ERROR`` bytes, and one byte a boundary for what the
segment is off by.  A cut of a rank is foreseen by its segment and corrected by the
stored residual, which gives the exact offset; the text is not read again, and other
draws can use the same index.

The draws come from sha256 of seed and doc_id, so reruns agree.

Edge cases: a null text counts as empty; an empty text has no token and stays
plain; a text that holds one of the marks stays plain, so that every output can be
undone; a null doc_id draws as the empty string; rows of equal id draw alike; an
empty table gives an empty result.  Texts of any length are cut whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_portions, text_of

#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and percent of those in suffix-first order.
CUT_PCT, SUFFIX_FIRST_PCT = 50, 80
#: Bytes that a segment may be off by; with rounding a residual fits one byte.
ERROR = 126
#: Boundaries looked at in one step while a segment grows.
STEP = 2048

INDEX = "seg_rank array<long>, seg_offset array<long>, seg_slope array<double>, residuals binary"


def boundaries(data: bytes) -> np.ndarray:
    """Byte offset after each number of tokens: 0, then the end of every token."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(1, np.int64)
    space = (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))
    last = ~space
    last[:-1] &= space[1:]
    last[-1] = True  # the end of the text ends its last word or its trailing white space
    return np.concatenate(([0], np.flatnonzero(last) + 1))


def fit_segments(y: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First ranks, their offsets, slopes and residuals of the segments.

    A segment's slopes that keep all its boundaries within ``error`` are an interval
    that narrows with every boundary; the segment ends before the boundary that would
    make it empty."""
    ranks, slopes, s, n = [], [], 0, len(y)
    while s < n:
        low, high, at = -np.inf, np.inf, s + 1
        while at < n:
            rise, run = y[at:at + STEP] - y[s], np.arange(at - s, min(at + STEP, n) - s)
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            fits = lows <= highs
            k = len(fits) if fits.all() else int(np.argmin(fits))
            if k:
                low, high = lows[k - 1], highs[k - 1]
            at += k
            if k < len(fits):
                break
        ranks.append(s)
        slopes.append((low + high) / 2 if at > s + 1 else 0.0)
        s = at
    ranks, slopes = np.array(ranks, np.int64), np.array(slopes)
    offsets = y[ranks]
    return ranks, offsets, slopes, (y - foreseen(ranks, offsets, slopes, np.arange(n))).astype(np.int8)


def foreseen(ranks: np.ndarray, offsets: np.ndarray, slopes: np.ndarray, rank) -> np.ndarray:
    """Offsets of ``rank`` by the segments alone."""
    j = np.searchsorted(ranks, rank, side="right") - 1
    return offsets[j] + np.rint(slopes[j] * (rank - ranks[j])).astype(np.int64)


def offset_of(index: tuple, rank: int) -> int:
    """Exact byte offset after ``rank`` tokens."""
    ranks, offsets, slopes, residuals = index
    return int(foreseen(ranks, offsets, slopes, rank)) + int(residuals[rank])


def with_index(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """doc_id, ``text`` (null as empty) and the rank index of its token boundaries;
    ``error`` is at most 126 bytes."""
    if not 0 <= error <= ERROR:
        raise ValueError(f"error must be between 0 and {ERROR}")

    def run(batches):
        for b in byte_portions(batches, "text"):
            got = [fit_segments(boundaries(t), error) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("text"), pa.array([g[0] for g in got], pa.list_(pa.int64())),
                pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64())),
                pa.array([g[3].tobytes() for g in got], pa.binary())],
                ["doc_id", "text", "seg_rank", "seg_offset", "seg_slope", "residuals"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {id_type}, text string, {INDEX}")


def draws(seed: int, doc_id) -> list[int]:
    """Four 32-bit draws of a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k:8 * k + 8], 16) for k in range(4)]


def transform(indexed: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, ``n`` tokens, ``form`` (plain, psm, spm), ``prefix_chars``,
    ``middle_chars`` (code points; null if plain) and ``output`` of indexed texts."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def chars(part: bytes) -> int:
        return int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))

    def of(doc_id, text: bytes, index: tuple):
        n = len(index[3]) - 1
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not text or h3 % 100 >= CUT_PCT or any(m in text for m in marks):
            return n, "plain", None, None, text
        a, b = (offset_of(index, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        head, mid, tail = text[:a], text[a:b], text[b:]
        p, s, m = marks
        form, out = ("spm", s + tail + p + head + m + mid) if h4 % 100 < SUFFIX_FIRST_PCT else ("psm", p + head + s + tail + m + mid)
        return n, form, chars(head), chars(mid), out

    def run(batches):
        for b in byte_portions(batches, "text"):
            segments = zip(*[b.column(c) for c in ("seg_rank", "seg_offset", "seg_slope")])
            rows = [of(i, t, (*(np.asarray(x.values) for x in seg), np.frombuffer(r, np.int8))) for i, t, seg, r in zip(
                b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), segments, b.column("residuals").to_pylist())]
            n, form, head, mid, out = (list(c) for c in zip(*rows)) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(head, pa.int64()), pa.array(mid, pa.int64()),
                 pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    id_type = indexed.schema["doc_id"].dataType.simpleString()
    return indexed.select("doc_id", "text", "seg_rank", "seg_offset", "seg_slope", "residuals").mapInArrow(
        run, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    parts = F.split(output, "|".join([PREFIX, SUFFIX, MIDDLE]), -1)
    first, second, middle = (F.get(parts, k) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Every document of ``docs`` in its drawn form; see :func:`transform`."""
    return transform(with_index(docs), seed)
