"""Benchmark decontamination by template canonicalisation.

Numbers, units and names are replaced by typed placeholders; windows of template
words are joined by hash with those of the benchmark; matches that lie on one
diagonal are checked for consistent slots (each value on one side stands for one
value on the other), which tells re-parameterised questions from chance; and the
words of an item that consistent windows cover decide.

Each text is read in several ways: with numbers (in digits or words) and known
units as placeholders (names kept as lower-case words, so that changed case or
punctuation does no harm); with names as placeholders too; with names and with any
content word that stands after a number as a unit, whatever the unit; and exactly,
with numbers and units as written, so that verbatim copies are found however many
numbers they hold.  Names are told by capitals of any script that has them.

Items of fewer words than a window have one window of their own length in the exact
reading; documents are read at the lengths that the benchmark holds.

Only windows whose hash is set in a bitmap, made from the benchmark and sized by its
windows, leave the scan; the join decides exactly.

Edge cases: null or empty texts match nothing; items of fewer than ``SHORTEST`` words
are common phrases and match nothing; equal items are matched once and reported each;
an empty table or benchmark gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_portions, keep_rows, mix64, row_digest, sized, stored, text_of, WordHashes

#: Words in a window, words of a template window that must not be placeholders, and words
#: of an item that must be covered (or all of a shorter item).
WINDOW, LITERAL, COVER = 6, 3, 13
#: Words of the shortest item that is looked for.
SHORTEST = 4
#: The bitmap has about 16 bits a window of the benchmark: 2 MB at least, 256 MB at most
#: (with more windows than that more of the documents' windows reach the join).
LEAST_BITS, MOST_BITS = 24, 31

# Units that become a placeholder after a number.
UNITS = ("km m cm mm mi miles kg g mg lb lbs oz l ml s sec seconds min minutes h hours days weeks months years "
         "eur usd dollars euros percent mph kph")
# Numbers in words.  "one" alone is mostly no number.
NUMBER_WORDS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
# Words after a number that are no unit.
NO_UNIT = frozenset("a after an and are as at away before but by for from had has have if in is it of on or than that the then to was were when "
                    "while with".split())

NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
UNIT = re.compile("(\ue001\\d++(?:[.,]\\d++)*+\\s*)\ue000?(" + "|".join(sorted(UNITS.split(), key=len, reverse=True)) + r"|%)(?![^\W_])", re.IGNORECASE)
#: A capitalised word inside a sentence: after a word, a comma or a semicolon.
#: (The look back follows the capital, so that the search skips to capitals.)
def letters(test) -> str:
    return "".join(c for c in map(chr, range(0x2000)) if c.isalpha() and test(c))


NAME = re.compile(rf"[{letters(str.isupper)}](?:(?<=[^\W_] .)|(?<=[,;] .))[^\W\d_]*[{letters(str.islower)}](?![^\W_])")
TOKEN = re.compile("\ue001\\d++(?:[.,]\\d++)*+|\ue002(?:%|[^\\W\\d_]+)|\ue000?[^\\W_]+")
DIGIT = re.compile(r"\d")
#: Placeholders: characters of the private use area, blanked in texts that hold them.
NAME_MARK, NUMBER_MARK, UNIT_MARK = "\ue000", "\ue001", "\ue002"
MARKS = NAME_MARK + NUMBER_MARK + UNIT_MARK


#: Placeholders of the readings; the windows of short items have none.
SLOTS = (NUMBER_MARK + UNIT_MARK, MARKS, "", MARKS)
EXACT, PLACED = 2, 3
#: Reading of windows of k words, fewer than ``WINDOW``: this number and k.
SHORT = 10
KNOWN_UNITS = frozenset(UNITS.split())


def spelt_numbers(tokens: list[str]) -> list[str]:
    """Runs of number words as one number; a known unit after one is marked."""
    out, run = [], False
    for t in tokens:
        if t in NUMBER_WORDS:
            if run:
                out[-1] += "_" + t
            elif out and out[-1] == "one":
                out[-1] = f"{NUMBER_MARK}one_{t}"
            else:
                out.append(NUMBER_MARK + t)
            run = True
        else:
            out.append(UNIT_MARK + t if run and t in KNOWN_UNITS else t)
            run = False
    return out


def units_by_place(tokens: list[str]) -> list[str]:
    """The tokens with any content word after a number marked as a unit."""
    return [UNIT_MARK + t if a[0] == NUMBER_MARK and t.isalpha() and t not in NO_UNIT else t for a, t in zip(["."] + tokens, tokens)]


def tokens_of(text: str) -> list[str]:
    """Words of the text, lower-cased; numbers, units and names carry their mark in
    front, so a placeholder and its value are one token."""
    if any(m in text for m in MARKS):
        text = text.translate({0xE000: " ", 0xE001: " ", 0xE002: " "})
    text = NAME.sub(NAME_MARK + r"\g<0>", text)
    if DIGIT.search(text):
        text = UNIT.sub(rf"\1{UNIT_MARK}\2", NUMBER.sub(NUMBER_MARK + r"\g<0>", text))
    tokens = TOKEN.findall(text.lower())
    return tokens if NUMBER_WORDS.isdisjoint(tokens) else spelt_numbers(tokens)


#: Odd multipliers of a window's words.
FACTORS = mix64(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def window_hashes(w: np.ndarray, reading: int, width: int = WINDOW) -> np.ndarray:
    n = len(w) - width + 1
    h = w[:n] * FACTORS[0]
    for j in range(1, width):
        h = h + w[j:j + n] * FACTORS[j]
    return mix64(h + np.uint64(reading)).view(np.int64)


def slot_sums(tokens: list[str], of: str) -> np.ndarray:
    return np.append(0, np.cumsum([x[0] in of for x in tokens]))


def windows(text: str, words: WordHashes, short: list[int] = ()):
    """For each reading: (reading, tokens, window hashes, whether a window has
    enough literal words).  ``short``: lengths under ``WINDOW`` to read too."""
    tokens = tokens_of(text)
    for width in short:
        if len(tokens) >= width:
            w = words.of([x.lstrip(MARKS) for x in tokens])
            yield SHORT + width, tokens, window_hashes(w, SHORT + width, width), np.ones(len(tokens) - width + 1, bool)
    n = len(tokens) - WINDOW + 1
    if n < 1:
        return
    joined = "".join(tokens)
    named, numbered = NAME_MARK in joined, NUMBER_MARK in joined
    ok = np.ones(n, bool)
    if not named and not numbered:
        yield 0, tokens, window_hashes(words.of(tokens), 0), ok
        return
    marks = [x[0] for x in tokens]
    literal = [c if c in SLOTS[0] else x.lstrip(NAME_MARK) for c, x in zip(marks, tokens)]
    w = words.of(literal)
    if numbered:
        slot = np.append(0, np.cumsum([c in SLOTS[0] for c in marks]))
        ok = WINDOW - (slot[WINDOW:] - slot[:n]) >= LITERAL
        # all windows of a text with numbers; the others are read exactly already
        v = w.copy()
        at = np.flatnonzero(np.diff(slot))
        v[at] = words.of([tokens[i][1:] for i in at])
        yield EXACT, tokens, window_hashes(v, EXACT), np.ones(n, bool)
        placed = units_by_place(tokens)
        unit = slot_sums(placed, UNIT_MARK)
        if unit[-1]:
            s = slot_sums(placed, MARKS)
            u = words.of([x[0] if x[0] in MARKS else x for x in placed])
            yield PLACED, placed, window_hashes(u, PLACED), WINDOW - (s[WINDOW:] - s[:n]) >= LITERAL
    yield 0, tokens, window_hashes(w, 0), ok
    if named:
        name = np.array([c == NAME_MARK for c in marks])
        slot = np.append(0, np.cumsum([c in MARKS for c in marks]))
        names = np.append(0, np.cumsum(name))
        # windows without a name are in the literal reading already
        ok = (WINDOW - (slot[WINDOW:] - slot[:n]) >= LITERAL) & (names[WINDOW:] - names[:n] > 0)
        w = np.where(name, words.of([NAME_MARK])[0], w)
        yield 1, tokens, window_hashes(w, 1), ok


ROW = "reading int, at int, h bigint, slots array<string>"


def emit(text: str, words: WordHashes, wanted=None, short: list[int] = ()):
    """(reading, position, hash, slot values) of the wanted windows."""
    for k, tokens, h, ok in windows(text, words, short):
        pick = np.flatnonzero(ok if wanted is None else ok & wanted(h))
        if not len(pick):
            continue
        for p in pick:
            yield k, int(p), int(h[p]), [x for x in tokens[p:p + WINDOW] if x[0] in SLOTS[k]] if k < SHORT else []


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of the distinct items: (item, n_words, reading, at, h, slots), item
    being the digest of its text."""
    def run(batches):
        words = WordHashes()
        for b in byte_portions(batches, "t"):
            rows = []
            for item, t in zip(b.column("item").to_pylist(), b.column("t").to_pylist()):
                n = len(tokens_of(t))
                own = [n] if SHORTEST <= n < WINDOW else []
                rows += [(item, n, k, at, h, s) for k, at, h, s in emit(t, words, short=own)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
                                              pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.list_(pa.string()))],
                                             ["item", "n_words", "reading", "at", "h", "slots"])

    t = benchmark.select(F.md5(text_of().cast("binary")).alias("item"), text_of().alias("t")).dropDuplicates(["item"])
    return t.mapInArrow(run, "item string, n_words int, " + ROW)


def bitmap_of(bench: DataFrame) -> tuple[bytes, int]:
    """Bitmap of the window hashes and the power of two that is its number of bits.
    Blocks of it are filled in the executors."""
    size = min(MOST_BITS, max(LEAST_BITS, int(16 * bench.count()).bit_length()))
    block = 1 << 16
    bit = F.pmod(F.col("h"), F.lit(1 << size))

    def fill(t: pa.Table) -> pa.Table:
        bits = np.zeros(block, np.uint8)
        bits[t.column("at").to_numpy()] = 1
        return pa.table({"block": t.column("block")[:1], "v": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    at = bench.select((bit / block).cast("long").alias("block"), F.pmod(bit, F.lit(block)).alias("at")).distinct()
    out = bytearray((1 << size) // 8)
    for r in at.groupBy("block").applyInArrow(fill, "block long, v binary").toLocalIterator():
        out[r["block"] * block // 8:(r["block"] + 1) * block // 8] = r["v"]
    return bytes(out), size


def document_windows(docs: DataFrame, bitmap: bytes, size: int, short: list[int]) -> DataFrame:
    """Windows of the documents whose hash is set in the bitmap of 2^size bits."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        words, bits = WordHashes(), np.frombuffer(shared.value, np.uint8)

        def wanted(h):
            b = h.view(np.uint64) & np.uint64((1 << size) - 1)
            return (bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for b in byte_portions(batches, "t"):
            rows = [(i, rk, *x) for i, rk, t in zip(b.column("doc_id").to_pylist(), b.column("rk").to_pylist(), b.column("t").to_pylist())
                    for x in emit(t, words, wanted, short)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                                              pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.list_(pa.string()))],
                                             ["doc_id", "rk", "reading", "at", "h", "slots"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_digest(docs, "text").alias("rk"), text_of().alias("t"))
    return rows.mapInArrow(run, "doc_id long, rk long, " + ROW)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, rk, item_id, covered, item_words, kind) of every document and item
    it holds; kind is ``exact`` or ``reparameterised``."""
    bench = stored(benchmark_windows(benchmark), "bench-windows")
    short = sorted(r[0] - SHORT for r in bench.where(F.col("reading") >= SHORT).select("reading").distinct().collect())  # two at most
    hits = stored(document_windows(docs, *bitmap_of(bench), short).distinct(), "doc-windows")
    right = bench.select("item", "n_words", F.col("reading").alias("_r"), F.col("at").alias("item_at"), F.col("h").alias("_h"), F.col("slots").alias("_s"))
    met = hits.join(sized(right), (F.col("reading") == F.col("_r")) & (F.col("h") == F.col("_h")))
    met = stored(met.select("doc_id", "rk", "item", "n_words", "reading", "item_at", (F.col("at") - F.col("item_at")).alias("shift"),
                            "slots", F.col("_s").alias("item_slots")).where(F.size("slots") == F.size("item_slots")), "met")

    line = ["doc_id", "rk", "item", "reading", "shift"]
    pairs = met.select(*line, F.explode(F.arrays_zip("item_slots", "slots")).alias("z")).select(*line, "z.item_slots", "z.slots").distinct()
    # consistent: no value on either side stands for two on the other
    slots = pairs.groupBy(*line).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_slots").alias("n1"), F.countDistinct("slots").alias("n2"),
                                     F.max((F.col("item_slots") != F.col("slots")).cast("int")).alias("changed"))
    slots = slots.select(*[F.col(c).alias(f"_{c}") for c in line], ((F.col("n") == F.col("n1")) & (F.col("n") == F.col("n2"))).alias("fits"), "changed")
    same = F.lit(True)
    for c in line:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = met.join(slots, same, "left")
    # on an inconsistent diagonal only the windows without a slot count
    met = met.where(F.coalesce("fits", F.lit(True)) | (F.size("slots") == 0))
    at = F.sort_array(F.collect_set("item_at"))  # at most as many as the item has windows
    cover = met.groupBy("doc_id", "rk", "item", "reading").agg(
        at.alias("at"), F.max("n_words").alias("n_words"),
        F.max(F.when(F.size("slots") > 0, F.col("changed")).otherwise(0)).alias("changed"))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-1000).alias("end")), lambda s, p: F.struct(
        (s["n"] + F.least(F.lit(WINDOW), p + WINDOW - s["end"])).alias("n"), (p + WINDOW).alias("end")), lambda s: s["n"])
    cover = cover.withColumn("covered", F.least(covered, F.col("n_words"))).where(F.col("covered") >= F.least(F.lit(COVER), F.col("n_words")))
    cover = cover.groupBy("doc_id", "rk", "item").agg(
        F.max("covered").alias("covered"), F.max("n_words").alias("item_words"),
        F.coalesce(F.max(F.when(F.col("reading") == EXACT, F.col("covered"))), F.lit(0)).alias("_exact"),
        F.min(F.when(F.col("reading") != EXACT, F.col("changed"))).alias("changed"))
    # the exact reading decides only where a template does not cover more
    cover = cover.withColumn("changed", F.when((F.col("changed") == 1) & (F.col("_exact") < F.col("covered")), 1).otherwise(0))
    items = benchmark.select("item_id", F.md5(text_of().cast("binary")).alias("_i")).distinct()
    return cover.join(items, F.col("item") == F.col("_i")).select(
        "doc_id", "rk", "item_id", F.col("covered").cast("long").alias("covered"), F.col("item_words").cast("long").alias("item_words"),
        F.when(F.col("changed") == 1, F.lit("reparameterised")).otherwise(F.lit("exact")).alias("kind"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_cx_id"), F.col("rk").alias("_cx_rk")).distinct()
    return keep_rows(docs, stored(bad, "contaminated"), "text")
