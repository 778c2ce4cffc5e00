"""Personal data by rules and by bootstrapped contextual extraction.

Base spans come from four fixed rules.  They seed a graph of lexical patterns
(two words before the value, or the words on both sides of it) and instances
(values): Spark scores patterns by the instances they hold and instances by the
patterns that hold them, in turns; patterns of high confidence then add spans for
values that no rule caught.  The form of a value plays no part in a pattern; it
only tells of which kinds a value can be.

Neighbouring words with digits can be one value or several: each start of such a run
that can be of a kind is a reading of its own, an equal share of an instance, and
the graph's confidence picks one of them (see ``find_personal_data``).

Edge cases: a null text counts as empty; empty texts have no spans; rows equal in
id and text get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_portions, row_digest, stored, text_of

KINDS = ("email", "ip", "card", "phone")

ROUNDS = 3
#: A pattern counts from this confidence and number of trusted instances on.
PATTERN_CONFIDENCE, PATTERN_SUPPORT = 0.8, 3
INSTANCE_CONFIDENCE = 0.9

# Written without backtracking over a run: a run that fails at its start fails
# at every later start too.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
AT = r"(?:\x20?@\x20?|\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)"
DOT = r"(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20)"
#: A mail address told in words or with blanks: at and dot in brackets or spelt.
SPELT = re.compile(rf"(?<!\S)[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*+", re.IGNORECASE)
SPELT_HINT = re.compile(r"[(\[{]\x20?at\x20?[)\]}]|\x20dot\x20|[(\[{]\x20?dot|@\x20|\x20@", re.IGNORECASE)
#: Words with a digit or an @, with the words with a digit right after them.
VALUE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9]\S*+)*+")
LABEL = re.compile(r"[A-Za-z_]+[:=](?=[^:]+$)")
IP_LIKE = re.compile(r"[\[(]?[0-9A-Fa-f]*(?:(?:[.:]|[\[(]\.[\])])[0-9A-Fa-f]*){2,}(?:[/%:][0-9A-Za-z]+)?[\])]?")
CARD_LIKE = re.compile(r"[0-9](?:[\x20._/-]*[0-9]){11,18}")
LETTER = re.compile(r"[^\W\d_]")
#: Longest address, card or phone number; a mail address has no bound, as in its rule.
VALUE_CHARS = 254
#: A longer pattern or value is known by its digest.
KEY_CHARS = 254
#: Most digits of a kind: a run of words with digits is read on up to these.
MOST_DIGITS = 19
WORD = re.compile(r"[^\W_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Around each @: the longest run of name characters before it that does not
    reach into the match before, and the domain after it."""
    out, end, last = [], 0, -1
    for m in DOMAIN.finditer(text):
        at = m.start()
        low = max(end, last + 1)
        head = text[low:at]
        n = len(head) - len(head.rstrip(LOCAL))
        last = at
        if n:
            out.append((at - n, m.end()))
            end = m.end()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def small_part(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) < 4 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base rules, sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small_part, m.group().split(".")))]
        for m in CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


def types(value: str) -> int:
    """Bits of the kinds that a value can be of by its form, judged coarsely."""
    bits = int("@" in value[1:-1] or SPELT.fullmatch(value) is not None)
    if len(value) > VALUE_CHARS:
        return bits
    n = sum(map(str.isdigit, value))
    bits |= 2 * (IP_LIKE.fullmatch(value) is not None)
    bits |= 4 * (CARD_LIKE.fullmatch(value) is not None)
    # letters: an extension
    return bits | 8 * (7 <= n <= 17 and "@" not in value and len(LETTER.findall(value)) <= 6)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with line ends in place of the spans, which are sorted."""
    out, end = [], 0
    for s, e in spans:
        s = max(s, end)
        if e > s:
            out += [text[end:s], "\n" * (e - s)]
            end = e
    return "".join([*out, text[end:]]) if out else text


def trimmed(s: int, v: str) -> tuple[int, int]:
    """(start, end) of the value that stands at ``s`` without a label before it and
    without the marks around it."""
    label = LABEL.match(v)
    if label:
        s, v = s + label.end(), v[label.end():]
    w = v.lstrip("\"'<>[]{},;:.!?*)#=")if not v.startswith(("::", "[")) else v
    s, v = s + len(v) - len(w), w.rstrip("\"'<>{},;:.!?*(=")
    if v.startswith("(") and ")" not in v:
        s, v = s + 1, v[1:]
    if v.endswith(")") and "(" not in v:
        v = v[:-1]
    if v.startswith("[") and "]" not in v:
        s, v = s + 1, v[1:]
    if v.endswith("]") and "[" not in v:
        v = v[:-1]
    return s, s + len(v)


def readings(s: int, run: str) -> list[tuple[int, int]]:
    """(start, end) of the values that a run of words with digits can begin with:
    each start of it that can be of a kind, in order of length; the whole run if none can."""
    out, digits, at = [], 0, 0
    while at < len(run) and digits <= MOST_DIGITS:
        end = run.find(" ", at + 1)
        end = len(run) if end < 0 else end
        digits += sum(map(str.isdigit, run[at:end]))
        b, e = trimmed(s, run[:end])
        if e > b and (b, e) not in out and types(run[b - s:e - s]):
            out.append((b, e))
        at = end
    whole = trimmed(s, run)
    return out or ([whole] if whole[1] > whole[0] else [])


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, readings of its run) of the values beside the base spans: whatever
    holds a digit or an @, or tells a mail address in words."""
    text = without(text, sorted((s, e) for s, _, e in spans))
    told = [m.span() for m in SPELT.finditer(text) if SPELT_HINT.search(m.group())] if SPELT_HINT.search(text) else []
    out = [(s, e, 1) for s, e in told]
    for m in VALUE.finditer(without(text, told)):
        got = readings(m.start(), m.group())
        out += [(s, e, len(got)) for s, e in got]
    return out


def words_before(text: str, low: int, s: int) -> tuple[list[str], bool]:
    """The words of text[low:s], or the last of them where two whole ones lie nearer;
    and whether they begin at ``low``."""
    n = 64
    while True:
        at = max(low, s - n)
        words = WORD.findall(text[at:s].lower())
        if at == low or len(words) > 2:     # the first one may be cut
            return words, at == low
        n *= 4


def key_of(x: str) -> str:
    return x if len(x) <= KEY_CHARS else hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, int, float, list[str]]]:
    """(value, start, end, kind number or -1, bits of the kinds it can be of, share,
    patterns) of base spans and of the other values that stand in a pattern."""
    out, low, last = [], 0, []
    upto, nxt = -1, None                # the first word found from ``upto`` on
    todo = sorted([(s, e, kind, 1) for s, kind, e in spans] + [(s, e, -1, n) for s, e, n in candidates(text, spans)])
    for s, e, kind, n in todo:
        words, joined = words_before(text, low, s)
        if joined:
            if last and words and WORD.fullmatch(text[low - 1:low + 1]):   # a word goes on over ``low``
                words[0] = last[-1] + words[0]
                words = last[:-1] + words
            else:
                words = last + words
        left = words[-2:]
        low, last = s, left
        # readings of one run end one after the other, so a word is looked for once or twice
        if upto < 0 or e < upto or nxt is not None and nxt.start() < e:
            upto, nxt = e, WORD.search(text, e)
        right = [nxt.group().lower()] if nxt else []
        patterns = []
        if len(left) == 2:
            patterns.append(key_of(f"{left[0]} {left[1]} _"))
        if left and right:
            patterns.append(key_of(f"{left[-1]} _ {right[0]}"))
        if patterns:
            value = text[s:e]
            out.append((key_of(value), s, e, kind, types(value) | (1 << kind if kind >= 0 else 0), 1 / n, patterns))
    return out


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
MENTION = pa.struct([("value", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()),
                     ("types", pa.int32()), ("share", pa.float64()), ("patterns", pa.list_(pa.string()))])


def extract(docs: DataFrame) -> DataFrame:
    """Base spans and mentions of every document."""
    def run(batches):
        for b in byte_portions(batches, "t"):
            spans, found = [], []
            for t in b.column("t").to_pylist():
                s = base_spans(t)
                spans.append([{"start": x, "kind": k, "end": y} for x, k, y in s])
                found.append([dict(zip(("value", "start", "end", "kind", "types", "share", "patterns"), m))
                              for m in mentions(t, s)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), pa.array(spans, pa.list_(SPAN)), pa.array(found, pa.list_(MENTION))],
                                             ["doc_id", "rk", "spans", "mentions"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_digest(docs, "text").alias("rk"), text_of().alias("t")).mapInArrow(
        run, "doc_id long, rk long, spans array<struct<start:bigint,kind:int,end:bigint>>, "
        "mentions array<struct<value:string,start:bigint,end:bigint,kind:int,types:int,share:double,patterns:array<string>>>")


def score_graph(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confidence of patterns and of instances for each kind, after some rounds.

    ``seen`` has (value, kind, types, share, pattern).  An instance is known by the digest
    of its value.  A pattern's confidence is the mean confidence of its instances by
    their shares with one doubtful instance added; an instance that is no seed has 1 minus the
    product of the doubts of its counted patterns, for the kinds it can be of."""
    edges = stored(seen.groupBy(F.md5(F.col("value").cast("binary")).alias("inst"), "pattern")
                   .agg(F.bit_or("types").alias("types"), F.max("share").alias("w"), *[F.max((F.col("kind") == k).cast("double")).alias(f"s{k}") for k in range(len(KINDS))]), "pii-edges")
    seeds = edges.groupBy("inst").agg(F.bit_or("types").alias("types"), *[F.max(f"s{k}").alias(f"c{k}") for k in range(len(KINDS))])
    inst = seeds
    pattern = None
    links = edges.select("inst", "pattern", "w")
    for _ in range(ROUNDS):
        pattern = stored(links.join(inst, "inst").groupBy("pattern").agg(
            *[(F.sum(F.col("w") * F.col(f"c{k}")) / (F.sum("w") + 1)).alias(f"p{k}") for k in range(len(KINDS))],
            *[F.sum((F.col(f"c{k}") >= INSTANCE_CONFIDENCE).cast("long")).alias(f"n{k}") for k in range(len(KINDS))]), "pii-patterns")
        good = pattern.where(_counted()).select("pattern", *[
            F.when(_counts(k), F.col(f"p{k}")).otherwise(0.0).alias(f"p{k}") for k in range(len(KINDS))])
        grown = links.join(good, "pattern").groupBy("inst").agg(
            *[(1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col(f"p{k}")))))).alias(f"g{k}") for k in range(len(KINDS))])
        inst = stored(seeds.join(grown, "inst", "left").select(
            "inst", "types", *[F.greatest(f"c{k}", F.when(_can_be(k), F.col(f"g{k}")).otherwise(0.0)).alias(f"c{k}") for k in range(len(KINDS))]), "pii-instances")
    return pattern, inst


def _can_be(k: int) -> Column:
    return F.col("types").bitwiseAND(F.lit(1 << k)) != 0


def _counts(k: int) -> Column:
    return (F.col(f"p{k}") >= PATTERN_CONFIDENCE) & (F.col(f"n{k}") >= PATTERN_SUPPORT)


def _counted() -> Column:
    c = F.lit(False)
    for k in range(len(KINDS)):
        c = c | _counts(k)
    return c


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (text of base spans), spans
    (text of all spans; those of the method are named ctx- and the kind).

    Of the readings that begin at one place the surest one stays; among equally sure
    ones a reading with the digits that the kind's rule asks for, the shortest such
    one, else the longest reading."""
    rows = stored(extract(docs), "pii")
    seen = rows.select("doc_id", "rk", F.explode("mentions").alias("m")).select(
        "doc_id", "rk", "m.value", "m.start", "m.end", "m.kind", "m.types", "m.share", F.explode("m.patterns").alias("pattern"))
    pattern, inst = score_graph(seen)

    good = pattern.where(_counted()).select("pattern", F.array(*[_counts(k) for k in range(len(KINDS))]).alias("_good"))
    sure = inst.select("inst", F.array(*[F.col(f"c{k}") for k in range(len(KINDS))]).alias("_c"))
    new = seen.where(F.col("kind") < 0).withColumn("digits", F.length(F.regexp_replace("value", "[^0-9]", ""))).join(good, "pattern").withColumn("inst", F.md5(F.col("value").cast("binary"))).join(sure, "inst")
    # the surest of the kinds that a value can be of and its patterns stand for
    best = F.array_max(F.filter(F.array(*[F.struct(F.when(F.get("_good", F.lit(k)) & _can_be(k), F.get("_c", F.lit(k))).alias("c"), F.lit(-k).alias("k"))
                                          for k in range(len(KINDS))]), lambda x: x["c"] >= INSTANCE_CONFIDENCE))
    new = new.withColumn("_best", best).where(F.col("_best").isNotNull())
    new = new.groupBy(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"), "start", "end").agg(F.max("_best").alias("_best"), F.max("digits").alias("digits"))
    new = new.withColumn("_kind", (-F.col("_best")["k"]).cast("int"))
    full = F.when(F.col("_kind") == 3, F.col("digits").between(10, 15)).when(F.col("_kind") == 2, F.col("digits").between(14, 19)).otherwise(False)
    rank = F.struct(F.round(F.col("_best")["c"], 9), full, F.when(full, -F.col("end")).otherwise(F.col("end")))
    new = new.groupBy("_id", "_rk", "start").agg(F.max_by(F.struct("end", (F.col("_kind") + len(KINDS)).alias("kind")), rank).alias("_won"))
    new = new.select("_id", "_rk", "start", "_won.end", "_won.kind")
    # as many entries as the document has values
    new = new.groupBy("_id", "_rk").agg(F.collect_set(F.struct("start", "kind", "end")).alias("_new"))
    out = rows.join(new, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rk") == F.col("_rk")), "left")

    names = F.array(*[F.lit(k) for k in KINDS], *[F.lit(f"ctx-{k}") for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    everything = F.when(F.col("_new").isNull(), F.col("spans")).otherwise(F.concat("spans", "_new"))
    return out.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                      joined(F.col("spans")).alias("base"), joined(everything).alias("spans"))
