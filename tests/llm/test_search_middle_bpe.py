import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from .conftest import prose
from pyspark.sql import functions as F

from capstan.llm import byte_bpe, fill_middle, lexical_search

BPE = "byte_bpe_multi_50k.tiktoken"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    with open(P.path(BPE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- ranked lexical search ---------------------------------------------------

def ranked(rows, items, k=10):
    """Brute force: [(item_id, rank, doc_id, score)]."""
    counts = [(i, collections.Counter(TERM.findall(lower(t)))) for i, t in rows]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    big_n, big_l = len(counts), sum(n for _, _, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    terms = collections.defaultdict(set)
    for i, t in items:
        terms[i] |= set(TERM.findall(lower(t)))
    out = []
    for item, held in terms.items():
        scored = []
        for i, c, n in counts:
            m = 100 - 90 + (90 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in held if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return collections.Counter(out)


def found(df):
    return collections.Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


ITEMS = [(1, prose(1, 30)), (2, prose(2, 12).upper()), (3, None), (4, ""), (5, "?!"), (6, "one"), (7, "été — nothing else"), (None, "one x1"),
         (8, prose(9, 40)), (8, "ONE"), (8, "ONE"), (9, "no-such-word-anywhere"), (10, prose(4, 4000))]


def test_search_of_odd_rows(spark, odd, odd_rows):
    items = spark.createDataFrame([(*i, 7, "x") for i in ITEMS], "item_id long, text string, doc_id long, term string").repartition(3)
    want = ranked([r[:2] for r in odd_rows], ITEMS)
    assert found(lexical_search.search(odd, items)) == want
    assert found(lexical_search.search(odd, items, group_terms=40)) == want  # several groups of items
    assert found(lexical_search.search(odd, items, k=2)) == ranked([r[:2] for r in odd_rows], ITEMS, 2)


def test_small_tiles_and_ties_give_the_same(spark, monkeypatch):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 9)))) for k in range(300)]
    rows += [(k, "tie of many") for k in range(400, 460)] + [(k, "tie of many") for k in range(390, 400)]
    items = [(k, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(6))) for k in range(20)] + [(50, "many tie")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = ranked(rows, items)
    assert found(lexical_search.search(docs, bench)) == want
    assert [d for (i, _, d, _) in sorted(want) if i == 50] == list(range(390, 400))
    for name, size in (("TILE_DOCS", 7), ("TILE_TERMS", 3), ("TILE_ITEMS", 4)):
        monkeypatch.setattr(lexical_search, name, size)
    parts = lexical_search.tiles_of([np.array([0, 2, 3, 5]), np.array([1, 2])], np.array([9, 9, 9, 9, 9, 9]))
    assert [len(v) for _, vs in parts for v, _, _ in vs] == [3, 2]
    assert found(lexical_search.search(docs, bench)) == want


def test_tiles_keep_sums_exact():
    heavy = 3 << 30  # a weight for which only two terms fit under 2^53
    held = lexical_search.tiles_of([np.arange(9)], np.full(9, heavy))
    assert all(len(v) * heavy * lexical_search.MAX_IMPACT < lexical_search.EXACT for _, parts in held for v, _, _ in parts)


def test_search_of_empty_tables(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0 == lexical_search.search(odd, items.limit(0)).count()
    blank = spark.createDataFrame([(1, None), (2, " . ")], "doc_id long, text string")
    assert lexical_search.search(blank, items).count() == 0


def test_long_texts_are_counted_whole(monkeypatch):
    text = "aB c1 " * 400 + "é" * 90
    want = (801, {b"ab": 400, b"c1": 400, ("é" * 90).encode(): 1})
    assert lexical_search.term_counts(text.encode()) == want
    monkeypatch.setattr(lexical_search, "CHUNK", 7)
    assert lexical_search.term_counts(text.encode()) == want


# --- fill-in-the-middle ------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_of(doc_id, text, seed=42):
    text = text or ""
    w = UNIT.findall(text)
    n = len(w)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = ("".join(x) for x in (w[:a], w[a:b], w[b:]))
    spm = h4 % 100 < 80
    return (doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


def test_middle_of_odd_rows(spark, odd, odd_rows, none):
    r = random.Random(8)
    parts = ["a", " ", "\n", "été", "\U0001F600x", "\t\t", " ", "<", "P>", "<<", "S", "long" * 90, "\x00", "\x1c"]
    more = [(100 + k, "".join(r.choice(parts) for _ in range(r.randrange(40)))) for k in range(400)]
    more += [(600 + k, "has <P> in it" if k % 2 else "ends with <S") for k in range(12)] + [(700 + k, prose(k, 3000)) for k in range(8)]
    docs = odd.select("doc_id", "text", "n_words", "target").union(spark.createDataFrame([(*x, 1, "t") for x in more], "doc_id long, text string, a int, b string"))
    got = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    rows = [(x[0], x[1]) for x in odd_rows] + more
    assert collections.Counter(tuple(x)[:6] for x in got) == collections.Counter(middle_of(*x) for x in rows)
    assert collections.Counter((x["doc_id"], x["back"]) for x in got) == collections.Counter((i, t or "") for i, t in rows)
    assert {x["form"] for x in got} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(none).count() == 0


@pytest.mark.parametrize("error", [0, 3, fill_middle.ERROR])
def test_index_is_exact_and_bounded(error):
    r = np.random.default_rng(3)
    for steps in (r.integers(1, 9, 20_000), np.full(9000, 6), r.choice([1, 2, 900], 5000), np.array([], int), np.array([5])):
        y = np.concatenate(([0], np.cumsum(steps))).astype(np.int64)
        index = fill_middle.fit_segments(y, error)
        off = y - fill_middle.foreseen(*index[:3], np.arange(len(y)))
        assert np.abs(off).max() <= error + 1 and np.array_equal(off, index[3])
        assert [fill_middle.offset_of(index, k) for k in (0, len(y) // 2, len(y) - 1)] == [y[0], y[len(y) // 2], y[-1]]
    assert len(fill_middle.fit_segments(np.arange(100_000) * 6)[0]) == 1


def test_one_index_serves_many_draws(spark, odd, odd_rows):
    index = fill_middle.with_index(odd)
    for seed in (1, 7):
        got = collections.Counter(tuple(x) for x in fill_middle.transform(index, seed).collect())
        assert got == collections.Counter(middle_of(x[0], x[1], seed) for x in odd_rows)
    with pytest.raises(ValueError):
        fill_middle.with_index(odd, 127)


# --- byte-level BPE ----------------------------------------------------------

def test_small_portions_and_caches_give_the_same(library, monkeypatch):
    texts = [prose(k, 60) + "z" * k for k in range(90)]
    want = [library.encode_ordinary(t) for t in texts]
    for name, size in (("PIECES", 11), ("KEEP_PIECES", 5), ("LONG", 300), ("ROWS", 3)):
        monkeypatch.setattr(byte_bpe, name, size)
        assert [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.encoder(BPE)(texts)] == want


def test_bpe_of_odd_rows(spark, odd, odd_rows, none, library):
    r = random.Random(4)
    more = [(100 + k, "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x2000), r.randrange(0x10000, 0x1F700)])) for _ in range(r.randrange(60)))
             .encode("utf-8", "ignore").decode()) for k in range(500)]
    more += [(700, "<|endoftext|> it's  \n\n 12345  "), (701, "ab" * 3000), (702, "\x00\x1c\x85 　")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = byte_bpe.decode(byte_bpe.encode(docs, BPE), BPE).collect()
    rows = [(x[0], x[1] or "") for x in odd_rows] + more
    want = collections.Counter((i, tuple(library.encode_ordinary(t)), t.encode()) for i, t in rows)
    assert collections.Counter((x["doc_id"], tuple(np.frombuffer(x["ids"], "<u4").tolist()), bytes(x["decoded"])) for x in got) == want
    assert all(x["n_tokens"] * 4 == len(x["ids"]) for x in got)
    assert byte_bpe.round_trip(none).count() == 0


def test_merges_in_order_of_rank_then_place(library):
    ranks = byte_bpe.read_ranks(BPE)
    longest, r, merges, many = max(map(len, ranks)), random.Random(2), byte_bpe.Merges(ranks), []
    for _ in range(3000):
        piece = bytes(r.choice(b"aaabtheisn \xc3\xa9\xff") for _ in range(r.randint(1, 70)))
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:  # the plain way: look at all pairs after every merge
            least = min((ranks.get(parts[i] + parts[i + 1], byte_bpe.NONE), i) for i in range(len(parts) - 1))
            if least[0] == byte_bpe.NONE:
                break
            parts[least[1]:least[1] + 2] = [parts[least[1]] + parts[least[1] + 1]]
        want = [ranks[p] for p in parts]
        assert byte_bpe.merge_piece(piece, ranks, longest) == want
        if len(piece) <= byte_bpe.KEEP_BYTES:
            many.append((piece, want))
    for bits in range(7):  # the same pieces as rows of one array of trees
        part = [x for x in many if len(x[0]) <= 1 << bits]
        got = merges.merge_rows([p for p, _ in part], bits)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [w for _, w in part]


def test_pair_tree_keeps_the_leftmost_minimum():
    r = random.Random(6)
    for n in (1, 2, 3, 17):
        keys = [r.randrange(5) << 8 | i for i in range(n)]
        tree = byte_bpe.PairTree(keys)
        for _ in range(60):
            assert tree.least() == min(keys)
            i = r.randrange(n)
            keys[i] = r.choice([byte_bpe.NONE, r.randrange(5) << 8 | i])
            tree.put(i, keys[i])


def test_portions_by_bytes():
    import pyarrow as pa

    from capstan.llm.common import byte_portions

    b = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "b" * 50, "", "c", "d" * 3, "e" * 9])], ["t"])
    parts = [p.column("t").to_pylist() for p in byte_portions([b, b.slice(2, 3)], "t", 10)]
    assert parts == [["a" * 5, None], ["b" * 50], ["", "c", "d" * 3], ["e" * 9], ["b" * 50], ["", "c"]]
    assert list(byte_portions([b.slice(0, 0)], "t")) == []
