import collections
import random
import re

import pytest

from capstan.llm import decontaminate, ngram_join

from .conftest import prose


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    links, root = collections.Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    copies = collections.Counter()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a and b and (i == j or len(a & b) >= 0.8 * len(a | b)):
                copies[i] += a == b
                if i != j:
                    links[i] += 1
                    root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        if r[0] is None:
            first[find(i)] = None
        elif first.get(find(i), r[0]) is not None:
            first[find(i)] = min(first.get(find(i), r[0]), r[0])
    return collections.Counter((r[0], first[find(i)], max(1, copies[i]), links[i]) for i, r in enumerate(rows))


def found(df):
    return collections.Counter((r["doc_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in ngram_join.near_duplicates(df).collect())


def test_odd_rows_match_brute_force(odd, odd_rows):
    assert found(odd) == brute(odd_rows)


@pytest.mark.parametrize("block", [256, 5])
def test_edited_copies_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r, rows = random.Random(4), []
    for k in range(12):
        w = prose(100 + k, 150).split()
        for _ in range(r.randrange(1, 25)):
            rows.append((len(rows), " ".join(w)))
            if r.random() < 0.8:
                w = list(w)
                for _ in range(r.randrange(1, 4)):
                    w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    passage = prose(999, 60)
    rows += [(len(rows) + k, prose(500 + k, 40) + " " + passage) for k in range(30)]
    r.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_keep_one_of_each_class(spark, odd, odd_rows, none):
    out = ngram_join.keep_one(odd)
    assert out.columns == odd.columns
    kept = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = brute(odd_rows)
    wordless = sum(1 for r in odd_rows if not shingles(r[1]))
    classes = {c for (_, c, _, _) in want}
    assert max(kept.values()) == 1
    assert {i for i, _ in kept} == {d for d, c, _, _ in want if d == c}
    assert len(kept) >= len(classes) and len(kept) <= len(classes) + wordless
    assert ngram_join.keep_one(none).count() == 0 and ngram_join.near_duplicates(none).count() == 0


def test_long_chain_is_one_component(spark):
    edges = [(f"{k:04d}".encode(), f"{k + 1:04d}".encode()) for k in range(200)] + [(b"x", b"y")]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in ngram_join.components(df).collect()}
    assert {got[f"{k:04d}".encode()] for k in range(201)} == {b"0000"} and got[b"y"] == b"x" and len(got) == 203


def test_pruning_keeps_what_can_reach_the_threshold():
    need = ngram_join.least_matches()
    assert list(need) == [25, 50, 75, 100, 125]
    assert all(0.2 * n < m < 0.8 * n for n, m in need.items())


ITEM = "A train leaves Berlin at 9 km from the coast and meets Anna after 45 minutes on the long bridge near the old mill"


def test_items_are_found_in_changed_documents(spark, odd, none):
    plain = prose(7, 30)
    items = [(1, ITEM), (2, plain), (3, plain), (4, "too short item"), (5, None), (6, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    around, w = prose(8, 60), plain.split()
    swapped = ITEM.replace("Berlin", "Lisbon").replace("Anna", "Maria").replace("45", "30").replace("9", "12")
    rows = [
        (1, f"{around} {ITEM} {around}"), (2, f"{around} {ITEM.upper()}! {around}"), (3, f"{around} {swapped} {around}"),
        (4, f"{around} {' '.join(w[:6])} {around}"), (5, re.sub(r"[.,]", "", plain)), (6, f"{around} {' '.join(w[:14])} changed"),
        (7, " ".join(w[:14] + ["other"] + w[15:])), (8, around), (9, None), (10, "too short item"), (None, plain), (11, plain), (11, plain),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert {d for d, _ in got} == {1, 2, 3, 5, 6, 7, 11, None}
    assert got[1, 1] == "exact" and got[2, 1] == "exact" and got[3, 1] == "reparameterised"
    assert (11, 2) in got and (11, 3) in got
    assert sorted(str(r["doc_id"]) for r in decontaminate.keep_clean(docs, benchmark).collect()) == ["10", "4", "8", "9"]
    out = decontaminate.keep_clean(odd, benchmark)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert decontaminate.keep_clean(none, benchmark).count() == 0
    assert decontaminate.keep_clean(docs, benchmark.limit(0)).count() == len(rows)


def test_inconsistent_slots_do_not_count(spark):
    benchmark = spark.createDataFrame([(1, "sum 3 and 3 then take 3 away from 3 before adding 3 again and halve 3 at last")], "item_id long, text string")
    same = "sum 8 and 8 then take 8 away from 8 before adding 8 again and halve 8 at last"
    mixed = "sum 8 and 9 then take 7 away from 6 before adding 5 again and halve 4 at last"
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(docs, benchmark).collect()] == [1]


def test_windows_match_brute_force(spark):
    r = random.Random(9)
    items = [(k, prose(300 + k, r.randrange(13, 40))) for k in range(20)]
    rows = []
    for k in range(120):
        w = prose(1000 + k, r.randrange(30, 90)).split()
        if k % 3:
            s = items[r.randrange(20)][1].split()
            n = r.randrange(5, len(s) + 1)
            at = r.randrange(len(s) - n + 1)
            w[10:10] = s[at:at + n]
        rows.append((k, " ".join(w)))

    def runs(a, b):
        a, b = (re.findall(r"[^\W_]+", x.lower()) for x in (a, b))
        hit = {j + q for i in range(len(a) - 5) for j in range(len(b) - 5) if a[i:i + 6] == b[j:j + 6] for q in range(6)}
        return len(hit) >= min(13, len(b))

    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in rows for i, s in items if runs(t, s)}
