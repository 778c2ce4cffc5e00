"""Units by place, numbers in words, names of other scripts, short items, and a plain
twin of windows, slots and cover."""

import collections
import random

import pytest

from capstan.llm import decontaminate as de

from .conftest import prose

ITEM = ("A train leaves the old station at 60 km per hour and travels 120 miles before it stops near Boston where "
        "the crew sleeps until the next morning")


def found(spark, docs, items):
    out = de.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): (r["kind"], r["covered"]) for r in out.collect()}


def test_units_numbers_and_names_are_typed_by_place(spark):
    around = prose(31, 50)
    texts = [ITEM, ITEM.replace("60 km", "75 km").replace("120 miles", "150 miles").replace("Boston", "Chicago"),
             ITEM.replace("60 km", "75 knots").replace("120 miles", "150 furlongs"),
             ITEM.replace("60 km", "75 kilometers"), ITEM.replace("60 km", "seventy km").replace("120 miles", "ninety five miles"),
             ITEM.replace("60 km", "one hundred and sixty-one km"), around]
    got = found(spark, [(k, f"{around} {t} {around}") for k, t in enumerate(texts)], [(1, ITEM)])
    kinds = {d: k for (d, _), (k, _) in got.items()}
    assert kinds == {0: "exact", **{k: "reparameterised" for k in range(1, 5)}, 5: kinds.get(5)}


def test_numbers_in_words():
    assert de.tokens_of("Seventy-five km, one hundred miles and one of two Cats") == [
        "seventy_five", "km", "one_hundred", "miles", "and", "one", "of", "two", "cats"]
    assert de.units_by_place(de.tokens_of("75 knots and 3 of 8 pens")) == ["75", "knots", "and", "3", "of", "8", "pens"]


def test_names_of_other_scripts(spark):
    item = "поезд вышел туда где жила Анна и пошел туда где жил Борис затем встал там где ждала Ольга но не нашел там Веру"
    other = item.replace("Анна", "Мария").replace("Борис", "Иван").replace("Ольга", "Елена").replace("Веру", "Нину")
    assert found(spark, [(1, other), (2, prose(4, 60))], [(1, item)])[1, 1][0] == "reparameterised"
    assert "анна" in de.tokens_of(item)


def test_short_items_are_found_at_their_own_length(spark):
    items = [(1, "quaint verbal items hide here"), (2, "four words stand here"), (3, "only three words"), (4, "add 3 and 4")]
    around = prose(6, 40)
    docs = [(1, f"{around} Quaint verbal items hide here. {around}"), (2, "FOUR WORDS stand here"), (3, "only three words"), (4, f"{around} add 3 and 4"),
            (5, f"{around} add 5 and 6 quaint verbal items hide elsewhere"), (6, "add 3 and")]
    assert found(spark, docs, items) == {(1, 1): ("exact", 5), (2, 2): ("exact", 4), (4, 4): ("exact", 4)}


def test_bitmap_grows_with_the_benchmark(spark, monkeypatch):
    bench = spark.createDataFrame([(h,) for h in (-5, 7, 7, 2**40 + 3, -2**62)], "h long")
    for least in (16, 20):
        monkeypatch.setattr(de, "LEAST_BITS", least)
        bits, size = de.bitmap_of(bench)
        assert size == least and len(bits) == 2**least // 8
        assert {k for k in range(2**least) if bits[k >> 3] >> (k & 7) & 1} == {h % 2**least for h in (-5, 7, 2**40 + 3, -2**62)}
    monkeypatch.setattr(de, "LEAST_BITS", 4)
    assert de.bitmap_of(spark.range(70_000).select("id").withColumnRenamed("id", "h"))[1] == 21


def readings(text):
    """Plain reading of a text: {reading: [(word as matched, slot value or None)]}."""
    tokens = de.tokens_of(text)
    bare = [t.lstrip(de.MARKS) for t in tokens]
    number = [t[0] == de.NUMBER_MARK for t in tokens]
    typed = [t[0] in de.NUMBER_MARK + de.UNIT_MARK for t in tokens]
    name = [t[0] == de.NAME_MARK for t in tokens]
    out = {0: [(t[0], t) if s else (b, None) for t, b, s in zip(tokens, bare, typed)],
           1: [(t[0], t) if s or m else (b, None) for t, b, s, m in zip(tokens, bare, typed, name)],
           2: [(b, None) for b in bare]}
    unit = [k > 0 and number[k - 1] and bare[k].isalpha() and not name[k] and not number[k] and bare[k] not in de.NO_UNIT for k in range(len(bare))]
    unit = [u or t[0] == de.UNIT_MARK for u, t in zip(unit, tokens)]
    out[3] = [(de.UNIT_MARK, de.UNIT_MARK + b) if u else w for u, b, w in zip(unit, bare, out[1])]
    return out


def plain(docs, items):
    got = set()
    for d, text in docs:
        for i, item in items:
            for k, a in readings(text).items():
                b = readings(item)[k]
                lines = collections.defaultdict(list)
                for p in range(len(a) - 5):
                    for q in range(len(b) - 5):
                        x, y = a[p:p + 6], b[q:q + 6]
                        if [w for w, _ in x] == [w for w, _ in y] and (k == 2 or sum(v is None for _, v in x) >= 3):
                            if k != 1 or any(w == de.NAME_MARK for w, _ in x):
                                lines[p - q].append((q, [(v, u) for (_, v), (_, u) in zip(x, y) if v]))
                hit = set()
                for met in lines.values():
                    pairs = {z for _, s in met for z in s}
                    fits = len({v for v, _ in pairs}) == len({u for _, u in pairs}) == len(pairs)
                    hit |= {q + j for q, s in met if fits or not s for j in range(6)}
                if len(hit) >= min(13, len(b)) and hit:
                    got.add((d, i))
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_slots_and_cover_match_a_plain_twin(spark, seed):
    r = random.Random(seed)
    slot = lambda: r.choice(["7", "12", "seven", "thirty two", "3.5", "Anna", "Boris", "km", "kg", "pens", "and"])
    items = []
    for k in range(12):
        w = prose(900 + k, r.randrange(8, 26)).lower().split()
        items.append((k, " ".join(x for y in w for x in ([y, slot()] if r.random() < 0.3 else [y]))))
    docs = []
    for k in range(60):
        w = items[r.randrange(12)][1].split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = slot()
        docs.append((k, " ".join([prose(2000 + k, 12), *w[r.randrange(4):], prose(3000 + k, 12)])))
    want = plain(docs, items)
    assert set(found(spark, docs, items)) == want and 10 < len(want) < 60
