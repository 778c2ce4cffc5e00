import collections
import re

import pytest

from capstan.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    w = WORD.findall(text or "")
    grams = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_measures_match_brute_force(odd, odd_rows):
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                              for r in quality.host_rules(odd).collect())
    assert got == collections.Counter((r[0], *measures(r[1])) for r in odd_rows)


def test_bad_host_loses_its_documents(spark):
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(k, good + f" d{k}", "en", "fine") for k in range(60)] + [(100 + k, "short", "en", "bad") for k in range(60)]
    rows += [(200, good, "en", "bad"), (201, good + " #" * 60, "en", "fine"), (202, good, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.host_rules(docs).where("kept").collect()}
    assert set(range(60)) <= kept and 202 in kept and 200 not in kept and not kept & set(range(100, 160))
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == kept


def test_empty_tables(none):
    assert quality.host_rules(none).count() == 0 and quality.keep_good(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def fill(sizes):
    """Targets as the contract words them: shares, stops, excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / w for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return out


def test_mix_meets_targets(odd, odd_rows):
    rows = mixing.mix(odd).collect()
    size = collections.Counter()
    for r in odd_rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    want = fill(dict(size))
    assert len(rows) == len(odd_rows)
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"] * (2 if r["doc_id"] == 7 else 1))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in want)


def test_mix_reruns_agree_and_rows_repeat(odd):
    one = sorted(map(str, mixing.mix(odd).collect()))
    assert one == sorted(map(str, mixing.mix(odd.repartition(7)).collect()))
    copies = collections.Counter()
    for r in mixing.mix(odd).collect():
        copies[r["doc_id"]] += r["copies"]
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert collections.Counter(r["doc_id"] for r in out.collect()) == +copies


def test_refinement_equals_one_sorted_pass(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7), "en", "a" if k % 3 else "b") for k in range(900)],
                                 "doc_id long, text string, lang string, source string")
    rows = docs.select("doc_id", "source", mixing.size_of(docs.text).alias("size"), mixing.hash_of("mix-1").alias("h")).collect()
    got = {r["doc_id"]: (r["taken"], r["target"], r["source_size"]) for r in mixing.mix(docs).collect()}
    for s in "ab":
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: r["h"])
        _, target, total = got[mine[0]["doc_id"]]
        passes = int(target // total)
        budget, below = target - passes * total, 0
        for r in mine:
            more = below + r["size"] <= budget or (below <= budget and below + r["size"] - budget < budget - below)
            assert got[r["doc_id"]][0] == (passes + more) * r["size"]
            below += r["size"]
