"""Labels stand whatever else a file holds; frequencies are those of all documents."""

import math
import random

from capstan.llm import licenses


def labels_of(spark, rows):
    return {r["doc_id"]: (set(filter(None, r["labels"].split(","))), r["score"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_stray_notice_words_take_no_label(spark):
    rows = [(k, "mozilla public license") for k in range(100)]
    rows += [(200, "form of the subject and code " + "other words " * 50 + " terms source form mozilla public license " + " subject code form " * 9)]
    got = labels_of(spark, rows)
    assert all(got[k][0] == {"mpl-2.0"} and got[k][1] > 0 for k in [*range(100), 200])


def test_more_words_never_take_a_label(spark):
    r = random.Random(7)
    pool = licenses.notice_words() + ["lorem", "ipsum", "dolor"]
    rows, want = [], {}
    for k in range(150):
        label, notice, keys = r.choice(licenses.TEMPLATES)
        text = notice if r.random() < 0.5 else " filler ".join(keys)
        more = [" ".join(r.choice(pool) for _ in range(r.choice([0, 3, 60]))) for _ in (0, 1)]
        rows += [(2 * k, text), (2 * k + 1, f"{more[0]} {text} {more[1]}")]
        want[k] = label
    got = labels_of(spark, rows)
    for k, label in want.items():
        assert label in got[2 * k][0] and got[2 * k][0] <= got[2 * k + 1][0]
        assert 0 < got[2 * k][1] <= 1 and 0 < got[2 * k + 1][1] <= 1


def test_rare_words_come_from_all_documents(spark):
    rows = [(k, "gnu code" if k % 2 else "nothing here") for k in range(40)] + [(50, "gnu affero general public license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = docs.selectExpr("split(text, ' ') AS w").selectExpr(f"array_intersect(array({', '.join(repr(w) for w in licenses.notice_words())}), w) AS v")
    rare = {(r["label"], r["word"]): r for r in licenses.rare_postings(base, licenses.postings(spark)).collect()}
    assert ("agpl", "affero") in rare and ("agpl", "gnu") not in rare  # gnu stands in every other document
    assert abs(rare[("agpl", "affero")]["idf"] - math.log1p(41 / 1)) < 1e-12
