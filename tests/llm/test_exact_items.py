"""Verbatim copies of items full of numbers."""

from capstan.llm import decontaminate as de
from tests.llm.conftest import prose


def test_number_dense_items_are_found_verbatim(spark):
    items = ["Solve 3 x 4 + 5 x 7 = 20", "Compute 3 + 5 * 7 - 2 / 4",
             "Add 12 14 17 21 28 33 41 56 78 90 101 112 then 5 km 7 kg 9 ml 11 % and 2024-05-17 to 2025-06-18"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    around = prose(5, 50)
    rows = [(k, f"{around} {t} {around}") for k, t in enumerate(items)]
    rows += [(10, f"{around} Compute 4 + 6 * 8 - 3 / 5 {around}"), (11, around), (12, f"{around} Solve 3 x 4 + 5 {around} 7 = 20")]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in de.contaminated(
        spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {(k, k): "exact" for k in range(3)}


def test_exact_reading_does_not_rename_a_template_match(spark):
    item = "If 3 pens cost 12 euros then how much would the teacher of the small school near the river pay for 45 pens and 20 books"
    other = item.replace("45", "60").replace("20 books", "31 books").replace("12", "15")
    got = {r["doc_id"]: r["kind"] for r in de.contaminated(
        spark.createDataFrame([(1, item), (2, other)], "doc_id long, text string"),
        spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: "exact", 2: "reparameterised"}
