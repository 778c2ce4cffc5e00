"""Slot values of word problems in texts with capitalised units."""

from capstan.llm import decontaminate as de
from tests.llm.conftest import prose

ITEM = "A train leaves Berlin at 9 km from the coast and meets Anna after 45 minutes on the long bridge near the old mill"


def test_a_capitalised_unit_far_away_leaves_the_slots_alone(spark):
    far = f"He slept 24 Hours, ran 10 Km, 24h30 for 100 Years and 50 Percent more. {prose(8, 60)}"
    other = ITEM.replace("45", "30").replace("9", "12").replace("Berlin", "Lisbon").replace("Anna", "Maria")
    docs = spark.createDataFrame([(1, f"{far} {ITEM}"), (2, f"{far} {other}"), (3, far)], "doc_id long, text string")
    got = {r["doc_id"]: r["kind"] for r in de.contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()}
    assert got == {1: "exact", 2: "reparameterised"}


def test_tokens_carry_their_values():
    assert de.tokens_of("It took 24 Hours or 1.5 kg, 7% of Rome") == [
        "it", "took", "24", "hours", "or", "1.5", "kg", "7", "%", "of", "rome"]
