"""The driver's view of the queries."""

import __spark_entry__ as entry


def test_all_thirteen_operators_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if n[:2] == "op" and n[2:3].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
