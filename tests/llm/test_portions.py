"""Portions of rows bounded by bytes."""

import random

import pyarrow as pa

from capstan.llm import common, ngram_join


def test_portions_hold_the_rows_in_order_and_few_bytes():
    rnd = random.Random(3)
    texts = [rnd.choice([None, "", "x" * rnd.randrange(400), "y" * 5000]) for _ in range(3000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k:k + 700], pa.string())], ["t"]) for k in range(0, 3000, 700)]
    got = [b.column("t").to_pylist() for b in common.byte_portions(batches, "t", 2000)]
    assert sum(got, []) == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 2000 for p in got)


def test_tables_of_whole_groups_hold_few_bytes():
    rnd = random.Random(4)
    rows = sorted((rnd.randrange(400), b"z" * rnd.choice([0, 10, 900])) for _ in range(4000))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k:k + 300]]), pa.array([r[1] for r in rows[k:k + 300]], pa.binary())], ["k", "x"])
               for k in range(0, 4000, 300)]
    got = [t.to_pylist() for t in ngram_join.groups_of(batches, ["k", "x"], ["k"], "x", 100, 20_000)]
    assert [(r["k"], r["x"]) for t in got for r in t] == rows
    keys = [{r["k"] for r in t} for t in got]
    assert sum(map(len, keys)) == len(set().union(*keys))          # no group is cut
    assert all(len(k) == 1 or len(t) <= 100 and sum(len(r["x"]) for r in t) <= 20_000 for k, t in zip(keys, got))
