"""Benchmark items without an id are hits all the same."""

import pytest

from measurelake.llm import decontaminate


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_KEYS, 0])
def test_null_item_ids(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    docs = spark.createDataFrame([(1, "x one two three four y"), (2, "foo bar one two three four"), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three four"), (None, None), (7, "foo bar")], "item_id long, text string")
    got = decontaminate.contamination(docs, bench).select("doc_id", "n_hit", "n_items", "items", "contaminated").collect()
    assert sorted(map(tuple, got)) == [(1, 4, 0, [], True), (2, 6, 1, ["7"], True), (3, 0, 0, [], False)]
