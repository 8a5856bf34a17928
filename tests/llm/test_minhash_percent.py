"""Similarities that the key layout can't hold."""

import pytest

from peakloom.llm import minhash


def test_low_percents_are_rejected(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for percent in (50, 60, 77):
        with pytest.raises(ValueError, match="missed"):
            minhash.near_duplicates(none, percent=percent)
    assert minhash.miss_chance(80) < 2e-7 and minhash.miss_chance(60) == pytest.approx(0.0072, rel=0.01)


def test_held_percents_are_answered(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in minhash.near_duplicates(rows, percent=80).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
