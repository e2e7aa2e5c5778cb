"""Typed metadata: kinds, ties of kinds, hot keys and what reaches the scan."""

import pytest
from pyspark.sql import functions as F

from loomwright.operators import typed

META = ['{"n": 9, "s": "9", "b": true, "x": 1.5}', '{"n": 10, "s": "a", "b": false}', '{"n": 10.0, "x": 10}', '{"n": null, "b": 1}', "{}", None, '{"n": "10", "odd key.\\"s": 1}', "no json", '{"n": 9007199254740993}']


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(enumerate(META)), "id int, text string").select("id", typed.from_json(F.col("text")).alias("meta"))
    return typed.shredded(df, {"s": "string", "b": "boolean"})


def _ids(rows, field, op, value, hot=None):
    return [r.id for r in rows.where(typed.where_typed({"field": field, "operator": op, "value": value}, hot)).orderBy("id").collect()]


def test_numbers_compare_as_numbers(rows):
    assert _ids(rows, "n", "<", 10) == [0] and _ids(rows, "n", ">=", 9) == [0, 1, 2, 8] and _ids(rows, "meta.n", "==", 10) == [1, 2] and _ids(rows, "n", "==", "10") == [6]
    assert _ids(rows, "n", "in", [9, "10"]) == [0, 6] and _ids(rows, "n", "not in", [9, 10]) == [3, 4, 5, 6, 7, 8]
    assert _ids(rows, "n", "!=", 10) == [0, 3, 4, 5, 6, 7, 8] and _ids(rows, "n", "==", None) == [3, 4, 5, 7] and _ids(rows, "n", "!=", None) == [0, 1, 2, 6, 8]
    assert _ids(rows, "n", "==", 9007199254740993) == [8] and _ids(rows, "n", ">", 9007199254740992) == [8]
    assert _ids(rows, "x", "==", 1.5) == [0] and _ids(rows, "x", ">", 1.5) == [2] and _ids(rows, 'odd key."s', "==", 1) == [6]
    assert _ids(rows, "b", "==", True) == [0] and _ids(rows, "b", "==", 1) == [3]


def test_hot_keys_agree(rows):
    hot = {"s": "string", "b": "boolean"}
    for field, op, value in (("s", "==", "9"), ("s", "==", 9), ("s", ">", "9"), ("s", "!=", "9"), ("s", "==", None), ("b", "==", True), ("b", "!=", False), ("b", "in", [False, "x"])):
        assert _ids(rows, field, op, value, hot) == _ids(rows, field, op, value), (field, op, value)
    assert _ids(rows, "b", "==", 1, hot) == [] and _ids(rows, "b", "==", 1) == [3]  # a hot key holds values of its own kind only
    both = {"operator": "NOT", "conditions": [{"operator": "OR", "conditions": [{"field": "s", "operator": "==", "value": "9"}, {"field": "n", "operator": ">", "value": 9}]}]}
    assert [r.id for r in rows.where(typed.where_typed(both, hot)).orderBy("id").collect()] == [3, 4, 5, 6, 7]
    assert [r.id for r in rows.where(typed.where_equal({"n": [9, 10], "s": "a"}, hot)).collect()] == [1] and rows.where(typed.where_equal({})).count() == len(META)
    for bad in ({"field": "n", "operator": "~", "value": 1}, {"field": "n", "operator": "==", "value": object()}):
        with pytest.raises(ValueError):
            typed.where_typed(bad)


def test_hot_keys_reach_the_scan(spark, rows, tmp_path):
    rows.write.parquet(f"file://{tmp_path}/rows")
    back = spark.read.parquet(f"file://{tmp_path}/rows")
    found = back.where(typed.where_typed({"field": "s", "operator": ">=", "value": "9"}, {"s": "string"})).select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(meta_s,9)" in plan and sorted(r.id for r in found.collect()) == [0, 1]
    assert back.where(typed.where_typed({"field": "n", "operator": "<", "value": 10})).count() == 1


def test_structs(spark):
    rows = spark.range(3).select("id", typed.as_variant(F.struct("id", (F.col("id") / 4).alias("q"), F.lit(None).cast("string").alias("none"))).alias("meta"))
    assert _ids(rows, "q", ">=", 0.25) == [1, 2] and _ids(rows, "none", "==", None) == [0, 1, 2] and _ids(rows, "id", "in", [0, 2]) == [0, 2]
