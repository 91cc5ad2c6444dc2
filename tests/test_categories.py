"""The dictionary of categories, and vectors made with it."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from credence.operators import categories, preprocess


def test_dense_numbers_in_order(spark):
    rng = random.Random(1)
    columns = [[rng.choice("abcdefghijklmnopqrst") + rng.choice(["", "é", "Z", "\n"]) for _ in range(300)], ["same"] * 300, [None] * 300, [rng.choice([None, "", " ", "z"]) for _ in range(300)]]
    rows = spark.createDataFrame(list(zip(*columns)), "a string, b string, c string, d string")
    for ranges in (None, 7):
        held = categories.build_dictionary(rows, [F.col(c) for c in "abcd"], ranges=ranges)
        got = {(r["k"], r["value"]): r["number"] for r in spark.read.parquet(held.path).collect()}
        want = {(k, v): n for k, c in enumerate(columns) for n, v in enumerate(sorted({x for x in c if x is not None}, key=str.encode))}
        assert got == want and held.sizes == [len({x for x in c if x is not None}) for c in columns]


@pytest.mark.parametrize("sent", [categories.SENT_BYTES, 0])
def test_vectors_saved_and_read(spark, tmp_path, sent):
    train = spark.createDataFrame([(1.0, "b", "x y"), (2.0, "a", None), (3.0, None, "x y"), (4.0, "a", "z")], "n double, c string, `d.e` string")
    model = preprocess.fit_preprocessor(train)
    model.stages[-1]._set(sentBytes=sent)
    test = spark.createDataFrame([(2.5, "b", "z", 0), (2.5, "new", None, 1), (None, None, "x y", 2)], "n double, c string, `d.e` string, id int")
    model.write().overwrite().save(str(tmp_path / "model"))
    for held in (model, PipelineModel.load(str(tmp_path / "model"))):
        rows = {r["id"]: r["f"] for r in held.transform(test).select("id", vector_to_array("features").alias("f")).collect()}
        assert rows == {0: [0, 0, 1, 0, 1], 1: [0, 0, 0, 1, 0], 2: [0, 1, 0, 1, 0]}
        assert "_i0" not in held.transform(test).columns
        kinds = [type(held.transform(test.limit(0)).schema[c].dataType).__name__ for c in ("features", "n")]
        assert kinds == ["VectorUDT", "DoubleType"]
    plan = model.transform(test)._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == bool(sent)


def test_many_categories_are_warned_about(spark):
    rows = spark.range(1500).select(F.concat(F.lit("v"), "id").alias("c"), F.lit(1.0).alias("n"))
    with pytest.warns(UserWarning, match="`c` has 1500 categories"):
        model = preprocess.fit_preprocessor(rows)
    vector = model.transform(rows).filter("c = 'v1499'").first()["features"]
    assert vector.size == 1501 and vector.indices.tolist() == [0, 1 + sorted(f"v{k}" for k in range(1500)).index("v1499")]
