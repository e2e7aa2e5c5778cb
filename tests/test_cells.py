"""The clustered index against a full scan: equal rows, few cells read where vectors cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import cells, retrieve

SF = "/root/testdata/sf0.01"


def _rows(df, query="query_id", key="id"):
    return sorted((r[query], r["rank"], r[key], round(r["distance"], 9)) for r in df.collect())


def _table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x)], "id long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 10, (30, 16))
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(0, 0.4, (3000, 16))
    x[:900] = x[0]  # copies of one vector, and so one hot cell
    return x.astype(np.float32)


def test_few_cells_and_equal_results(spark, tmp_path, clustered, monkeypatch):
    monkeypatch.setattr(cells, "FILE_ROWS", 200)
    monkeypatch.setattr(cells, "QUERIES", 40)
    rows = _table(spark, clustered).withColumn("extra", F.lit("x"))
    asked = rows.where("id % 20 = 0 or id > 2990").select((F.col("id") + 7).alias("query_id"), F.col("embedding").alias("query_embedding"))
    own = cells.CellIndex.build(rows, f"file://{tmp_path}/index", 16)
    for k in (1, 5, 40):
        got, share = own.nearest(asked, k)
        assert _rows(got) == _rows(retrieve.nearest(rows, asked, k))
        assert share < 0.15
    again = cells.CellIndex(spark, f"file://{tmp_path}/index")
    assert again.size.sum() == 3000 and again.size.max() >= 900
    # A query's pass reads the partitions of few cells only.
    to_centre = np.sqrt(((clustered[2000] - again.centres) ** 2).sum(1))[None]
    assert (again.bounds(to_centre) < 3).sum() <= 5
    files = spark.read.parquet(f"file://{tmp_path}/index/rows")
    assert "extra" in files.columns and len(files.inputFiles()) > 20


def test_evenly_spread_vectors(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    got, share = cells.CellIndex.build(vectors, f"file://{tmp_path}/even", 64, key="vec_id").nearest(asked, 5, key="vec_id")
    assert _rows(got, key="vec_id") == _rows(retrieve.nearest(vectors, asked, 5, key="vec_id"), key="vec_id")
    assert share > 0.5  # nothing is near anything, so no bound rules a cell out


def test_odd_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.0, 0.0], 4), (2, [1.0, None], 4), (3, None, 4), (4, [float("nan"), 1.0], 4), (5, [0.0, 0.0], 4), (5, [0.0, 0.0], 4), (6, [3.0, 4.0], 4)], "id long, embedding array<double>, reach int")
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [3.0, 4.0])], "query_id long, query_embedding array<double>")
    own = cells.CellIndex.build(rows, f"file://{tmp_path}/odd", 2)
    want = [(1, 1, 1, 0.0), (1, 2, 5, 0.0), (1, 3, 5, 0.0), (3, 1, 6, 0.0), (3, 2, 1, 25.0), (3, 3, 5, 25.0)]
    assert _rows(own.nearest(asked, 3)[0]) == want == _rows(retrieve.nearest(rows, asked, 3))
    assert len(_rows(own.nearest(asked, 9)[0])) == 8 == len(_rows(retrieve.nearest(rows, asked, 9)))
    assert _rows(own.nearest(asked.limit(0), 3)[0]) == []
    none = cells.CellIndex.build(rows.limit(0), f"file://{tmp_path}/none", 2)
    assert _rows(none.nearest(asked, 3)[0]) == []


def test_bad_vectors_are_told(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0, 1.0]), (2, [0.0] * 5), (3, [0.0, 0.0, 0.0, None]), (4, [0.0] * 4), (5, None)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [0.0] * 4)], "query_id long, query_embedding array<double>")
    with pytest.raises(Exception, match="dimensions"):
        retrieve.nearest(rows, asked, 2).collect()
    told = {r.id: r.why for r in rows.select("id", retrieve.vector_error(F.col("embedding"), 4).alias("why")).collect()}
    assert told[4] is None and "3 dimensions" in told[1] and "finite" in told[3] and told[5] == "no vector"
    assert [(r.id, r.distance) for r in retrieve.nearest(rows.where("id >= 3"), asked, 2).collect()] == [(4, 0.0)]
    with pytest.raises(ValueError, match="differ"):
        retrieve.nearest(rows, rows.where("id in (1, 4)").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding")), 2)
    with pytest.raises(ValueError, match="finite"):
        retrieve.nearest(rows, spark.createDataFrame([(1, [float("inf")] * 4)], "query_id long, query_embedding array<double>"), 2)


def test_batch_bytes_in_any_unit(spark):
    from loomwright.session import BATCH_BYTES, BATCH_KEY, ship

    old = spark.conf.get(BATCH_KEY)
    for value, left in (("64m", str(BATCH_BYTES)), ("1g", str(BATCH_BYTES)), ("65536b", "65536b"), ("4mb", "4mb"), ("1000", "1000")):
        spark.conf.set(BATCH_KEY, value)
        ship(spark)
        assert spark.conf.get(BATCH_KEY) == left
    spark.conf.set(BATCH_KEY, old)
