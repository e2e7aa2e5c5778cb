"""The index that merges on read: values, what a write costs, which files stay, and other writers."""

import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import deltas, index


def _prepared(spark, texts, value=0.0):
    rows = spark.createDataFrame([(t, [float(value)], {"domain": t[:1]}) for t in texts], "content string, embedding array<float>, metadata map<string,string>")
    return index.prepare(rows)


def _read(own):
    return {r.content: r.embedding[0] for r in own.read().collect()}


def _paths(root, prefix):
    return {str(p.relative_to(root)) for p in root.rglob("*.parquet") if p.relative_to(root).parts[0].startswith(prefix)}


def test_as_a_dictionary(spark, tmp_path):
    rng = random.Random(5)
    own, want = deltas.DeltaCollection(spark, f"file://{tmp_path}", "c", buckets=4, most_deltas=3), {}
    texts = [f"{c}{k}" for c in "abc" for k in range(8)]
    for turn in range(9):
        some = rng.sample(texts, rng.randint(1, 9))
        way = rng.choice(("overwrite", "overwrite", "skip", "delete", "compact", "fail"))
        if way in ("overwrite", "skip"):
            assert own.write(_prepared(spark, some + some[:1], turn), way) == len(some) + 1
            want |= {t: float(turn) for t in some if way == "overwrite" or t not in want}
        elif way == "fail" and (shared := set(some) & set(want)):
            with pytest.raises(index.DuplicateError):
                own.write(_prepared(spark, some), way)
            assert shared
        elif way == "delete":
            own.delete(_prepared(spark, some))
            want = {t: v for t, v in want.items() if t not in some}
        elif way == "compact":
            own.compact()
        assert _read(own) == want
    assert own.stats()["document_count"] == len(want)
    own.clear()
    assert _read(own) == {} and own.status()["status"] == "empty"
    assert own.replace(_prepared(spark, ["z", "z", "y"])) == 3 and set(_read(own)) == {"z", "y"}


def test_a_write_moves_nothing_that_is_stored(spark, tmp_path):
    own, root = deltas.DeltaCollection(spark, f"file://{tmp_path}", "c", buckets=8), tmp_path / "collection=c"
    own.write(_prepared(spark, [f"a{k}" for k in range(200)]))
    own.compact()
    base = _paths(root, "b-")
    assert len(base) == 8
    own.write(_prepared(spark, ["a1"], 5))
    assert _paths(root, "b-") == base and len(_paths(root, "d-") - {p for p in _paths(root, "d-") if "bucket" not in p}) >= 1
    own.compact()
    after = _paths(root, "b-")
    listed = own._list(own.version())
    assert len(base & after) == 8  # a reader of the version before still has its files
    moved = {b for b, folder in listed["base"].items() if not any(p.startswith(folder) for p in base)}
    assert len(moved) == 1 and not listed["deltas"]
    assert _read(own)["a1"] == 5.0 and len(_read(own)) == 200
    own.write(_prepared(spark, ["a2"], 6))
    own.compact()
    gone = base - _paths(root, "b-")
    assert all(f"bucket={b}/" in p for p in gone for b in moved) and gone  # two versions on, the bucket that moved is deleted
    assert not any(p.name.startswith("STAGED") for p in root.iterdir())


def test_two_writers(spark, tmp_path):
    one, other = (deltas.DeltaCollection(spark, f"file://{tmp_path}", "c", buckets=2) for _ in range(2))
    one.write(_prepared(spark, ["a", "b"]))
    base = one.version()
    other.write(_prepared(spark, ["c"]))
    with pytest.raises(index.Conflict):
        one._publish_list(one._list(base), base)
    # A writer that begins on an old version meets the other's rows when it tries again.
    turns = iter([base])
    fresh = one.version
    one.version = lambda: next(turns, None) or fresh()
    one.write(_prepared(spark, ["c", "d"], 9), "skip")
    assert _read(other) == {"a": 0.0, "b": 0.0, "c": 0.0, "d": 9.0}


def test_reads_prune_and_push(spark, tmp_path):
    own = deltas.DeltaCollection(spark, f"file://{tmp_path}", "c", buckets=2)
    own.write(_prepared(spark, ["a", "b"]))
    own.compact()
    plan = own.read().where("domain = 'a'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(domain,a)" in plan and "content" not in plan.split("ReadSchema")[1]
    own.delete(own.read().where(F.col("domain") == "a"))
    assert [r.content for r in own.read().collect()] == ["b"]


def test_a_row_is_shuffled_once(spark, tmp_path):
    body = "".join(chr(33 + (i * 7919 + i * i) % 90) for i in range(4000))
    chunks = spark.range(200).select(F.concat(F.lit(body), F.col("id").cast("string")).alias("content"), F.array(F.lit(0.0).cast("float")).alias("embedding"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("metadata"))
    rows = index.prepare(chunks.unionByName(chunks))
    one = index.one_a_key(rows)
    assert one.count() == 200 and one.dtypes == rows.dtypes and {r.meta["k"] for r in one.collect()} == {str(i) for i in range(200)}
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan  # which keeps a row and its order, the same columns twice
    own = deltas.DeltaCollection(spark, f"file://{tmp_path}", "n", buckets=2)
    own.write(rows)
    own.write(rows)
    assert "max_by" not in own.read().select("id")._jdf.queryExecution().optimizedPlan().toString() and own.read().count() == 200
