import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import embed, index, rag, retrieve
from loomwright.schemas import EmbeddingSettings, LLMSettings, RetrievalSettings, merged, resolve

SF = "/root/testdata/sf0.01"


def test_known_neighbours(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    one = vectors.where("vec_id = 0").select(F.lit(1).alias("query_id"), F.col("embedding").alias("query_embedding"))
    rows = retrieve.with_score(retrieve.nearest(vectors, one, 5, key="vec_id")).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [0, 365, 334, 387, 423]
    assert [round(r.score, 6) for r in rows] == [1.0, 0.369994, 0.362722, 0.331139, 0.296934]
    assert [r.rank for r in retrieve.over_threshold(retrieve.with_score(retrieve.nearest(vectors, one, 5, key="vec_id")), 0.35).orderBy("rank").collect()] == [1, 2, 3]


def test_queries_in_blocks_agree(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    whole, parts = (set(map(tuple, retrieve.nearest(vectors, asked, 3, key="vec_id", block=b).select("query_id", "rank", "vec_id").collect())) for b in (4096, 100))
    assert whole == parts and len(whole) == 1500


def test_memory_of_many_queries_is_bounded():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(3000, 8)), rng.normal(size=(4000, 8))
    for metric in ("l2sq", "cosine"):
        tracemalloc.start()
        row, col, exact = retrieve.best_of(q, x, pa.array(np.arange(4000)), 5, metric)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20  # all products at once are 96 MB, and several such tables were held
        tracemalloc.stop()
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        d = ((q[:50, None] - x[None]) ** 2).sum(2) if metric == "l2sq" else 1 - unit(q[:50]) @ unit(x).T
        assert (row == np.repeat(np.arange(3000), 5)).all() and (col[:250].reshape(50, 5) == np.argsort(d, axis=1)[:, :5]).all()
    assert [len(a) for a in retrieve.best_of(q[:0], x, pa.array(np.arange(4000)), 5)] == [0, 0, 0]


@pytest.mark.parametrize("dimensions, rows", [(64, 10000), (1536, 682)])
def test_memory_of_copies_is_bounded(dimensions, rows):
    """Copies of a vector tie, so all of a batch's rows are measured for each query."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(500, dimensions)), np.repeat(rng.normal(size=(1, dimensions)), rows, 0)
    for metric in ("l2sq", "cosine"):
        tracemalloc.start()
        row, col, _ = retrieve.best_of(q, x, pa.array(np.arange(rows)[::-1]), 5, metric)
        assert tracemalloc.get_traced_memory()[1] < 48 << 20
        tracemalloc.stop()
        assert (row == np.repeat(np.arange(500), 5)).all() and (col == np.tile(rows - 1 - np.arange(5), 500)).all()


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_copies_tie_by_key_across_batches(spark, metric):
    """A copy alone in its batch has the distance of one among many, so the smaller key is first."""
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(700, 64))]
    schema = "id long, embedding array<double>"
    alone = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(vectors[:60])), 60), schema)
    many = spark.createDataFrame(spark.sparkContext.parallelize([(1000 + i, v) for i, v in enumerate(vectors)], 1), schema)
    asked = spark.createDataFrame([(i, [x + float(e) for x, e in zip(v, rng.normal(size=64) / 10)]) for i, v in enumerate(vectors[:60])], "query_id long, query_embedding array<double>")
    hits = retrieve.nearest(alone.union(many), asked, 2, metric=metric).orderBy("query_id", "rank").collect()
    assert [(h.query_id, h.id) for h in hits] == [(i, i + 1000 * r) for i in range(60) for r in (0, 1)]
    assert all(a.distance == b.distance for a, b in zip(hits[::2], hits[1::2]))


def test_empty_index_and_null_vectors(spark):
    rows = spark.createDataFrame([(1, None), (2, [1.0, 0.0])], "id long, embedding array<float>")
    asked = spark.createDataFrame([(7, [0.0, 1.0]), (8, None)], "query_id long, query_embedding array<float>")
    assert [(r.query_id, r.id) for r in retrieve.nearest(rows, asked, 3).collect()] == [(7, 2)]
    assert retrieve.nearest(rows.limit(0), asked, 3).count() == 0


def test_scores(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (1.0,), (2.0,), (3.0,)], "d double").select(T.score_of(F.col("d"))).collect()
    assert [r[0] for r in rows] == [0.5, 1.0, 0.5, 0.0, 0.0]


def test_diversity(spark):
    rows = [(1, 1, "a b c d", 0.9), (1, 2, "a b c e", 0.8), (1, 3, "x y z", 0.75), (1, 4, "a b c d", 0.7), (2, 1, "", 0.4)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, content string, score double")
    got = retrieve.diversify(hits, 0.5).where("query_id = 1").orderBy("rank").collect()
    assert [(round(r.score, 4), r.old_rank) for r in got] == [(0.9, 1), (0.75, 3), (0.56, 2), (0.35, 4)]
    assert retrieve.diversify(hits, 0) is hits


def test_filters(spark):
    rows = spark.createDataFrame([(1, "a", {"k": "1"}), (2, "b", {}), (3, None, {"k": "2"})], "id int, domain string, meta map<string,string>")
    ids = lambda c: sorted(r.id for r in rows.where(c).collect())
    assert ids(retrieve.where({}, ["domain"])) == [1, 2, 3] and ids(retrieve.where({"domain": ["a", "b"]}, ["domain"])) == [1, 2]
    assert ids(retrieve.where_meta({"k": None}, F.col("meta"))) == [2]
    assert ids(retrieve.where_tree({"field": "domain", "operator": "!=", "value": "a"}, ["domain"])) == [2, 3]
    with pytest.raises(ValueError):
        retrieve.where_tree({"field": "domain", "operator": "~", "value": "a"})


def test_batches():
    got = embed.embed_batch(["Hello", "", "World"])
    assert np.allclose(np.linalg.norm(got, axis=1), [1, 0, 1]) and embed.embed_batch([]).shape[0] == 0
    with pytest.raises(embed.EmbeddingError):
        embed.embed_batch(["", " "])


def test_embed_distinct(spark):
    rows = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    one, other = (sorted(map(str, f(rows, "t").collect())) for f in (embed.embed, embed.embed_distinct))
    assert one == other


def test_upserts(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "id string, v int")
    b = spark.createDataFrame([("y", 2), ("z", 2), ("z", 3)], "id string, v int")
    values = lambda policy: {(r.id, r.v) for r in index.upsert(a, b, policy).collect()}
    assert values("overwrite") == {("x", 1), ("y", 2), ("z", 2)} and values("skip") == {("x", 1), ("y", 1), ("z", 2)}
    with pytest.raises(index.DuplicateError):
        index.upsert(a, b, "fail")


def test_collections(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", [1.0], {"title": "t", "none": None}), ("c2", [2.0], None), ("", [0.0], {})], "content string, embedding array<float>, metadata map<string,string>")
    rows = index.prepare(chunks)
    one, other = (index.Collection(spark, f"file://{tmp_path}", n) for n in ("one", "other"))
    assert one.stats()["document_count"] == 0
    assert one.write(rows) == 3 and one.write(rows) == 3 and one.stats()["document_count"] == 3 and not other.stats()["has_documents"]
    assert one.read().where("title = 't'").first().meta == {"title": "t"}
    one.clear()
    assert one.read().count() == 0


def test_context_and_chat(spark):
    hits = spark.createDataFrame([(1, 1, "one", None, "T", "H"), (1, 2, "two", "C", "T", None)], "query_id int, rank int, content string, component string, title string, heading string")
    assert rag.context(hits).first().context == "--- Source: T > H ---\none\n\n--- Source: C ---\ntwo"
    talk = spark.createDataFrame([(1, 1, "system", "A"), (1, 2, "user", "q"), (1, 3, "system", "B"), (1, 4, "assistant", "r")], "conv_id int, turn int, role string, text string")
    row = rag.chat(talk).first()
    assert (row.system, row.conversation, row.n_messages) == ("A\n\nB", "user: q\nassistant: r", 2)


def test_settings(monkeypatch):
    monkeypatch.setenv("SOME_KEY", "v")
    assert resolve({"a": "${SOME_KEY}", "b": {"c": "${NONE_SUCH}"}, "d": "x${SOME_KEY}"}) == {"a": "v", "b": {"c": None}, "d": "x${SOME_KEY}"}
    assert merged(EmbeddingSettings, {"dimensions": 8}, dimensions=16).dimensions == 16
    assert LLMSettings(top_p=0.5).request()["top_p"] == 0.5 and "top_p" not in LLMSettings().request()
    for bad in (lambda: RetrievalSettings(top_k=0), lambda: RetrievalSettings(diversity_factor=2), lambda: LLMSettings(temperature=2), lambda: EmbeddingSettings(dimensions=0)):
        with pytest.raises(ValueError):
            bad()
    assert RetrievalSettings(filters={"a": 1}).with_call(3, {"b": 2}) == RetrievalSettings(top_k=3, filters={"a": 1, "b": 2})


def test_nearest_of_far_vectors_and_of_ties(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=32) * 7000  # long vectors that differ by little: the product alone cannot rank them
    close = base + rng.normal(size=(600, 32)) * 1e-3
    same = np.repeat(close[:1], 300, axis=0)
    vectors = np.concatenate([close, same])
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<double>").repartition(3)
    asked = rows.where("id % 60 = 0").selectExpr("id AS query_id", "embedding AS query_embedding")
    got = {}
    for r in retrieve.nearest(rows, asked, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q, found in got.items():
        d = ((vectors - vectors[q]) ** 2).sum(1)
        assert [i for _, i in sorted(found)] == sorted(range(len(vectors)), key=lambda i: (d[i], i))[:5]


def test_one_of_two_writers_tries_again(spark, tmp_path):
    from loomwright.operators import index

    def rows(*texts):
        return index.prepare(spark.createDataFrame([(t, [1.0], {"domain": "d"}) for t in texts], "content string, embedding array<float>, metadata map<string,string>"))

    own = index.Collection(spark, str(tmp_path), "c")
    assert own.status()["status"] == "empty" and own.write(rows("a", "b")) == 2 and own.status()["status"] == "ready"
    base = own.version()
    own.write(rows("c"))
    with pytest.raises(index.Conflict):  # a version that another has followed already
        own._publish(rows("lost"), base)
    assert sorted(r.content for r in own.read().collect()) == ["a", "b", "c"]
    for k in range(3):
        own.write(rows(f"d{k}"))
    kept = [p.name for p in (tmp_path / "collection=c").iterdir()]
    assert sum(n.startswith("v-") for n in kept) == 2 and not any(n.startswith("STAGED") for n in kept)
    assert own.replace(rows("z", "z")) == 2 and [r.content for r in own.read().collect()] == ["z"]
    own.drop()
    assert own.version() is None


def test_provider_with_dimensions_of_its_own(spark):
    from loomwright.operators import embed
    from loomwright.schemas import EmbeddingSettings

    class Three:
        def encode(self, texts):
            return np.ones((len(texts), 3))

    got = embed.encode_texts(["a", None, " ", "b"], EmbeddingSettings(dimensions=64, batch_size=1), Three())
    assert got.shape == (4, 3) and got[1].sum() == 0 and np.isclose(np.linalg.norm(got[3]), 1)
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "n long, content string")
    assert [r.n for r in embed.embed_sample(rows, ["n"], 2).orderBy("n").collect()] == [1, 2]


def test_words_never_cancel():
    from loomwright.schemas import EmbeddingSettings

    model = embed.HashedWords(EmbeddingSettings(dimensions=2))
    words = [f"w{i}" for i in range(20)]
    pairs = [f"{a} {b}" for a in words for b in words if a < b]  # in 2 dimensions many share a cell with opposite signs
    assert (np.abs(model.encode(pairs)).sum(1) > 0).all() and not model.encode([""]).any()


def test_rows_are_shuffled_once_a_strip(spark):
    rows = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k) for k in (1, 2, 3))).alias("embedding"))
    pairs = embed.similarity_matrix(rows, block=16, least=0.999)
    x = np.sin(np.arange(4000)[:, None] * np.array([1, 2, 3]))
    x = x[1:] / np.linalg.norm(x[1:], axis=1, keepdims=True)
    assert pairs.count() == ((x @ x.T) >= 0.999).sum()
    dealt = pairs._jdf.queryExecution().analyzed().toString()
    strips = int(re.search(r"sequence\(0, (\d+)", dealt)[1]) + 1
    assert strips < 10  # 250 blocks of 16 rows, each of which every row was copied for


def test_strips_meet_in_tasks_of_their_own(spark):
    rows = spark.range(600).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k) for k in (1, 2, 3))).alias("embedding"))
    counts = [r["count"] for r in embed.similarity_matrix(rows, block=16).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 600**2 and max(counts) < 0.25 * 600**2  # two strips have 8 % of the pairs


def test_similarity_by_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5))
    x[7] = 0
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    norms = np.linalg.norm(x, axis=1)
    want = {(a, b): None if 7 in (a, b) else x[a] @ x[b] / (norms[a] * norms[b]) for a in range(90) for b in range(90)}
    for block in (1024, 20):
        got = {(r.a, r.b): r.cosine for r in embed.similarity_matrix(df, block=block).collect()}
        assert got.keys() == want.keys() and all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in want.items())
        near = {(r.a, r.b) for r in embed.similarity_matrix(df, block=block, least=0.6).collect()}
        assert near == {k for k, v in want.items() if v is not None and v >= 0.6}
    assert embed.similarity_matrix(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="differ"):
        embed.similarity_matrix(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<double>"))


def test_a_matrix_holds_a_number_for_two_orders(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1203, 64))
    x[5], x[6] = 0, -x[8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    embed.similarity_matrix(df, block=64, digits=6).write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 5.5 * len(x) ** 2  # 8 bytes a row if each order has its own
    rows = pq.read_table(tmp_path / "out")
    got = rows.to_pandas()
    unit = x / np.where((norms := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, norms)
    matrix = np.full((len(x), len(x)), np.inf)
    matrix[got.a, got.b] = got.cosine
    assert len(got) == len(x) ** 2 and not np.isinf(matrix).any()
    assert (np.isnan(matrix) == ((norms == 0) | (norms == 0).T)).all() and rows["cosine"].null_count == np.isnan(matrix).sum()
    assert matrix[6, 8] == -1 and np.nanmax(abs(matrix - unit @ unit.T)) < 5.001e-7 and (np.nan_to_num(matrix) == np.round(np.nan_to_num(matrix), 6)).all()
