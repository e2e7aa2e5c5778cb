"""Operators do the whole job: nothing is capped, cut off or left out by size."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright.llm import context_tree, mixing, near_dedup, quality_rules, queries
from loomwright.llm.vectext import as_bytes


def _tree_scores(texts, taught):
    """Scores by one ContextTree over all strings of the texts that teach."""
    keys, of = context_tree.padded(*as_bytes(pa.array(texts)))
    seen = keys[np.isin(of, np.flatnonzero(taught))]
    tree = context_tree.ContextTree([np.unique(seen & np.uint64((1 << (8 * (k + 1))) - 1), return_counts=True) for k in range(context_tree.DEPTH + 1)])
    return np.bincount(of, tree.log_prob(keys), minlength=len(texts)) / np.log(10)


def test_every_context_scores(spark, monkeypatch):
    rng = np.random.default_rng(6)
    letters = np.frombuffer(b"abcdefghij klmnop", np.uint8)
    texts = [rng.choice(letters, 30_000).tobytes().decode() for _ in range(14)]
    texts += [texts[0][:5000], texts[1][7000:9000] + "xyz é", "", "a"]
    taught = np.arange(len(texts)) < 12
    want = _tree_scores(texts, taught)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert len(set().union(*({t[k : k + 6] for k in range(len(t) - 5)} for t in texts[:12]))) > 1 << 18
    for most in (1 << 22, 150_000):  # one pass over the texts, and several
        monkeypatch.setattr(context_tree, "TABLE", most, raising=False)
        got = {r.doc_id: r.score for r in context_tree.score(df, F.col("doc_id") < 12).collect()}
        assert np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-5)


def test_language_model_query_by_one_tree(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    taught = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for r in rows])
    want = _tree_scores([r.text for r in rows], taught)
    got = {r.doc_id: r.score for r in queries.op7_language_model(spark, sf).collect()}
    assert np.allclose([got[r.doc_id] for r in rows], want, rtol=1e-5)


def test_no_byte_of_a_text_ends_it():
    keys = context_tree.padded(*as_bytes(pa.array(["a\u0000b\u0000", "", None, "é"])))[0]
    assert [int(k) & 255 for k in keys] == [97, 0, 98, 0, 255, 255, 255, 0xC3, 0xA9, 255]
    assert [int(k) >> 8 & 255 for k in keys] == [0, 97, 0, 98, 0, 0, 0, 0, 0xC3, 0xA9]


def test_one_long_text_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(8)
    text = " ".join("".join(chr(97 + k) for k in rng.integers(0, 9, rng.integers(1, 8))) for _ in range(9000)) + " é\U0001f600"
    df = spark.createDataFrame([(1, text, "en"), (2, text[:40], "en")], "doc_id long, text string, lang string")
    found = []
    for piece in (1 << 20, 4099):
        for module in (context_tree, quality_rules):
            monkeypatch.setattr(module, "PIECE", piece)
        scored = context_tree.score(df, F.col("doc_id") > 0).select("doc_id", "score", "base_score", "n_tokens")
        both = scored.join(quality_rules.score(df, quality_rules.train(df)).select("doc_id", "nll", "n_grams", "n_repeat_words"), "doc_id")
        found.append([[x for x in r] for r in both.orderBy("doc_id").collect()])
    assert np.allclose(found[0], found[1], rtol=1e-6)


def test_bands_reject_labelled_junk_in_each_language(spark):
    sf = "/root/testdata/sf0.1"
    judged = queries.op3_quality_rules(spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    kept = {(r.lang, r.quality): r.share for r in judged.join(langs, "doc_id").groupBy("lang", "quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert all(kept[lang, 1] > 0.99 for lang in ("en", "de", "fr", "es"))
    assert all(kept[lang, 0] < most for lang, most in (("en", 0.2), ("de", 0.3), ("fr", 0.45), ("es", 0.5)))


@pytest.mark.parametrize("text", ["two words", "three short words", "one", ""])
def test_a_batch_of_one_short_text(spark, text):
    both = near_dedup.shingle_sets(*as_bytes(pa.array([text, "here are more words than a shingle has"])), 5)
    alone = near_dedup.shingle_sets(*as_bytes(pa.array([text])), 5)
    assert np.array_equal(alone[0], both[0][: both[1][1]])
    rows = near_dedup.near_duplicates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_shingles, r.kept) for r in rows] == [(1, int(text != ""), True)]


def test_fit_of_long_documents():
    def got(lengths, counts, budget):
        take = mixing.fit_lengths(np.array(lengths), np.array(counts), budget)
        assert (take >= 0).all() and (take <= counts).all()
        return int((take * lengths).sum())

    assert got([61_000, 60_000], [1, 1], 84_000) == 61_000
    assert got([61_000, 55_000], [1, 2], 110_000) == 110_000
    rng = np.random.default_rng(5)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 200_000, rng.integers(1, 9)))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        assert 0 <= budget - got(lengths, counts, budget) < max(lengths.max(), 1)
