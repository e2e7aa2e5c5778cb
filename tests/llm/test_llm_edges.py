"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwright.llm import context_tree, decontamination, labelled, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, token_count, toxicity
from loomwright.llm.queries import _vocabulary

LONG = "word " * 30000 + "token = abcdef123456\n" + "é" * 5000
BODY = "The quick brown fox jumps over the lazy dog and runs far away from here\nthen it rests near the old mill. "
ROWS = [
    (1, BODY, "en", "a"), (1, BODY, "en", "a"), (2, BODY, None, None), (3, None, "en", "a"), (4, "", None, "b"), (5, " \n\t ", "en", "b"), (None, BODY + "x", "en", "a"), (None, None, None, None),
    (6, LONG, "en", "a"), (6, "other text with the same id and ten words in it now", "de", "c"), (7, "one", "en", "c"), (8, "one", "en", "c"), (-9, "\u0000 odd \x1f bytes \U0001f600 end", "en", ""),
]
#: Names that results or helpers use, as columns of the input.
CLASHES = ["score", "kept", "n_words", "nll", "copies", "target", "host", "line", "items", "n_tokens", "label", "rare", "mix_hash", "cut_lines", "key", "cls", "h", "size_", "candidate_id"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHES))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "brown fox jumps over the lazy dog and runs far away"), (2, None), (3, ""), (None, "one"), (4, "same id"), (4, "SAME ID")], "item_id long, text string")


def both(df):
    return df, df.limit(0)


def test_quality(docs):
    for d in both(docs):
        scored = quality_rules.score(d, quality_rules.train(d), prefix="q_")
        assert quality_rules.verdict(scored, "q_").count() == d.count()
        assert quality_rules.filter_quality(d).columns == d.columns
    kept = [r.doc_id for r in quality_rules.filter_quality(docs).collect()]
    assert 3 not in kept and 4 not in kept and kept.count(1) == 2


def test_lines(docs):
    for d in both(docs):
        for most in (1000, 0):
            out = line_dedup.drop_boilerplate(d, ratio=0.3, least_pages=2, n_lines="nl", n_dropped="nd", most=most)
            assert out.count() == d.count() and out.columns[: len(d.columns)] == d.columns
    one, other = (sorted(map(str, line_dedup.drop_boilerplate(docs, ratio=0.3, least_pages=2, most=m).collect())) for m in (1000, 0))
    assert one == other
    rows = line_dedup.drop_boilerplate(docs, ratio=0.3, least_pages=2, n_lines="nl", n_dropped="nd").collect()
    assert {(r.doc_id, r.nl, r.nd) for r in rows if r.doc_id in (1, 3, 4)} == {(1, 2, 2), (3, 0, 0), (4, 1, 0)}


def test_near(docs):
    for d in both(docs):
        out = near_dedup.near_duplicates(d)
        assert out.count() == d.count()
        assert near_dedup.keep_one(d).columns == d.columns
    rows = near_dedup.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id in (1, 2, 3, 7, 8)} == {(1, 1, True), (2, 1, False), (3, 3, True), (7, 7, True), (8, 7, False)}
    kept = [r.doc_id for r in near_dedup.keep_one(docs).collect()]
    assert kept.count(1) == 1 and kept.count(6) == 2 and 2 not in kept


def test_leaks(docs, bench):
    for d in both(docs):
        for b in both(bench):
            assert decontamination.mark_hits(d, b, prefix="p_").count() == d.count()
    rows = {(r.doc_id, r.p_n_words, r.p_n_hit, tuple(r.p_items)) for r in decontamination.mark_hits(docs, bench, prefix="p_").collect()}
    assert (1, 22, 11, ("1",)) in rows and (3, 0, 0, ()) in rows and (6, 12, 2, ("4",)) in rows


def test_mix(docs):
    sized = docs.withColumn("size", mixing.n_words(F.col("text")))
    for d in both(sized):
        out = mixing.mix(d)
        assert out.count() == d.count()
    rows = mixing.mix(sized).collect()
    assert all(0 <= r.copies <= 2 for r in rows) and {r.copies for r in rows if r.source == "c"} == {2}


def test_rowwise(docs):
    for d in both(docs):
        assert token_count.count_tokens(d, _vocabulary()).count() == d.count()
        assert secret_scan.scan(d).count() == d.count()
        assert context_tree.score(d, F.col("doc_id") > 1).count() == d.count()
    rows = context_tree.score(docs, F.lit(False)).where("doc_id = 3").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(1, 0, 0)]
    assert [r.n_tokens for r in token_count.count_tokens(docs, _vocabulary()).where("doc_id in (3, 4)").collect()] == [0, 0]


def test_classifiers(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0), (7, 0)], "doc_id long, y int")
    for op in (toxicity, quality_classifier):
        for d in both(docs):
            for lab in both(labels):
                sample, sizes = labelled.labelled_sample(d, lab, "y", F.lit(True), 5)
                scored = op.score(d, op.train(sample, sizes))
                assert scored.count() == d.count() and scored.where("not score between 0 and 1").count() == 0
    assert toxicity.offending_sentences(docs, toxicity.NoisyOr(__import__("numpy").zeros(toxicity.BUCKETS, "f4"), 3.0)).where("doc_id = 3").count() == 0


def test_values_of_odd_rows(docs):
    """Long, null, odd and repeated rows by hand."""
    stats = {(r.doc_id, r.text): r for r in quality_rules.base_stats(docs.select("doc_id", "text").withColumn("text", F.col("text")).select("doc_id", "text", F.col("text").alias("copy"))).withColumnRenamed("copy", "text").collect()}
    long_row = stats[6, LONG]
    assert (long_row.n_words, long_row.word_chars, long_row.n_symbols, long_row.n_dup_lines) == (30_004, 30_000 * 4 + 5 + 1 + 12 + 5000, 0, 0) and long_row.n_repeat_words == 30_000
    assert tuple(stats[None, None][c] for c in quality_rules.STATS) == (0,) * 5 and stats[-9, "\u0000 odd \x1f bytes \U0001f600 end"].n_words == 6
    scored = {(r.doc_id, r.n_tokens): r for r in context_tree.score(docs.select("doc_id", "text"), F.col("doc_id") > 0).collect()}
    assert (6, 30_005) in scored and (-9, 7) in scored and (None, 1) in scored and scored[3, 1].score == scored[None, 1].score == scored[4, 1].score
    spans = {(r.doc_id, len(r.text or "")): [(s.start, s.kind, s.end) for s in r.secret_spans] for r in secret_scan.scan(docs.select("doc_id", "text")).collect()}
    assert spans[6, len(LONG)] == [(150_000, 0, 150_020)] and spans[None, 0] == [] and spans[-9, len(ROWS[-1][1])] == []
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs.select("doc_id", "text"), width=2).collect()}
    assert {(6, 5, 6, True), (None, 0, None, True), (-9, 5, -9, True), (4, 0, 4, True), (5, 0, 5, True)} <= near
    tokens = {(r.doc_id, r.n_bytes) for r in token_count.count_tokens(docs.select("doc_id", "text"), _vocabulary()).collect()}
    assert {(6, len(LONG.encode())), (None, 0), (-9, 22)} <= tokens
    cut = line_dedup.drop_boilerplate(docs.select("doc_id", "text", "source"), ratio=0.3, least_pages=2).collect()
    assert sum(r.doc_id is None and r.text is None for r in cut) == 1 and sum(r.doc_id == 6 and r.text == LONG for r in cut) == 1


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages(spark, docs, stage, tmp_path, bench):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = docs.drop("copies", "target", "size_")
    for d in both(plain):
        out = stage(spark, d, str(tmp_path))
        assert out.columns[: len(plain.columns)] == plain.columns
        assert d.count() >= out.count()


def test_columns_that_helpers_would_take(spark, docs, bench, tmp_path):
    """Columns with the operators' own prefixes, and those used in joins, keep their values."""
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    named = plain.select("*", *(F.lit(-k).alias(c) for k, c in enumerate(["q_nll", "q_n_words", "Q_KEPT", "hits_n_hit", "hits_items", "more_gain", "more_known", "sum_row", "source_size"], 50)))
    values = {c: -k for k, c in enumerate(named.columns[5:], 50)}

    def told(df):
        assert df.columns[: len(named.columns)] == named.columns
        rows = df.collect()
        assert rows and all(r[c] == v for r in rows for c, v in values.items())
        return rows

    told(quality_rules.filter_quality(named))
    told(decontamination.drop_contaminated(named, bench))
    scored = context_tree.score(named, F.col("doc_id") > 0)
    assert all(r[c] == v for r in scored.collect() for c, v in values.items())
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    mixed = corpus_pipeline.source_mix(spark, named.withColumns({"size": F.lit("x"), "Target": F.lit("y"), "copies": F.lit("z")}), str(tmp_path))
    rows = told(mixed)
    assert mixed.columns == [*named.columns, "size", "target", "copies"] and all(r["copies"] in (1, 2) for r in rows)


def test_memory_of_the_toxicity_fit():
    import tracemalloc

    rng = np.random.default_rng(1)
    documents = [((rng.zipf(1.3, 6000) % 20000).astype("<i4"), np.full(200, 30, "<i4")) for _ in range(300)]
    y = (np.arange(300) % 3 == 0).astype(np.int64)
    for k in np.flatnonzero(y):
        documents[k][0][::50] = 777
    n = sum(len(b) for b, _ in documents)
    tracemalloc.start()
    model = toxicity.fit(documents, y, np.ones(300))
    peak = tracemalloc.get_traced_memory()[1] - 3 * model.weights.nbytes
    tracemalloc.stop()
    assert peak < 26 * n and not documents  # bytes a feature; a stable sort by index held 29 beside the documents
    assert model.weights[777] > 0
