"""Source divergence audit: how far each source's use of words is from its language's and from other sources'.

Terms are runs of letters, those of A-Z in lower case.  A language keeps the terms of at least
`least_docs` of its documents.  Every source of a language, and the language itself, gives each
kept term a smoothed share in parts of 10**9, whole numbers throughout:
p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)).

Terms that a source overuses are found by an upper-bound search.  A source's terms lie in buckets by count; the highest p of a
bucket less the lowest share that the language gives any of its terms bounds what a term there can reach.
Buckets are evaluated best bound first, in rounds, until every bucket left is bounded strictly below the k-th best found.
Distances of sources are summed over postings (term, source): what both sources lack follows from counts alone.

Counting is one pass over the texts: a block of them hands on its terms in packed rows by language and hash of the term, so that however
common a term is it has one count a block and source, and no task has more than its share of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import Scratch
from loomwright.llm.vectext import U64, blocks, byte_table, lean
from loomwright.llm.word_blocks import Coded, edges, flat, joined, key_hashes, lists, n_buckets, result, row_codes, split, sums, whole

#: Terms `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`.
LETTERS = byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LEAST_DOCS, TOP = 30, 50
#: Bytes of text that are counted at once, and in all for each bucket of terms; postings that are paired at once.
BLOCK, BUCKET, POSTINGS = 4 << 20, 8 << 20, 1 << 18


def _count_block(lang: pa.Array, source: pa.Array, text: pa.Array, n_buckets: int) -> pa.RecordBatch:
    """Packed rows (lang, bucket, sources, terms, at, n, docs) of a block, `at` being a place in `sources`; bucket -1 names a language's sources alone."""
    group, (langs, sources) = row_codes(lang, source)
    lang_of = row_codes(langs)[0]  # groups stand in the order of languages
    first = edges(lang_of)
    words = Coded(text, LETTERS)
    size, groups = max(len(words.names), 1), len(langs)
    by_doc, n = np.unique(words.rows() * size + words.codes, return_counts=True)
    term, group = by_doc % size, group[by_doc // size]
    bucket = (key_hashes(words.names) % U64(n_buckets)).astype(np.int64)
    key = ((lang_of[group] * n_buckets + bucket[term]) * size + term) * groups + group
    order = np.argsort(key)
    key, n = key[order], n[order]
    one = edges(key)
    docs, key, n = np.diff(np.r_[one, len(key)]), key[one], np.add.reduceat(n, one) if len(one) else n
    start = edges(key // groups // size)
    slot = key[start] // groups // size
    row_lang, none = np.r_[slot // n_buckets, np.arange(len(first))], np.full(len(first), len(key))
    start = np.r_[start, none]
    terms = joined(words.names.take(pa.array(key // groups % size)), start)
    group = key % groups
    named = pa.array([list(x) for x in np.split(np.array(sources.to_pylist(), object), first[1:])], pa.list_(pa.string())).take(pa.array(row_lang))
    counts = [lists(start, x) for x in (group - first[lang_of[group]], n, docs)]
    return pa.RecordBatch.from_arrays([langs.take(pa.array(first[row_lang])), pa.array(np.r_[slot % n_buckets, np.full(len(first), -1)]), named, terms, *counts], ["lang", "bucket", "sources", "terms", "at", "n", "docs"])


def _counting(n_buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                yield _count_block(*block.columns, n_buckets)

    return run


def _merging(least_docs: int):
    def run(rows: pa.Table) -> pa.Table:
        """(lang, source, term, n, lang_n) of a bucket's terms of enough documents; of bucket -1, its groups without terms."""
        names = rows["sources"].combine_chunks()
        source, (sources,) = row_codes(names.flatten())
        if rows["bucket"][0].as_py() < 0:
            term, source, n, names = np.zeros(len(sources), np.int64), np.arange(len(sources)), np.zeros(len(sources), np.int64), pa.array([""], pa.large_string())
        else:
            keys, each = split(whole(rows["terms"]))
            offset = names.offsets.to_numpy()[:-1] - names.offsets[0].as_py()
            coded = keys.dictionary_encode()
            names, term = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            kept = (sums(term, flat(rows["docs"]), len(names)) >= least_docs)[term]
            key, inverse = np.unique(term[kept] * len(sources) + source[np.repeat(offset, each) + flat(rows["at"])][kept], return_inverse=True)
            n, term, source = sums(inverse, flat(rows["n"])[kept], len(key)), key // len(sources), key % len(sources)
        return result({"lang": pa.repeat(rows["lang"][0], len(n)), "source": sources.take(pa.array(source)), "term": names.take(pa.array(term)), "n": pa.array(n), "lang_n": pa.array(sums(term, n, len(names))[term])})

    return run


def _pairing(rows: pa.Table) -> pa.Table:
    """(lang, source, other, both), source before other: the sum over postings of one term of |p - q| less what each holds against a source without it."""
    source, (sources,) = row_codes(whole(rows["source"]))
    rank = np.argsort(pc.sort_indices(sources).to_numpy())
    source, many = rank[source], len(sources)
    term = row_codes(whole(rows["term"]))[0]
    order = np.lexsort((source, term))
    term, source, p, none = term[order], source[order], rows["p"].to_numpy()[order], rows["p_none"].to_numpy()[order]
    last = np.searchsorted(term, term, "right")
    after, at, key, value = last - np.arange(len(term)) - 1, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    upto = np.cumsum(after)
    while at < len(term):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 4 * POSTINGS, "right")))
        i = np.repeat(np.arange(at, stop), after[at:stop])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.r_[0, np.cumsum(after[at:stop])[:-1]], after[at:stop])
        mend = abs(p[i] - p[j]) - abs(p[i] - none[j]) - abs(none[i] - p[j]) + abs(none[i] - none[j])
        key, inverse = np.unique(np.r_[key, source[i] * many + source[j]], return_inverse=True)
        value, at = sums(inverse, np.r_[value, mend], len(key)), stop
    sources = sources.take(pa.array(np.argsort(rank)))
    return result({"lang": pa.repeat(rows["lang"][0], len(key)), "source": sources.take(pa.array(key // max(many, 1))), "other": sources.take(pa.array(key % max(many, 1))), "both": pa.array(value)})


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * terms)), whole numbers of up to 38 digits in between; null without terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    over = F.when(terms > 0, whole(total + 5 * terms))
    return F.lit(1) + F.call_function("div", whole(count + 5) * F.lit(10**9).cast("decimal(10,0)"), over)


def _bucket(count: Column) -> Column:
    """Buckets of counts with the same number of bits and the same four leading ones."""
    bits = F.length(F.bin(count))
    return bits * 16 + F.call_function("shiftright", count, F.greatest(bits - 4, F.lit(0))).cast("int")


class Audit:
    """The counted table: `groups` (lang, source, total, n_terms, kept, p_none) and `postings` (lang, source, term, n, p, q, p_none, bucket)."""

    def __init__(self, docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS):
        self.scratch = Scratch(docs.sparkSession, "divergence")
        named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
        buckets = n_buckets(named, "text", BUCKET)
        counted = named.mapInArrow(_counting(buckets), "lang string, bucket long, sources array<string>, terms string, at array<long>, n array<long>, docs array<long>")
        kept = counted.groupBy("lang", "bucket").applyInArrow(_merging(least_docs), "lang string, source string, term string, n long, lang_n long")
        kept = self.scratch.keep(kept, "kept")
        groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("term") != "").alias("n_terms"))
        # Every term is in as many rows as sources have it; its total is in each.
        langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total")).join(kept.where("term <> ''").select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
        groups = groups.join(langs.na.fill(0, ["kept"]), "lang")
        none = _share(F.lit(0), F.col("total"), F.col("kept"))
        self.groups = self.scratch.keep(groups.withColumn("p_none", none), "groups")
        postings = kept.where("term <> ''").join(self.groups, ["lang", "source"]).select(
            "lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), "p_none", _bucket(F.col("n")).alias("bucket")
        )
        self.postings = self.scratch.keep(postings, "postings")

    def overused(self, top: int = TOP) -> DataFrame:
        """(lang, source, term, value, rank) of each group's `top` terms by p - q, where that is above 0; ties by term."""
        group = Window.partitionBy("lang", "source")
        bounds = self.postings.groupBy("lang", "source", "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("size"))
        best_first = group.orderBy(F.desc("bound"), "bucket")
        bounds = bounds.where("bound > 0").withColumn("before", F.sum("size").over(best_first) - F.col("size"))
        bounds = self.scratch.keep(bounds, "bounds")
        ranked = group.orderBy(F.desc("value"), "term")
        best, low, high, turn = None, 0, top, 0
        while True:
            step = bounds.where((F.col("before") >= low) & (F.col("before") < high))
            if best is not None:
                step = self._reaching(step, best, top)
            found = self.postings.join(step.select("lang", "source", "bucket"), ["lang", "source", "bucket"]).select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value")).where("value > 0")
            pool = found if best is None else found.unionByName(best.drop("rank"))
            best = self.scratch.keep(pool.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top), f"best{turn}")
            if self._reaching(bounds.where(F.col("before") >= high), best, top).isEmpty():
                return best
            low, high, turn = high, 4 * high, turn + 1

    @staticmethod
    def _reaching(bounds: DataFrame, best: DataFrame, top: int) -> DataFrame:
        """The buckets that may hold a term as good as their group's k-th best so far, or any term where fewer are found."""
        kth = best.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
        return bounds.join(kth, ["lang", "source"], "left").where(F.col("bound") >= F.coalesce("kth", F.lit(1))).drop("kth")

    def distances(self) -> DataFrame:
        """(lang, source, other, value, rank): the sum of |p - q| over all kept terms for every two sources of a language, both ways."""
        gap = lambda a, b: F.abs(F.col(a) - F.col(b))
        g = self.groups
        other = g.select("lang", F.col("source").alias("other"), F.col("total").alias("o_total"), F.col("n_terms").alias("o_terms"), F.col("p_none").alias("o_none"))
        # A group's terms by p, against another that lacks them all.
        shares = self.postings.groupBy("lang", "source", "p").agg(F.count("*").alias("size"))
        lone = shares.join(other, "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.col("size") * gap("p", "o_none")).alias("lone"))
        slots = 1 + self.postings.count() // POSTINGS
        slot = F.pmod(F.xxhash64("term"), F.lit(slots))
        both = self.postings.select("lang", slot.alias("slot"), "term", "source", "p", "p_none").groupBy("lang", "slot").applyInArrow(_pairing, "lang string, source string, other string, both long")
        both = both.groupBy("lang", "source", "other").agg(F.sum("both").alias("both"))
        turned = lambda df, c: df.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col(c).alias(c + "_turned"))
        key = ["lang", "source", "other"]
        half = g.join(other, "lang").where("source < other").join(lone, key, "left").join(turned(lone, "lone"), key, "left").join(both, key, "left")
        parts = [F.coalesce(c, F.lit(0)) for c in ("lone", "lone_turned", "both")] + [F.coalesce((F.col("kept") - F.col("n_terms") - F.col("o_terms")) * gap("p_none", "o_none"), F.lit(0))]
        half = self.scratch.keep(half.select(*key, sum(parts[1:], parts[0]).alias("value")), "pairs")
        whole = half.unionByName(half.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
        return whole.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for every other source of the language, `term` rows for overused terms.

    A null language, source or text reads as ''.  Every row is a document, so repeated rows count each.  A source whose texts hold no
    kept term has pair rows and no term rows; where a language keeps no term, distances are 0.  A source that is alone in its language has
    no pair.  Ties go to the item first in UTF-8 order.  A text of any length is counted whole; an empty table gives no rows; other columns
    play no part.
    """
    found = Audit(docs, lang, source, text, least_docs)
    parts = [("pair", "other", found.distances()), ("term", "term", found.overused(top))]
    each = [df.select("lang", "source", F.lit(part).alias("part"), F.col(item).alias("item"), "value", F.col("rank").cast("int").alias("rank")) for part, item, df in parts]
    return each[0].unionByName(each[1])
