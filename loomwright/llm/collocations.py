r"""Phrase collocation mining by suffix arrays of word ids.

Texts are lower-cased (A-Z), cut at `[.,;:!?\x0A-\x0D]` into pieces and those into words `[^\x20\x09]+`.  Each block of texts is
a shard: its words become ids by language, a separator stands between pieces, and numpy prefix doubling sorts the suffixes by their
first `longest` words.  Neighbours' common prefixes cut the suffix array into intervals, one for each distinct phrase of a
length, whose size is the phrase's count in the shard.  Counts are packed by language and hash of the phrase, and merged by phrase.

A candidate of 2 to `longest` words is cut where its parts explain it best, and dropped where a longer candidate around it is at least half
as frequent.  Scores are floor(10**6 * a * a / (l * r)) in whole numbers of up to 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import Scratch
from loomwright.llm.vectext import U64, as_bytes, blocks, byte_table, lean, pair_hash
from loomwright.llm.word_blocks import Coded, edges, flat, gather, key_hashes, lists, n_buckets, result, row_codes, spaced, split, strings, sums, whole

#: Bytes that part pieces, and those of words.
BREAKS = byte_table((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
WORDS = ~(BREAKS | byte_table((0x20, 0x20), (0x09, 0x09)))
LONGEST, LEAST, TOP = 3, 10, 2000
#: Bytes of text of a shard, and in all for each bucket of phrases; candidates of a language that a task ranks before the last ranking.
SHARD, BUCKET, RANKED = 4 << 20, 2 << 20, 1 << 20


def suffix_array(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of an id sequence sorted by their first `longest` ids, and the common prefix, up to that, of each with the one before.

    Ranks by the first h ids give ranks by the first 2h; the last step overlaps where `longest` is no power of two.
    """
    n, ranks, h = len(ids), {1: np.r_[ids, np.zeros(longest, np.int64)]}, 1
    order = np.argsort(ids) if longest == 1 else ids
    while h < longest:
        step = min(h, longest - h)
        rank = ranks[h]
        key = rank[:n] * (int(rank.max(initial=0)) + 1) + rank[step : n + step]
        order = np.argsort(key)
        dense = np.zeros(n + longest, np.int64)
        key = key[order]
        dense[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])[:n] + 1
        h += step
        ranks[h] = dense
    common, left, right = np.zeros(n, np.int64), order[:-1].copy(), order[1:].copy()
    for h in sorted(ranks, reverse=True):
        # A step of h fits if both go on alike for h ids; longer ones have been tried before.
        same = (ranks[h][left] == ranks[h][right]) & (common[1:] + h <= longest)
        common[1:] += same * h
        left, right = np.minimum(left + same * h, n + longest - 1), np.minimum(right + same * h, n + longest - 1)
    return order, common


def phrase_counts(words: Coded, lang_of_word: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, index of a first word, count) of the distinct phrases of each length that lie within one piece."""
    n = len(words.lens)
    if not n:
        return
    ends = words.starts + words.lens - 1
    breaks = np.cumsum(BREAKS[words.data])
    apart = np.r_[True, (words.rows()[1:] != words.rows()[:-1]) | (breaks[words.starts[1:]] != breaks[ends[:-1]])]
    place = np.arange(n) + np.cumsum(apart)  # a separator, id 0, before each piece
    ids = np.zeros(place[-1] + 2, np.int64)
    ids[place] = row_codes(pa.array(lang_of_word), pa.array(words.codes))[0] + 1
    word_at = np.zeros(len(ids), np.int64)
    word_at[place] = np.arange(n)
    piece_end = np.r_[np.flatnonzero(apart)[1:], n]
    left = np.repeat(piece_end, np.diff(np.r_[np.flatnonzero(apart), n])) - np.arange(n)
    order, common = suffix_array(ids, longest)
    real = ids[order] > 0  # suffixes that start with a separator come first
    order, common = word_at[order[real]], common[real]
    common[:1] = 0
    for length in range(1, longest + 1):
        start = np.flatnonzero(common < length)
        size = np.diff(np.r_[start, len(order)])
        inside = left[order[start]] >= length
        yield length, order[start[inside]], size[inside]


def _shard(lang: pa.Array, text: pa.Array, n_buckets: int, longest: int) -> pa.RecordBatch:
    """Packed rows (lang, bucket, phrases, n) of a block of texts."""
    group, (langs,) = row_codes(lang)
    words = Coded(text, WORDS)
    lang_of_word = group[words.rows()]
    hashes = key_hashes(words.names)[words.codes]
    # Words one after another with a space behind each, so that a phrase is a stretch of bytes.
    text, at = spaced(strings(words.bytes, words.ends), 32)
    first, length, count, bucket = [], [], [], []
    for k, word, n in phrase_counts(words, lang_of_word, longest):
        h = hashes[word]
        for step in range(1, k):
            h = pair_hash(h, hashes[word + step])
        first.append(word), length.append(np.full(len(word), k)), count.append(n), bucket.append((h % U64(n_buckets)).astype(np.int64))
    first, length, count, bucket = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, length, count, bucket))
    slot = lang_of_word[first] * n_buckets + bucket
    order = np.argsort(slot.astype(np.uint16) if slot.max(initial=0) < 1 << 16 else slot, kind="stable")  # few slots sort by digits
    slot, first, length, count = slot[order], first[order], length[order], count[order]
    size = at[first + length] - at[first]
    offsets = np.r_[0, np.cumsum(size)]
    phrases = gather(text, at[first], size)
    phrases[offsets[1:] - 1] = 10
    start = edges(slot)
    return pa.RecordBatch.from_arrays([langs.take(pa.array(slot[start] // n_buckets)), pa.array(slot[start] % n_buckets), strings(phrases, offsets[np.r_[start, len(first)]]), lists(start, count)], ["lang", "bucket", "phrases", "n"])


def _sharding(n_buckets: int, longest: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", SHARD):
                yield _shard(*block.columns, n_buckets, longest)

    return run


def _merging(least: int):
    def run(rows: pa.Table) -> pa.Table:
        """(lang, words, phrase, n) of a bucket's phrases of at least `least` occurrences, and with words = 0 the number of its words."""
        keys, _ = split(whole(rows["phrases"]))
        coded = keys.dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        n = sums(codes, flat(rows["n"]), len(names))
        data, offsets = as_bytes(names)
        spaces = np.r_[0, np.cumsum(data == 32)]
        length = spaces[offsets[1:]] - spaces[offsets[:-1]] + 1
        kept = np.flatnonzero(n >= least)
        phrase = pa.concat_arrays([pa.array([""], pa.large_string()), names.take(pa.array(kept)).cast(pa.large_string())])
        out = {"words": pa.array(np.r_[0, length[kept]].astype(np.int32)), "phrase": phrase, "n": pa.array(np.r_[n[length == 1].sum(), n[kept]])}
        return result({"lang": pa.repeat(rows["lang"][0], len(phrase)), **out})

    return run


def counts(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, n) of every phrase of up to `longest` words with at least `least` occurrences; rows of 0 words add up to the language's words."""
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = n_buckets(named, "text", BUCKET)
    shards = named.mapInArrow(_sharding(buckets, longest), "lang string, bucket long, phrases string, n array<long>")
    return shards.groupBy("lang", "bucket").applyInArrow(_merging(least), "lang string, words int, phrase string, n long")


def _score(a: Column, left: Column, right: Column) -> Column:
    whole = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", (whole(a) * whole(a)).cast("decimal(31,0)") * F.lit(10**6).cast("decimal(7,0)"), whole(left) * whole(right))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by score, count and spelling.

    a counts the phrase, l and r the parts of its lowest-scoring cut (the first of equals), n the language's words.  A candidate whose words
    lie in a longer one with at least `share` % of its count is dropped.  A null language is `und`, a null text is empty; every row
    is a document, so repeated rows count each; a language without candidates has no row, nor has an empty table; a
    text of any length is one document, whose pieces all count; other columns play no part.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    found = scratch.keep(counts(docs, lang, text, longest, least), "counts")
    total = found.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    part = found.where(f"words between 1 and {longest - 1}").select("lang", "phrase", "n")
    candidates = found.where("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
    w = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(w, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(w, F.col("k") + 1, F.col("words")), " ")})
    # A part is at least as frequent as its phrase, so none is missing.
    for side, short in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part.select("lang", F.col("phrase").alias(side), F.col("n").alias(short)), ["lang", side])
    lowest = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest)
    if longest > 2:
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
        around = candidates.where("words > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
        scored = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a")))
    scored = scratch.keep(scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")
    order = (F.desc("score"), F.desc("a"), "phrase")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(1 + scored.count() // RANKED))
    first = scored.withColumn("nth", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
