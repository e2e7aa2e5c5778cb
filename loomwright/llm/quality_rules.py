"""Quality rules: word statistics, and an n-gram perplexity band for each language.

The language model is a modified Kneser-Ney model of code points.  Spark counts the ORDER-grams of every
text by language, and the model follows from those counts by joins and sums over them: a model of
the whole corpus, which interpolates down to single code points, and on top of it each language's own,
which interpolates with it.  A code point is scored by the better of the two, so that a passage in another language
does not count against a text.  Nothing is pruned: every n-gram that occurs has its log probability in a
written table of (language, n-gram) hashes, of which a pass over the texts broadcasts TABLE as one sorted hash array; a
larger table means more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import Scratch, broadcast_if, fresh, fresh_prefix
from loomwright.llm.vectext import NON_SPACE, U64, Words, as_bytes, blocks, fmix, hash_spans, lean, pair_hash, windows

#: Code points of an n-gram and bits of each; three pack into 63 bits.
ORDER, BITS = 3, 21
#: N-grams that a pass over the texts looks up: 12 bytes each in a worker.
TABLE = 1 << 21
#: Code points that are worked on at once, and cells of a dense table of n-grams of a piece's own alphabet.
PIECE, DENSE = 1 << 20, 1 << 22
#: Characters that count as symbols.
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Reach of a band in deviations, what is added to it, and the least deviation; a mean over n n-grams deviates by about spread / sqrt(n).
WIDTH, SLACK, LEAST_SPREAD = 3.0, 0.01, 0.5
#: Medians come from exact counts of steps: of 1/1000 of a log perplexity, and of 1/100 of the logarithm of a distance.
STEPS, FINENESS = 1000, 100
#: Bands are broadcast for up to so many languages and joined beyond.
LANGUAGES = 1 << 16
#: Partial counts that a task holds before it hands them on.
HELD = 1 << 20
#: The key of texts without a language.
_NO_LANGUAGE = U64(0x9D39247E33776D41)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flags between each two offsets are set."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values.view(np.uint8), offsets[:-1][full], dtype=np.int64)
    return out


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True where the key occurs more than once."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def text_stats(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> list[np.ndarray]:
    """STATS of each row."""
    words = Words(data, offsets, NON_SPACE, lower=False)
    first = words.first
    points = (data & 0xC0) != 0x80
    in_words = NON_SPACE[data] if len(data) else np.zeros(0, bool)
    rows = words.rows()
    cover = np.zeros(len(rows) + 1, np.int64)
    grams = windows(words.hashes(), window)
    at = np.flatnonzero(rows[: len(grams)] == rows[window - 1 :]) if len(grams) else np.zeros(0, np.int64)
    if len(at):
        at = at[_repeats(pair_hash(grams[at], rows[at].astype(np.uint64)))]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
    covered = np.cumsum(cover[:-1]) > 0
    # A line ends at \n or with its row; only lines with a word count.
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:][data == 10] = True
    starts = np.flatnonzero(edge)
    lens = np.diff(np.append(starts, len(data)))
    lens -= (lens > 0) & (data[np.minimum(starts + lens, len(data)) - 1] == 10) if len(data) else 0
    has = np.searchsorted(words.starts, starts + lens) > np.searchsorted(words.starts, starts)
    starts, lens = starts[has], lens[has]
    line_rows = np.searchsorted(offsets, starts, "right") - 1
    keys = pair_hash(hash_spans(data, starts, lens), line_rows.astype(np.uint64))
    _, once = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[once] = False
    return [words.counts, _per_row(points & in_words, offsets), _per_row(SYMBOLS[data] if len(data) else in_words, offsets), np.bincount(line_rows[later], minlength=len(offsets) - 1), _per_row(covered, first)]


def language_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit keys of the languages of a batch, which of them each row has)."""
    coded = pc.dictionary_encode(column.cast(pa.string()), null_encoding="encode")
    names = coded.dictionary
    keys = hash_spans(*_spans_of(names))
    keys[np.flatnonzero(pc.is_null(names).to_numpy(zero_copy_only=False))] = _NO_LANGUAGE
    return keys, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _spans_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = as_bytes(column)
    return data, offsets[:-1], np.diff(offsets)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(packed n-grams, row of each), piece by piece: one for each code point, with the ORDER - 1 before it; texts start after zeros."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    first = np.concatenate([[0], np.cumsum(_per_row((data & 0xC0) != 0x80, offsets))])
    for at in range(0, len(points), PIECE):
        part = points[max(at - ORDER + 1, 0) : at + PIECE].astype(np.int64)
        more = min(at, ORDER - 1)  # code points of the piece before, for context only
        n = len(part) - more
        keys = part[more:].copy()
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(first, at, at + n)))
        begins = first[:-1][(first[:-1] >= at - more) & (first[:-1] < at + n)] - at
        for k in range(1, ORDER):
            before = np.zeros(n, np.int64)
            before[max(k - more, 0) :] = part[max(more - k, 0) : max(more - k, 0) + n - max(k - more, 0)]
            for j in range(k):  # what stands before a text's first code points is another text's
                at_start = begins + j
                before[at_start[(at_start >= 0) & (at_start < n)]] = 0
            keys |= before << (BITS * k)
        yield keys, row


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams, how often each occurs, which of them stands at each place)."""
    low = (1 << BITS) - 1
    letters = np.unique(np.concatenate([np.flatnonzero(np.bincount((keys >> (BITS * k)) & low)) for k in range(ORDER)]))
    n = len(letters)
    if n**ORDER > DENSE:
        seen, at, times = np.unique(keys, return_inverse=True, return_counts=True)
        return seen, times, at
    number = np.zeros(letters[-1] + 1 if n else 1, np.int32)
    number[letters] = np.arange(n)
    cell = np.zeros(len(keys), np.int32)
    for k in range(ORDER - 1, -1, -1):
        cell = cell * np.int32(n) + number[(keys >> (BITS * k)) & low]
    counts = np.bincount(cell, minlength=1)
    seen = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[seen] = np.arange(len(seen))
    packed, rest = np.zeros(len(seen), np.int64), seen.copy()
    for k in range(ORDER):
        packed |= letters[rest % n] << (BITS * k)
        rest //= n
    return packed, counts[seen], place[cell]


def ngram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang_key, gram, n) of the corpus: each task adds up its texts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def merged(own: list) -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate([x[k] for x in own]) for k in (0, 1))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[at], np.add.reduceat(n, at)

        def out(own: int) -> Iterator[pa.RecordBatch]:
            keys, n = merged(held.pop(own))
            for at in range(0, len(keys), 1 << 16):
                part = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), own).view(np.int64)), pa.array(part), pa.array(n[at : at + (1 << 16)])], names=["lang_key", "gram", "n"])

        for batch in batches:
            for block in blocks(batch, text, PIECE):
                langs, which = language_keys(block.column(1))
                for keys, rows in grams(*as_bytes(block.column(0))):
                    of = which[rows]
                    for k in np.flatnonzero(np.bincount(of)).tolist():
                        seen, times, _ = tallied(keys[of == k])
                        own = held.setdefault(langs[k], [])
                        own.append((seen, times))
                        if sum(len(x) for x, _ in own) > HELD:
                            held[langs[k]] = [merged(own)]
                if sum(len(x) for own in held.values() for x, _ in own) > 2 * HELD:
                    for k in list(held):
                        yield from out(k)
        for k in list(held):
            yield from out(k)

    return docs.select(F.col(text), F.col(lang)).mapInArrow(lean(run), "lang_key long, gram long, n long").groupBy("lang_key", "gram").agg(F.sum("n").alias("n"))


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts of 1, 2 and more, from the numbers of n-grams with counts 1 to 4."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - y)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(found))


def _interpolated(counts: DataFrame, sizes: list[int], low: DataFrame | None, keys: list[str], order: int) -> DataFrame:
    """counts (keys..., gram, n) of one order with `p`, interpolated with the shorter n-grams' p in low (gram, p), and that as `below`.

    sizes: how many n-grams there are, and with counts of 1 to 4.
    """
    d1, d2, d3 = discounts(*map(float, sizes[1:]))
    cut = F.when(F.col("n") >= 3, d3).when(F.col("n") == 2, d2).otherwise(d1)
    held = counts.withColumns({"context": F.shiftright("gram", BITS), "cut": cut})
    contexts = held.groupBy(*keys, "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("mass"))
    joined = held.join(contexts, [*keys, "context"])
    if low is None:
        joined = joined.withColumn("below", F.lit(1.0 / max(sizes[0], 1)))
    else:
        joined = joined.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1))).join(low.select(F.col("gram").alias("shorter"), F.col("p").alias("below")), "shorter")
    return joined.select(*keys, "gram", "n", "below", ((F.col("n") - F.col("cut") + F.col("mass") * F.col("below")) / F.col("total")).alias("p"))


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without their text, with STATS; a null or empty text has 0 of each, repeated rows have equal ones, an empty table stays empty."""
    rest = docs.drop(*STATS)
    kept = [c for c in rest.columns if c != text]
    schema = rest.select(*kept, *(F.lit(0).cast("long").alias(c) for c in STATS)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text, PIECE):
                more = [pa.array(np.asarray(x, np.int64)) for x in text_stats(*as_bytes(block.column(block.schema.get_field_index(text))))]
                yield pa.RecordBatch.from_arrays([*(block.column(block.schema.get_field_index(c)) for c in kept), *more], names=[*kept, *STATS])

    return rest.mapInArrow(lean(run), schema)


@dataclass
class Model:
    """(lang_key, gram, p) of every n-gram in a written table, p being a natural logarithm; their number, and p of n-grams that are not among them."""

    table: DataFrame
    n: int
    unseen: float

    def part(self, k: int, passes: int) -> tuple[np.ndarray, np.ndarray]:
        """The k-th part of the table as a sorted hash array and the log probabilities beside it."""
        got = self.table.where(F.pmod(F.xxhash64("lang_key", "gram"), F.lit(passes)) == k).toArrow()
        keys = hashed(got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy())
        order = np.argsort(keys)
        return keys[order], got.column(2).to_numpy()[order]


def hashed(lang_key: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return fmix(gram.astype(np.uint64) ^ lang_key)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of every text of docs.  A null or empty text teaches nothing, repeated rows count each, a null language is one of its own, an empty table gives an empty model."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    own = scratch.keep(ngram_counts(docs, text, lang), "counts")
    counts = {ORDER: scratch.keep(own.groupBy("gram").agg(F.sum("n").alias("n")), f"order{ORDER}")}
    for k in range(ORDER - 1, 0, -1):  # how many different code points came before
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
        counts[k] = scratch.keep(counts[k + 1].groupBy(shorter.alias("gram")).agg(F.count("*").alias("n")), f"order{k}")
    # Order ORDER + 1 is the languages' own counts.
    each = [df.agg(F.lit(k).alias("k"), F.count("*").alias("size"), *(F.count_if(F.col("n") == c).alias(f"n{c}") for c in (1, 2, 3, 4))) for k, df in [*counts.items(), (ORDER + 1, own)]]
    sizes = {r[0]: list(r[1:]) for r in reduce(DataFrame.unionByName, each).collect()}
    shared = None
    for k in range(1, ORDER + 1):
        shared = _interpolated(counts[k], sizes[k], shared, [], k - 1)
    best = _interpolated(own, sizes[ORDER + 1], shared, ["lang_key"], ORDER).select("lang_key", "gram", F.log(F.greatest("p", "below")).cast("float").alias("p"))
    table = scratch.keep(best, "table")
    for done in ("counts", *(f"order{k}" for k in counts)):
        scratch.drop(done)
    n, least = table.agg(F.count("*"), F.coalesce(F.min("p"), F.lit(0.0))).first()
    return Model(table, n, float(least))


def _add_up(table: tuple[np.ndarray, np.ndarray], block: pa.RecordBatch, text: str, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log probability of the n-grams that the table has, their number, the number of all) of each row."""
    hashes, p = table
    total, found, every = np.zeros(block.num_rows), np.zeros(block.num_rows, np.int64), np.zeros(block.num_rows, np.int64)
    langs, which = language_keys(block.column(block.schema.get_field_index(lang)))
    for keys, rows in grams(*as_bytes(block.column(block.schema.get_field_index(text)))):
        of = which[rows]
        for k in np.flatnonzero(np.bincount(of)).tolist():
            here = of == k
            seen, _, place = tallied(keys[here])
            want = hashed(langs[k], seen)
            at = np.minimum(np.searchsorted(hashes, want), max(len(hashes) - 1, 0))
            there = hashes[at] == want if len(hashes) else np.zeros(len(seen), bool)
            value = np.where(there, p[at] if len(hashes) else 0, 0)
            own = rows[here]
            total += np.bincount(own, value[place], minlength=block.num_rows)
            found += np.bincount(own[there[place]], minlength=block.num_rows)
            every += np.bincount(own, minlength=block.num_rows)
    return total, found, every


def score(docs: DataFrame, model: Model, text: str = "text", prefix: str = "", lang: str = "lang", stats: bool = True) -> DataFrame:
    """docs with STATS (unless `stats` is false), `nll` (log perplexity) and `n_grams` (code points), all named with `prefix`; rows and columns pass through.

    docs are those that the model was trained on; n-grams that it has not seen count as its rarest one.  A null or empty text has 0 of
    everything; repeated rows have equal results; an empty table stays empty.  Columns of the result names are replaced.
    """
    names = [prefix + c for c in (*(STATS if stats else ()), "nll", "n_grams")]
    docs = docs.drop(*names)
    spark, passes, scratch = docs.sparkSession, max(1, -(-model.n // TABLE)), Scratch(docs.sparkSession, "rules")
    known = fresh(docs, "n_known")
    kinds = [F.lit(0).cast("double" if c.endswith("nll") else "long").alias(c) for c in names]
    schema = docs.select("*", *kinds, F.lit(0).cast("long").alias(known)).schema
    first = held = spark.sparkContext.broadcast(model.part(0, passes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text, PIECE):
                total, found, every = _add_up(first.value, block, text, lang)
                more = [pa.array(np.asarray(x, np.int64)) for x in text_stats(*as_bytes(block.column(block.schema.get_field_index(text))))] if stats else []
                yield pa.RecordBatch.from_arrays([*block.columns, *more, pa.array(total), pa.array(every), pa.array(found)], names=[*block.schema.names, *names, known])

    scored = docs.mapInArrow(lean(run), schema)
    for k in range(1, passes):  # the rest of the table, part by part
        scored = scratch.keep(scored, f"pass{k}")
        if k > 1:
            scratch.drop(f"pass{k - 1}")
        held.unpersist()
        held = spark.sparkContext.broadcast(model.part(k, passes))

        def another(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch, text, PIECE):
                    total, found, _ = _add_up(held.value, block, text, lang)
                    for name, x in ((prefix + "nll", total), (known, found)):
                        at = block.schema.get_field_index(name)
                        block = block.set_column(at, block.schema.field(at), pa.array(block.column(at).to_numpy() + x))
                    yield block

        scored = scored.mapInArrow(lean(another), scored.schema)
    nll, n = F.col(prefix + "nll"), F.col(prefix + "n_grams")
    mean = F.when(n > 0, -(nll + (n - F.col(known)) * F.lit(model.unseen)) / n).otherwise(0.0)
    return scored.withColumn(prefix + "nll", mean).drop(known)


def _median(rows: DataFrame, step: Column, value: Column, name: str) -> DataFrame:
    """(lang, name): each language's median of `step`, an integer, turned back by `value`; from counts of steps, so no language is sorted in one task."""
    counts = rows.where(step.isNotNull()).groupBy("lang", step.cast("long").alias("step")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang")
    upto = F.sum("n").over(own.orderBy("step")) / F.sum("n").over(own)
    return counts.withColumn("upto", upto).groupBy("lang").agg(F.min(F.when(F.col("upto") >= 0.5, F.col("step"))).alias("step")).select("lang", value.alias(name))


def bands(scored: DataFrame, lang: str = "lang", nll: str = "nll", n_grams: str = "n_grams") -> DataFrame:
    """(lang, mid, above, below): each language's median log perplexity, and the robust deviations of texts above and below it, times the root of their n-grams.

    A null language is one of its own; texts without n-grams do not count.  `scored` is read three times, so it should be a written table.
    """
    rows = scored.where(F.col(n_grams) > 0).select(F.col(lang).alias("lang"), F.col(nll).alias("nll"), F.col(n_grams).alias("n"))
    out = mid = _median(rows, F.round(F.col("nll") * STEPS), F.col("step") / STEPS, "mid")
    mids = mid.select(F.col("lang").alias("mid_lang"), F.col("mid").alias("mid_nll"))
    far = rows.join(mids, F.col("lang").eqNullSafe(F.col("mid_lang"))).withColumn("far", (F.col("nll") - F.col("mid_nll")) * F.sqrt("n"))
    for name, side in (("above", F.col("far")), ("below", -F.col("far"))):
        one = _median(far, F.when(side > 0, F.round(F.log(side) * FINENESS)), F.greatest(1.4826 * F.exp(F.col("step") / FINENESS), F.lit(LEAST_SPREAD)), name).withColumnRenamed("lang", f"{name}_lang")
        out = out.join(one, F.col("lang").eqNullSafe(F.col(f"{name}_lang")), "left").drop(f"{name}_lang")
    return out.fillna(LEAST_SPREAD, ["above", "below"])


def verdict(scored: DataFrame, prefix: str = "", lang: str = "lang", limits: DataFrame | None = None, width: float = WIDTH) -> DataFrame:
    """scored with `base_failed` and `kept`: a text fails when its perplexity is outside its language's band.

    Rows without words fail the base rules; rows alike fare alike; an empty table stays empty; columns of the two names are replaced.
    """
    names = {c: prefix + c for c in (*STATS, "nll", "n_grams", "base_failed", "kept")}
    scored = scored.drop(names["base_failed"], names["kept"])
    mid, above, below, key = (fresh(scored, x) for x in ("mid", "above", "below", "band_lang"))
    limits = (bands(scored, lang, names["nll"], names["n_grams"]) if limits is None else limits).select(F.col("lang").alias(key), F.col("mid").alias(mid), F.col("above").alias(above), F.col("below").alias(below))
    limits = broadcast_if(Scratch(scored.sparkSession, "bands").keep(limits, "bands"), LANGUAGES)
    joined = scored.join(limits, scored[lang].eqNullSafe(F.col(key)), "left")
    failed = (F.col(names["n_words"]) < 10) | (100 * F.col(names["n_repeat_words"]) > 20 * F.col(names["n_words"]))
    off, root = F.col(names["nll"]) - F.col(mid), F.sqrt(F.greatest(F.col(names["n_grams"]), F.lit(1)))
    inside = F.coalesce((off <= width * F.col(above) / root + SLACK) & (-off <= width * F.col(below) / root + SLACK), F.lit(True))
    return joined.withColumns({names["base_failed"]: failed, names["kept"]: ~failed & inside}).drop(key, mid, above, below)


def filter_quality(docs: DataFrame, text: str = "text", lang: str = "lang", width: float = WIDTH) -> DataFrame:
    """The documents that pass, with their own columns.

    A null or empty text has no words and is rejected; repeated rows fare alike;
    an empty table gives an empty one; a null language is judged among its like.
    """
    prefix = fresh_prefix(docs, "q_")
    model = train(docs, text, lang)
    measured = score(docs.select(text, lang), model, text, prefix, lang, stats=False).select(lang, prefix + "nll", prefix + "n_grams")
    limits = bands(Scratch(docs.sparkSession, "quality").keep(measured, "measured"), lang, prefix + "nll", prefix + "n_grams")
    out = verdict(score(docs, model, text, prefix, lang), prefix, lang, limits, width)
    return out.where(F.col(prefix + "kept")).select(*docs.columns)
