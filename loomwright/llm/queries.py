"""The opN_ queries over the driver's tables, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import collocations, context_tree, decontamination, divergence, line_dedup, main_text, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, token_count, toxicity
from loomwright.llm.common import Scratch, crc_mod, table
from loomwright.llm.labelled import labelled_sample
from loomwright.session import spread


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"), width=2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    held = crc_mod(F.col("doc_id"), 5) == 0
    sample, sizes = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", ~held, toxicity.PER_CLASS)
    scored = toxicity.score(docs, toxicity.train(sample, sizes))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "lang", "text")
    scored = quality_rules.score(docs, quality_rules.train(docs)).drop("text")
    judged = quality_rules.verdict(Scratch(spark, "op3").keep(scored, "scored"))
    return judged.select("doc_id", *quality_rules.STATS, "base_failed", "kept", F.round(F.exp("nll"), 3).alias("perplexity"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    marked = decontamination.mark_hits(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text")
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    counted = token_count.count_tokens(docs, _vocabulary())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    found = secret_scan.scan(docs, spans="found").drop("text")
    base = F.filter("found", lambda s: s["kind"] < len(secret_scan.BASE))
    counts = [F.size(F.filter(F.transform("found", lambda s: s["kind"]), lambda kind: kind == k)).cast("long").alias(f"n_{rule.kind}") for k, rule in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"), secret_scan.span_text(F.col("found")).alias("spans"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    held = crc_mod(F.col("doc_id"), 5) == 1
    scored = context_tree.score(docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "source", "text")
    cut = line_dedup.drop_boilerplate(docs, n_lines="n_lines", n_dropped="n_dropped")
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(Scratch(spark, "op9").keep(docs, "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    held = crc_mod(F.col("doc_id"), 4) == 2
    sample, sizes = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", ~held, quality_classifier.PER_CLASS)
    scored = quality_classifier.score(docs, quality_classifier.train(sample, sizes))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir, "lang", "source", "text"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir, "lang", "text"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return main_text.extract(pages, main_text.default_model()).withColumn("n_chars", F.length("text").cast("long"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op3_quality_rules, which SQL can state."""
    return quality_rules.base_stats(_documents(spark, sf_dir, "doc_id", "text"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources' weights and targets of op9_mixing, which SQL can state."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("source_size"))
    return mixing.targets(Scratch(spark, "targets").keep(sizes, "sizes")).withColumn("target", F.round("target", 4))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")} | {"quality_base": quality_base, "mix_targets": mix_targets}


#: Capitals and small letters of ASCII, for SQL's translate.
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, p, iw.k, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP8_SQL = r"""
WITH l AS (SELECT doc_id, source, p, ls[p] AS line, trim(ls[p], E' \t\r') AS bare
           FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
t AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
b AS (SELECT c.source, c.bare FROM (SELECT source, bare, count(DISTINCT doc_id) AS pages FROM l WHERE bare <> '' GROUP BY source, bare) c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE pages >= 5 AND pages > 0.015 * host_pages),
m AS (SELECT l.*, b.bare IS NOT NULL AS cut FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.bare = b.bare),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT cut), '') AS text FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(g.text, '')) AS text_sha256 FROM documents LEFT JOIN g USING (doc_id)
"""


OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS c, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT c, n, unnest(s) AS g FROM c),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
-- Sets that share four fifths share one of their rarest elements, so many that a fifth and one more is enough.
p AS MATERIALIZED (SELECT c, n, g FROM (SELECT e.c, e.n, e.g, row_number() OVER (PARTITION BY e.c ORDER BY df, e.g) AS r FROM e JOIN f USING (g)) WHERE r <= n - (4 * n + 4) // 5 + 1),
k AS (SELECT DISTINCT x.c AS a, y.c AS b FROM p x JOIN p y ON x.g = y.g AND x.c < y.c AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
v AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS shared, x.n + y.n AS both_n FROM k JOIN c x ON x.c = a JOIN c y ON y.c = b),
l AS MATERIALIZED (SELECT a, b FROM v WHERE 100 * shared >= 80 * (both_n - shared) UNION ALL SELECT b, a FROM v WHERE 100 * shared >= 80 * (both_n - shared)),
r AS (SELECT c, c AS d FROM c UNION SELECT r.c, l.b FROM r JOIN l ON r.d = l.a),
m AS (SELECT c, min(d) AS component FROM r GROUP BY c)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id, coalesce(component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m USING (c)
"""


QUALITY_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
h AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
q AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM h) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def _discount(counts: str) -> str:
    """SQL of (d1, d2, d3), the modified Kneser-Ney discounts of a table's counts n."""
    y, within = "(n1 / (n1 + 2 * n2))", "least(greatest({0}, 0.05), {1})"
    ds = (f"1 - 2 * {y} * n2 / n1", f"2 - 3 * {y} * n3 / n2", f"CASE WHEN n3 > 0 THEN 3 - 4 * {y} * n4 / n3 ELSE 2 - {y} END")
    each = ", ".join(f"CASE WHEN n1 > 0 AND n2 > 0 THEN {within.format(d, k + 0.95)} ELSE 0.5 END AS d{k + 1}" for k, d in enumerate(ds))
    return f"(SELECT {each} FROM (SELECT {', '.join(f'CAST(count(*) FILTER (n = {k}) AS DOUBLE) AS n{k}' for k in (1, 2, 3, 4))} FROM {counts}))"


def _order(name: str, counts: str, context: str, below: str, join: str = "") -> str:
    """SQL of a table with p of a table of counts, by context columns; below is p of the shorter n-gram."""
    cut = "CASE WHEN n >= 3 THEN d3 WHEN n = 2 THEN d2 ELSE d1 END"
    over = f"OVER (PARTITION BY {context})" if context else "OVER ()"
    return f"""{name} AS MATERIALIZED (SELECT *, (n - cut + mass * below) / total AS p FROM (SELECT t.*, {below} AS below FROM (SELECT *, {cut} AS cut, sum(n) {over} AS total, sum({cut}) {over} AS mass FROM {counts}, {_discount(counts)}) t {join}))"""


def _side(sign: str, name: str) -> str:
    """SQL of the lower median by language of the steps of distances on one side, turned back."""
    return f"""{name} AS (SELECT lang, greatest(1.4826 * exp(quantile_disc(round(ln({sign}far) * 100), 0.5) / 100), 0.5) AS w FROM far WHERE {sign}far > 0 GROUP BY lang)"""


OP3_SQL = f"""
WITH base AS ({QUALITY_BASE_SQL}),
x AS (SELECT doc_id, coalesce(lang, chr(1)) AS lang, list_transform(string_split(text, ''), lambda y: unicode(y)) AS u FROM documents WHERE length(text) > 0),
y AS MATERIALIZED (SELECT doc_id, lang, CASE WHEN i > 2 THEN u[i - 2] ELSE 0 END AS a, CASE WHEN i > 1 THEN u[i - 1] ELSE 0 END AS b, u[i] AS c FROM (SELECT doc_id, lang, u, unnest(range(1, len(u) + 1)) AS i FROM x)),
own AS MATERIALIZED (SELECT lang, a, b, c, count(*) AS n FROM y GROUP BY ALL),
n3 AS MATERIALIZED (SELECT a, b, c, sum(n) AS n FROM own GROUP BY ALL),
n2 AS MATERIALIZED (SELECT b, c, count(*) AS n FROM n3 GROUP BY ALL),
n1 AS MATERIALIZED (SELECT c, count(*) AS n FROM n2 GROUP BY ALL),
{_order("p1", "n1", "", "1.0 / (SELECT count(*) FROM n1)")},
{_order("p2", "n2", "b", "p1.p", "JOIN p1 ON t.c = p1.c")},
{_order("p3", "n3", "a, b", "p2.p", "JOIN p2 ON t.b = p2.b AND t.c = p2.c")},
{_order("best", "own", "lang, a, b", "p3.p", "JOIN p3 ON t.a = p3.a AND t.b = p3.b AND t.c = p3.c")},
s AS MATERIALIZED (SELECT doc_id, y.lang, -sum(CAST(CAST(ln(greatest(p, below)) AS FLOAT) AS DOUBLE)) / count(*) AS nll, count(*) AS k FROM y JOIN best USING (lang, a, b, c) GROUP BY doc_id, y.lang),
mid AS (SELECT lang, quantile_disc(round(nll * 1000), 0.5) / 1000 AS mid FROM s GROUP BY lang),
far AS (SELECT lang, (nll - mid) * sqrt(k) AS far FROM s JOIN mid USING (lang)),
{_side("", "above")},
{_side("-", "under")},
j AS (SELECT doc_id, nll, nll - mid <= 3 * coalesce(above.w, 0.5) / sqrt(k) + 0.01 AND mid - nll <= 3 * coalesce(under.w, 0.5) / sqrt(k) + 0.01 AS inside FROM s JOIN mid USING (lang) LEFT JOIN above USING (lang) LEFT JOIN under USING (lang))
SELECT base.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(inside, true) AS kept, round(exp(coalesce(nll, 0)), 3) AS perplexity
FROM base LEFT JOIN j USING (doc_id)
"""


def _any_case(pattern: str) -> str:
    """An ASCII pattern with (?i) in front without it, a class for each letter of its first group."""
    if not pattern.startswith("(?i)"):
        return pattern
    head, rest = pattern[4:].split(")", 1)
    return "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in head) + ")" + rest


def _op6_sql() -> str:
    rules = []
    for k, rule in enumerate(secret_scan.RULES):
        p = "'" + _any_case(rule.pattern).replace("'", "''") + "'"
        rules.append(f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {rule.group}) AS c, string_split_regex(t, {p}) AS g FROM d")
    union = "\nUNION ALL ".join(rules)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({union}),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r),
y AS (SELECT doc_id, k, kind, list_sum(list_transform(g[1 : i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda z: length(z))), 0) AS s, length(m[i]) AS n FROM x WHERE length(c[i]) >= least),
z AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(concat_ws(':', kind, CAST(s AS BIGINT), CAST(s + n AS BIGINT)), ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(concat_ws(':', kind, CAST(s AS BIGINT), CAST(s + n AS BIGINT)), ',' ORDER BY s, k) AS spans FROM y GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN z USING (doc_id)
"""


MIX_TARGETS_SQL = r"""
WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size FROM documents GROUP BY source),
w AS (SELECT *, 2.0 * source_size AS cap, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
-- Sources reach their cap in the order of cap over weight; the level is that of the first that does not.
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS r FROM w),
v AS (SELECT r, cap / weight AS own, ((SELECT 1.5 * sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o)
SELECT source, source_size, CAST(weight AS DOUBLE) AS weight, round(least((SELECT min_by(level, r) FROM v WHERE level <= own) * weight, cap), 4) AS target FROM w
"""


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT row, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
-- Every group and language with every kept term of the language.
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
                          1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
                   FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
      LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""


OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, g, len(g) AS k, count(*) AS n
      FROM (SELECT lang, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k)) GROUP BY lang, g HAVING count(*) >= 10),
c AS (SELECT x.lang, x.g, x.k, x.n AS a, cut, l.n AS l, r.n AS r, (1000000::HUGEINT * x.n * x.n) // (l.n::HUGEINT * r.n) AS score
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1) x JOIN f l ON l.lang = x.lang AND l.g = x.g[1 : cut] JOIN f r ON r.lang = x.lang AND r.g = x.g[cut + 1 :]),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
o AS (SELECT lang, g[i : i + 1] AS g, max(n) AS around FROM (SELECT lang, g, n, unnest([1, 2]) AS i FROM f WHERE k = 3) GROUP BY ALL),
d AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE around IS NULL OR 100 * around < 50 * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT q.lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM q JOIN t USING (lang) WHERE rank <= 2000
"""


#: The given pages hold their main text in one article of h1, p, b and br, which is what the model has to find by itself.
OP13_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS a FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS b FROM a),
c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS c FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT page_id, url, trim(regexp_replace(c, '\s+', ' ', 'g')) AS text FROM c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1_SQL, "op3_quality_rules": OP3_SQL, "op4_decontamination": OP4_SQL, "op6_secret_scan": _op6_sql(), "op8_line_dedup": OP8_SQL, "op11_divergence": OP11_SQL, "op12_collocations": OP12_SQL, "op13_main_text": OP13_SQL, "quality_base": QUALITY_BASE_SQL, "mix_targets": MIX_TARGETS_SQL}
