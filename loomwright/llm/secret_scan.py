"""Secret scans over a trigram inverted index, in DataFrame functions throughout.

Each rule's pattern yields a Boolean trigram query.  The index holds a posting (trigram,
doc_id) for every trigram that some query needs; a rule's candidates are the
documents whose postings contain one of its conjunctions.  Candidates are
verified by the pattern itself.  A rule without mandatory trigrams scans every text.
Trigrams are looked up in lower-cased texts, which may only add candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import Scratch, fresh, let, may_hold
from loomwright.llm.trigrams import ANY, Query, query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern that both Java and Python read alike, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def query(self) -> Query:
        return query(self.pattern)


#: The base kinds, in the order that breaks ties of equal starts.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # Runs are maximal, so a least length inside the pattern drops the same matches as a check afterwards.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds beyond the base ones.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(trigram, doc_id): the inverted index of the trigrams that the rules' queries read; documents without id are left out."""
    needed = sorted({t for r in rules for alternative in r.query for t in alternative})
    # The generator keeps the optimizer from lower-casing the text again for each trigram.
    low = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.explode(F.array(F.lower(F.col(text)))).alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in needed))) if needed else F.array().cast("array<string>")
    return low.select(F.explode(present).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): by document, the bits of the rules of which a conjunction has all its postings.

    Documents that no rule with a query can match have no row.
    """
    spark = index.sparkSession
    terms = [(n, bit, len(alternative), t) for n, (bit, alternative) in enumerate((i, a) for i, r in enumerate(rules) for a in sorted(r.query, key=sorted) if a) for t in sorted(alternative)]
    wanted = F.broadcast(spark.createDataFrame(terms, "conjunction int, bit int, need int, trigram string"))  # a row for each trigram of the rules' queries
    counts = index.distinct().join(wanted, "trigram").groupBy("doc_id", "conjunction", "bit", "need").agg(F.count("*").alias("n")).where(F.col("n") == F.col("need"))
    return counts.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("rules"))


def _spans(rule: Rule, text: Column, number: int) -> Column:
    """Array of (start, kind, end) of a rule's matches in code points, by the lengths of matches and of what lies between.

    Positions are running sums, taken in runs of about the cube root of the matches and then over the runs, so
    that no array grows match by match.
    """
    pattern, kind = F.lit(rule.pattern), "array<struct<start:int,kind:int,end:int>>"
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group))

    def steps(whole: Column) -> Column:
        gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole))
        return F.zip_with(gaps, F.arrays_zip(whole.alias("m"), (checked if rule.group else whole).alias("c")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["m"]).alias("n"), (F.length(m["c"]) >= rule.least).alias("ok")))

    def add(acc: Column, s: Column) -> Column:
        start, end = acc["at"] + s["gap"], acc["at"] + s["gap"] + s["n"]
        return F.struct(end.alias("at"), F.when(s["ok"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    def runs(found: Column) -> Column:
        n = F.ceil(F.cbrt(F.size(found))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(found) - 1, n), lambda at: F.aggregate(F.slice(found, at + 1, n), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")), add))

    def placed(done: Column) -> Column:
        begins = F.aggregate(done, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")), lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins")))["begins"]
        return F.flatten(F.zip_with(done, begins, lambda r, at: F.transform(r["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end")))))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda whole: let(steps(whole), lambda found: F.when(F.size(found) > 0, let(runs(found), placed)).otherwise(F.array().cast(kind))))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id", spans: str = "secret_spans") -> DataFrame:
    """docs with `spans`: an array of (start, kind, end), by start and then by the rules' order; kind is a rule's number.

    Null and empty texts have no spans; an empty table stays empty.  Rows without an id are verified by every rule;
    rows that share an id share its candidates, and each is verified on its own text.  A document's matches of a rule do not
    overlap; those of different rules may.  Only rows whose id may be a candidate's are shuffled.
    """
    docs = docs.drop(spans)
    scratch = Scratch(docs.sparkSession, "secrets")
    index = scratch.keep(postings(docs, rules, text, doc_id), "postings")
    key, bits = fresh(docs, "candidate_id"), fresh(docs, "candidate_rules")
    found = scratch.keep(candidates(index, rules).select(F.col("doc_id").alias(key), F.col("rules").alias(bits)), "candidates")
    told, maybe = may_hold(docs, found.select(F.col(key).alias(doc_id)), doc_id)
    far = told.where(maybe).select(*docs.columns).join(found, F.col(doc_id) == F.col(key), "left").drop(key)
    joined = told.where(~maybe).select(*docs.columns, F.lit(0).cast("long").alias(bits)).unionByName(far)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = []
    for number, rule in enumerate(rules):
        may = F.col(text).isNotNull()
        if rule.query != ANY:
            may = may & (F.col(doc_id).isNull() | (F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(F.lit(1 << number)) != 0))
        each.append(F.when(may & F.col(text).rlike(rule.pattern), _spans(rule, F.col(text), number)).otherwise(none))
    return joined.withColumn(spans, F.array_sort(F.concat(*each))).drop(bits)


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
