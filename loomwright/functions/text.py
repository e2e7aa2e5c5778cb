"""Column builders for strings, URLs, sets and vectors; nothing here leaves the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, as Unicode sees it.
_ENDS = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """text without white space at either end; only texts that have some are searched."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, _ENDS, "")).otherwise(text)


def filled(text: Column) -> Column:
    """Whether something is left when white space is stripped; null for a null text."""
    return text.rlike(r"(?U)\S")


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once however often `then` reads it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def offsets(lengths: Column) -> Column:
    """Array of the sums of all lengths before each; null counts as 0.

    Summed in runs of about the cube root of their number and then over the runs, so that no array grows element by element.
    """
    step = "array<int>"

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + F.coalesce(x, F.lit(0))).cast("int").alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))

    zero = F.struct(F.lit(0).alias("sum"), F.array().cast(step).alias("out"))

    def runs(xs: Column) -> Column:
        n = F.ceil(F.cbrt(F.size(xs))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(xs) - 1, n), lambda at: F.aggregate(F.slice(xs, at + 1, n), zero, add))

    def placed(done: Column) -> Column:
        begins = F.aggregate(F.transform(done, lambda r: r["sum"]), zero, add)["out"]
        return F.flatten(F.zip_with(done, begins, lambda r, at: F.transform(r["out"], lambda x: x + at)))

    return let(lengths, lambda xs: F.when(F.size(xs) > 0, let(runs(xs), placed)).otherwise(F.array().cast(step)))


def words(text: Column) -> Column:
    """Lower-cased words between white space; none for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def truncate(text: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(tail))).otherwise(text)


def fixed(value: Column, digits: int = 3) -> Column:
    """The value with so many digits, or N/A where it is null or 0."""
    return F.when(value.isNull() | (value == 0), F.lit("N/A")).otherwise(F.format_string(f"%.{digits}f", value))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def capitalize(text: Column) -> Column:
    """First letter upper case, all others lower; unlike initcap, one word only."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def count_of(text: Column, piece: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def glob_pattern(glob: str) -> str:
    """Regular expression of a shell glob over a whole string; * and ? also match /."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def path_pattern(glob: str) -> str:
    """Regular expression of a path glob that is matched from the right, part by part; ** stands for one part, as * does."""
    parts = []
    for part in (p for p in glob.split("/") if p):
        parts.append("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part.replace("**", "*")))
    return ("^" if glob.startswith("/") else "(^|/)") + "/".join(parts) + "$"


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns), F.lit(False))


def host(url: Column) -> Column:
    """The authority of a URL, port included; empty if there is none."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def last_segment(path: Column) -> Column:
    return F.try_element_at(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(-1))


def no_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity01(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2, and 0 where there is no cosine."""
    return F.coalesce((cosine(a, b) + 1) / 2, F.lit(0.0))


def normalized(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    length = norm(a)
    return F.when(length == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / F.nullif(length, F.lit(0.0))))


def score_of(distance: Column) -> Column:
    """Similarity of a distance: 0.5 for none, else 1 - d / 2 between 0 and 1."""
    return F.when(distance.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2)))


def markdown_mark(level: Column) -> Column:
    return F.repeat(F.lit("#"), level)
