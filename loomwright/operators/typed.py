"""Typed metadata: VARIANT columns whose numbers compare as numbers, with hot keys as columns of their own types.

A comparison holds between values of one kind only: numbers with numbers, texts with texts, truth values with truth values; a value of another
kind, or none, meets no comparison but `!=`, `not in` and equality with None.  Hot keys are stored beside the VARIANT, so filters on them reach the Parquet scan.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of hot keys, by the type of their column.
KINDS = {"long": "number", "int": "number", "double": "number", "decimal": "number", "string": "text", "boolean": "truth"}
_NUMBER = "decimal(38,12)"


def as_variant(struct: Column) -> Column:
    """A struct's fields, with their types, as one VARIANT; null fields are JSON nulls."""
    return F.to_variant_object(struct)


def from_json(text: Column) -> Column:
    """The VARIANT of a JSON text; null for one that is none."""
    return F.try_parse_json(text)


def _path(field: str) -> str:
    quote = next((q for q in "\"'" if q not in field), None)
    if quote is None:
        raise ValueError(f"a key with both quotation marks has no path: {field}")
    return f"$[{quote}{field}{quote}]"


def shredded(rows: DataFrame, hot: dict[str, str], meta: str = "meta") -> DataFrame:
    """rows with a column `meta_<key>` of the given type for each hot key; a value of another kind leaves a null there."""
    return rows.withColumns({f"{meta}_{key}": _typed(F.col(meta), key, KINDS[kind.split("(")[0]]).cast(kind) for key, kind in hot.items()})


def _kind_of(value: Any) -> str:
    if isinstance(value, bool):
        return "truth"
    if isinstance(value, (int, float, Decimal)):
        return "number"
    if isinstance(value, str):
        return "text"
    raise ValueError(f"a filter cannot compare {type(value).__name__}")


def _typed(meta: Column, field: str, kind: str) -> Column:
    """The field's value if it is of that kind, else null."""
    own = F.try_variant_get(meta, _path(field), "variant")
    name = F.schema_of_variant(own)
    pattern, target = {"number": "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$", "text": "^STRING$", "truth": "^BOOLEAN$"}[kind], {"number": _NUMBER, "text": "string", "truth": "boolean"}[kind]
    return F.when(name.rlike(pattern), F.try_variant_get(meta, _path(field), target))


def _literal(value: Any) -> Column:
    return F.lit(Decimal(str(value)) if isinstance(value, float) else value)


def where_typed(node: dict, hot: dict[str, str] | None = None, meta: str = "meta") -> Column:
    """A condition from {field, operator, value} comparisons under AND, OR and NOT with `conditions`; it is never null.

    `hot` are the keys that `shredded` made columns of, with their types.
    """
    hot, op = hot or {}, node["operator"]
    if op in ("AND", "OR"):
        parts = [where_typed(c, hot, meta) for c in node["conditions"]]
        return reduce((lambda a, b: a & b) if op == "AND" else (lambda a, b: a | b), parts)
    if op == "NOT":
        return ~reduce(lambda a, b: a & b, [where_typed(c, hot, meta) for c in node["conditions"]])
    field, value = node["field"].removeprefix("meta."), node["value"]

    def compared(one: Any, how) -> Column:
        kind = _kind_of(one)
        if field not in hot:
            return F.coalesce(how(_typed(F.col(meta), field, kind), _literal(one)), F.lit(False))
        own = F.col(f"{meta}_{field}")
        return own.isNotNull() & how(own, _literal(one)) if KINDS[hot[field].split("(")[0]] == kind else F.lit(False)  # a form that reaches the scan

    def equals(one: Any) -> Column:
        if one is None:
            there = F.col(f"{meta}_{field}") if field in hot else F.try_variant_get(F.col(meta), _path(field), "string")
            return there.isNull()
        return compared(one, lambda a, b: a == b)

    def among(values) -> Column:
        return reduce(lambda a, b: a | b, map(equals, values), F.lit(False))

    ways = {
        "==": lambda: equals(value), "!=": lambda: ~equals(value), "in": lambda: among(list(value)), "not in": lambda: ~among(list(value)),
        ">": lambda: compared(value, lambda a, b: a > b), ">=": lambda: compared(value, lambda a, b: a >= b), "<": lambda: compared(value, lambda a, b: a < b), "<=": lambda: compared(value, lambda a, b: a <= b),
    }
    if op not in ways:
        raise ValueError(f"unknown operator {op}")
    return ways[op]()


def where_equal(filters: dict[str, Any] | None, hot: dict[str, str] | None = None, meta: str = "meta") -> Column:
    """All of the filters: a value equals, a list has it among its own; no filters keep all."""
    nodes = [{"field": k, "operator": "in" if isinstance(v, (list, tuple, set)) else "==", "value": v} for k, v in (filters or {}).items()]
    return reduce(lambda a, b: a & b, (where_typed(n, hot, meta) for n in nodes), F.lit(True))
