"""Filtered exact nearest neighbours for many queries, and what follows them.

Order of steps: filter, top k, score, threshold, diversity.  The threshold and
diversity see the k rows only and nothing is refilled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwright.functions import text as T
from loomwright.schemas import HOT_KEYS, RetrievalSettings

#: Query vectors that one pass over the index carries; more queries take more passes.
QUERY_BLOCK = 4096
#: Bound of a product's rounding error for each dimension, relative to the squared norms.
ROUNDING = 4e-16
#: Products of a query and a row that are held at once, and elements of the rows whose distances are computed again at once.
CELLS = 1 << 18
#: Hits that are broadcast to meet their rows.
HITS = 1 << 20


def _value(field: str, columns: list[str]) -> Column:
    return F.col(field) if field in columns else F.try_element_at(F.col("meta"), F.lit(field))


def where(filters: dict[str, Any] | None, columns: list[str] = HOT_KEYS) -> Column:
    """Conjunction of equalities; a list means any of its values.  No filters keep all."""
    tests = [_value(k, columns).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.coalesce(_value(k, columns) == v, F.lit(False)) for k, v in (filters or {}).items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def where_tree(node: dict, columns: list[str] = HOT_KEYS) -> Column:
    """{field, operator, value} comparisons under AND, OR and NOT with `conditions`."""
    op = node["operator"]
    if op in ("AND", "OR"):
        parts = [where_tree(c, columns) for c in node["conditions"]]
        return reduce((lambda a, b: a & b) if op == "AND" else (lambda a, b: a | b), parts)
    if op == "NOT":
        return ~F.coalesce(reduce(lambda a, b: a & b, [where_tree(c, columns) for c in node["conditions"]]), F.lit(False))
    field, value = _value(node["field"].removeprefix("meta."), columns), node["value"]
    ways = {
        "==": lambda: field.eqNullSafe(F.lit(value)), "!=": lambda: ~field.eqNullSafe(F.lit(value)),
        ">": lambda: field > value, ">=": lambda: field >= value, "<": lambda: field < value, "<=": lambda: field <= value,
        "in": lambda: field.isin(list(value)), "not in": lambda: ~F.coalesce(field.isin(list(value)), F.lit(False)),
    }
    if op not in ways:
        raise ValueError(f"unknown operator {op}")
    return ways[op]()


def where_meta(filters: dict[str, Any], meta: Column) -> Column:
    """Filter after retrieval: every key equal, where a missing key equals only None."""
    return reduce(lambda a, b: a & b, (F.try_element_at(meta, F.lit(k)).eqNullSafe(F.lit(v)) for k, v in filters.items()), F.lit(True))


def vector_error(vector: Column, dimensions: int) -> Column:
    """Why a vector cannot be measured against those of `dimensions`, or null."""
    why = F.when(vector.isNull(), F.lit("no vector")).when(F.size(vector) != dimensions, F.format_string(f"%d dimensions where the others have {dimensions}", F.size(vector)))
    return why.when(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit("elements that are no finite numbers"))


def sound(rows: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """rows whose vector can be measured; one of other dimensions fails the job, others that cannot are left out, as `vector_error` tells."""
    v = F.col(vector)
    size = F.when(F.size(v) == dimensions, True).otherwise(F.raise_error(F.format_string(f"a vector has %d dimensions, the queries {dimensions}", F.size(v))).cast("boolean"))
    return rows.where(v.isNotNull() & F.when(v.isNotNull(), size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def matrix(column: pa.Array) -> np.ndarray:
    """The sound vectors of a batch as rows."""
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def best_of(q: np.ndarray, x: np.ndarray, keys: pa.Array, k: int, metric: str = "l2sq") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k best rows, ties by key.

    A matrix product and the bounds of its rounding errors tell which rows may be among them; their distances are computed again from the rows alone,
    since a product's rounding depends on the shape of the batch, and copies of a vector have to tie wherever they are.
    Queries are taken CELLS products at a time, so memory does not grow with their number.
    """
    place = np.empty(len(x), np.int64)
    place[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(x))
    xx, some = (x * x).sum(1), max(1, CELLS // max(1, len(x)))
    found = []
    for at in range(0, max(1, len(q)), some):
        row, col, exact = _best_of_some(q[at : at + some], x, xx, place, k, metric)
        found.append((row + at, col, exact))
    return tuple(np.concatenate(each) for each in zip(*found))


def _best_of_some(q: np.ndarray, x: np.ndarray, xx: np.ndarray, place: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`best_of` for queries whose products are held at once; xx are the rows' squares, place their order by key."""
    qq, product = (q * q).sum(1), q @ x.T
    if metric == "cosine":
        lengths = np.sqrt(qq)[:, None] * np.sqrt(xx)[None, :]
        d = 1 - np.divide(product, lengths, out=np.zeros_like(product), where=lengths > 0)
    else:
        d = qq[:, None] + xx[None, :] - 2 * product
    # The product's rounding error grows with the vectors' squares, not with their distance.
    error = ROUNDING * (x.shape[1] + 2) * (qq[:, None] + xx[None, :] if metric == "l2sq" else 1)
    n = min(k, len(x))
    edge = np.partition(d + error, n - 1, axis=1)[:, n - 1 : n]
    row, col = np.nonzero(d - error <= edge)
    some = max(1, CELLS // max(1, x.shape[1]))
    parts = [(row[at : at + some], col[at : at + some]) for at in range(0, max(1, len(row)), some)]
    exact = np.concatenate([_measured(q[r], x[c], qq[r], xx[c], metric) for r, c in parts])
    order = np.lexsort((place[col], exact, row))
    row, col, exact = row[order], col[order], exact[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], col[best], exact[best]


def _measured(a: np.ndarray, b: np.ndarray, aa: np.ndarray, bb: np.ndarray, metric: str) -> np.ndarray:
    """Distances of a's rows to b's, whose squares are aa and bb; each follows from its two rows only."""
    if metric == "l2sq":
        return ((a - b) ** 2).sum(1)
    lengths = np.sqrt(aa) * np.sqrt(bb)
    return 1 - np.divide((a * b).sum(1), lengths, out=np.zeros(len(a)), where=lengths > 0)


def query_matrix(rows: list) -> tuple[list, np.ndarray]:
    """Ids and vectors of collected queries; ValueError where vectors differ in dimensions or are no finite numbers."""
    sizes = {len(r[1]) for r in rows}
    if len(sizes) > 1:
        raise ValueError(f"queries differ in dimensions: {sorted(sizes)}")
    q = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
    if not np.isfinite(q).all():
        raise ValueError("a query has elements that are no finite numbers")
    return [r[0] for r in rows], q


def nearest(index: DataFrame, queries: DataFrame, k: int, metric: str = "l2sq", vector: str = "embedding", key: str = "id", query_key: str = "query_id", query_vector: str = "query_embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_key, rank, key, distance): each query's k nearest index rows, ties by key.

    Exact.  Queries go to the index in blocks of checked size as one matrix.  Each Arrow batch of the index hands on the k best of its rows
    for each query, with ties by key; so k rows a query and batch are shuffled, whatever ties there are.

    Queries without a vector have no neighbours, and index rows without one or with null, NaN or infinite elements are nobody's; `vector_error` finds
    them.  Queries of different dimensions or with such elements raise ValueError, and an index row of other dimensions fails the job.
    """
    if metric not in ("l2sq", "cosine"):
        raise ValueError("metric must be l2sq or cosine")
    spark = index.sparkSession
    asked = queries.where(F.col(query_vector).isNotNull())
    total, sizes = asked.agg(F.count("*"), F.collect_set(F.size(query_vector))).first()
    if len(sizes) > 1:
        raise ValueError(f"queries differ in dimensions: {sorted(sizes)}")
    found = None
    kinds = dict(index.dtypes) | {query_key: dict(queries.dtypes)[query_key]}
    query_type = to_arrow_type(queries.schema[query_key].dataType)
    schema = f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, distance double"
    parts = max(1, -(-total // block))
    rows = sound(index, vector, sizes[0]) if sizes else index.limit(0)
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64(query_key), F.lit(parts)) == part).select(query_key, query_vector).collect()  # about `block` rows
        held = spark.sparkContext.broadcast(query_matrix(own))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                row, col, exact = best_of(q, matrix(batch.column(1)), batch.column(0), k, metric)
                yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in row], query_type), batch.column(0).take(pa.array(col)), pa.array(exact)], names=[query_key, key, "distance"])

        one = rows.select(key, F.col(vector).cast("array<double>")).mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy("distance", key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(query_key, "rank", key, "distance")


def with_score(hits: DataFrame, score: str = "score") -> DataFrame:
    return hits.withColumn(score, T.score_of(F.col("distance")))


def over_threshold(hits: DataFrame, least: float | None) -> DataFrame:
    """Hits of at least that score; ranks stay as they were."""
    return hits if least is None else hits.where(F.col("score") >= least)


def diversify(hits: DataFrame, factor: float, content: str = "content", query_key: str = "query_id") -> DataFrame:
    """hits with scores lowered by factor times the greatest word similarity to an earlier rank, ranked anew.

    Candidates keep their order while penalties are found, so this is a join of a query's few hits, then one window.
    """
    if factor == 0:
        return hits
    a = hits.withColumn("w", T.words(F.col(content)))
    earlier = a.select(F.col(query_key).alias("q2"), F.col("rank").alias("r2"), F.col("w").alias("w2"))
    pairs = a.join(earlier, (F.col(query_key) == F.col("q2")) & (F.col("rank") > F.col("r2")), "left")
    most = pairs.groupBy(query_key, "rank").agg(F.coalesce(F.max(T.jaccard(F.array_distinct("w"), F.array_distinct("w2"))), F.lit(0.0)).alias("likeness"))
    scored = hits.join(most, [query_key, "rank"]).withColumn("score", F.col("score") * (1 - F.col("likeness") * factor))
    again = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col("score").desc(), "rank"))
    return scored.withColumn("new_rank", again).withColumnRenamed("rank", "old_rank").withColumnRenamed("new_rank", "rank").select(*hits.columns, "old_rank")


def rerank(hits: DataFrame) -> DataFrame:
    """Hook for a reranker; the identity."""
    return hits


def retrieve(index: DataFrame, queries: DataFrame, settings: RetrievalSettings = RetrievalSettings(), metric: str = "l2sq") -> DataFrame:
    """Hits of (query_id, query_embedding) queries with content and metadata, ranked."""
    kept = index.where(where(settings.filters))
    hits = with_score(nearest(kept, queries, settings.top_k, metric))
    few = queries.limit(HITS // settings.top_k + 1).count() <= HITS // settings.top_k  # hits are at most top_k a query
    joined = (F.broadcast(hits) if few else hits).join(index.drop("embedding"), "id")
    out = diversify(over_threshold(joined, settings.score_threshold), settings.diversity_factor)
    return rerank(out) if settings.rerank else out


def query_error(vector: Column, dimensions: int) -> Column:
    """Why a query cannot be answered, or null."""
    return F.when(vector.isNull(), F.lit("query has no vector")).when(F.size(vector) != dimensions, F.format_string(f"query has %d dimensions, the index {dimensions}", F.size(vector)))


def retrieve_batch(index: DataFrame, queries: DataFrame, dimensions: int, settings: RetrievalSettings = RetrievalSettings(), metric: str = "l2sq") -> tuple[DataFrame, DataFrame]:
    """(hits of the queries that can be answered, (query_id, error) of the others); one bad query does not fail the rest."""
    told = queries.withColumn("error", query_error(F.col("query_embedding"), dimensions))
    return retrieve(index, told.where(F.col("error").isNull()).drop("error"), settings, metric), told.where(F.col("error").isNotNull()).select("query_id", "error")


def envelope(hits: DataFrame, queries: DataFrame, index: DataFrame, settings: RetrievalSettings) -> DataFrame:
    """A row a query: how many rows the whole index has and how many hits remain."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("filtered_count"))
    total = index.agg(F.count("*").alias("total_candidates"))
    joined = queries.select("query_id").join(n, "query_id", "left").crossJoin(F.broadcast(total))  # one row
    return joined.select("query_id", F.lit("vector_similarity").alias("retrieval_method"), "total_candidates", F.coalesce("filtered_count", F.lit(0)).cast("long").alias("filtered_count"), F.lit(settings.top_k).cast("long").alias("top_k"))


def display(hits: DataFrame) -> DataFrame:
    """Rank, score, component or title, heading and preview, cut for a table."""
    head = F.coalesce("heading", F.lit("-"))
    flat = F.replace(F.substring("content", 1, 80), F.lit("\n"), F.lit(" "))
    return hits.select("query_id", "rank", T.fixed(F.col("score")).alias("score"), F.coalesce("component", "title", F.lit("Unknown")).alias("component"), T.truncate(head, 18).alias("heading"), F.when(F.length(flat) >= 80, F.concat(F.substring(flat, 1, 77), F.lit("..."))).otherwise(flat).alias("preview"))
