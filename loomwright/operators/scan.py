"""Running sums and ordered concatenation over groups of any size, as a distributed scan.

Rows are dealt by ranges of (group, order), so a group that holds a third of all rows is many tasks.  Each task adds up its own rows, one small row a
(group, task) carries what came before, and rows add the two.  The dealt rows are written to the
shared folder, because a task's share must not change between the two passes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import scratch_root


def _name(rows: DataFrame, stem: str) -> str:
    taken = {c.lower() for c in rows.columns}
    while stem in taken:
        stem += "_"
    return stem


def dealt(rows: DataFrame, group: str, order: list[str], tasks: int | None = None) -> tuple[DataFrame, str]:
    """rows with the number of the range that they fall in, and that column's name.  Rows that agree in group and order share a range."""
    spark, part = rows.sparkSession, _name(rows, "scan_part")
    n = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = f"{scratch_root(spark)}/scan-{uuid.uuid4().hex}"
    placed = rows.repartitionByRange(n, group, *order).withColumn(part, F.spark_partition_id())
    placed.write.parquet(at)
    return spark.read.schema(placed.schema).parquet(at), part


def running(rows: DataFrame, group: str, order: list[str], sums: dict[str, Column], tasks: int | None = None) -> DataFrame:
    """rows with, for each name in `sums`, the sum of its value over the group's earlier rows: 0 for the first; nulls count as 0.

    A null group is one of its own, and rows that agree in `order` follow each other in any way, so `order` should tell a group's rows apart.
    Columns of the names are replaced; an empty table stays empty.
    """
    rows = rows.drop(*sums)
    values = {name: _name(rows, f"scan_value_{k}") for k, name in enumerate(sums)}
    placed, part = dealt(rows.withColumns({values[n]: F.coalesce(c, F.lit(0)).cast("long") for n, c in sums.items()}), group, order, tasks)
    key, there = _name(placed, "scan_group"), _name(placed, "scan_there")
    by_part = Window.partitionBy(key).orderBy(there).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(F.col(group).alias(key), F.col(part).alias(there)).agg(*(F.sum(v).alias(v) for v in values.values()))
    carried = totals.select(key, there, *(F.coalesce(F.sum(v).over(by_part), F.lit(0)).alias(f"{v}_before") for v in values.values()))
    inside = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()})
    joined = own.join(carried, own[group].eqNullSafe(F.col(key)) & (own[part] == F.col(there)))
    return joined.select(*rows.columns, *((F.col(n) + F.col(f"{v}_before")).alias(n) for n, v in values.items()))


def concatenated(rows: DataFrame, group: str, order: list[str], parts: dict[str, tuple[Column, str]], counts: dict[str, Column] | None = None, tasks: int | None = None) -> DataFrame:
    """(group, a text for each name in `parts`, a count for each in `counts`): the parts that are not null, in order, with the name's glue between.

    A task joins its own range of a group first, so only one text a range and group, never a group's rows, meet in the end.  A group without parts has an empty text.
    """
    picked = {n: _name(rows, f"scan_text_{k}") for k, n in enumerate(parts)}
    told = {n: _name(rows, f"scan_count_{k}") for k, n in enumerate(counts or {})}
    lean = rows.select(group, *order, *(c.alias(picked[n]) for n, (c, _) in parts.items()), *(F.coalesce(c, F.lit(False)).cast("long").alias(told[n]) for n, c in (counts or {}).items()))
    placed, part = dealt(lean, group, order, tasks)

    def joined(text: Column, at: Column, glue: str) -> Column:
        held = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(at.alias("at"), text.alias("text")))))
        return F.when(F.size(held) > 0, F.array_join(F.transform(held, lambda s: s["text"]), glue))

    ranges = placed.groupBy(group, part).agg(*(joined(F.col(picked[n]), F.struct(*order), glue).alias(picked[n]) for n, (_, glue) in parts.items()), *(F.sum(c).alias(c) for c in told.values()))
    return ranges.groupBy(group).agg(*(F.coalesce(joined(F.col(picked[n]), F.col(part), glue), F.lit("")).alias(n) for n, (_, glue) in parts.items()), *(F.sum(c).alias(n) for n, c in told.items()))
