"""Shared plumbing: scratch tables in the shared folder, table reading, sample hashing."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import scratch_root

class Scratch:
    """Written tables that cut lineage; a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.at = spark, f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written as Parquet under the shared folder and read back."""
        path = f"{self.at}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str | None = None) -> None:
        """Delete one table, or all of them."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}" if name else self.at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def _at_exit(self) -> None:
        if getattr(self.spark.sparkContext, "_jsc", None) is not None:  # a stopped session's shared folder is its cluster's to clear
            with contextlib.suppress(ConnectionError, Py4JError):  # the JVM may have gone first
                self.drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo `modulus`; a null id falls in class 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that starts with `stem` and clashes with none of df's, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def fresh_prefix(df: DataFrame, stem: str) -> str:
    """A prefix that starts with `stem` and that no column of df has, whatever the case."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem += "_"
    return stem


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """A written table with a broadcast hint if it has at most `most` rows, else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: The most bits of a filter of ids; its table has a 64th as many rows of 16 bytes, and with more than an eighth as many ids it would let most through.
FILTER_BITS = 27


def may_hold(docs: DataFrame, ids: DataFrame, doc_id: str) -> tuple[DataFrame, Column]:
    """docs with two more columns, and whether a row's id may be among `ids`, a written table with one column of that name.

    The test is a bit filter, broadcast as a table of at most 2**(FILTER_BITS - 6) words; 16 to 32 bits an id, so that few others pass.
    Ids beyond its bound are not filtered: every row may hold one of them.  A null id holds none.
    """
    n = ids.count()
    if 8 * n > 1 << FILTER_BITS:
        return docs, F.col(doc_id).isNotNull()
    bits = min(max((32 * n).bit_length(), 8), FILTER_BITS)
    word, mask = fresh(docs, "filter_word"), fresh(docs, "filter_mask")
    bit = F.shiftrightunsigned(F.xxhash64(F.col(doc_id)), 64 - bits)
    own = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    table = ids.select(F.shiftright(bit, 6).alias(word), own.alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask))
    told = docs.withColumn(word, F.shiftright(bit, 6)).join(F.broadcast(table), word, "left")
    return told, F.col(doc_id).isNotNull() & F.coalesce(F.col(mask).bitwiseAND(own) != 0, F.lit(False))


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once however often `then` reads it."""
    return F.element_at(F.transform(F.array(value), then), 1)
