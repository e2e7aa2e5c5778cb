"""Nearest neighbours that read few cells: a clustered vector index with exact pruning by the triangle inequality.

Vectors lie in cells around centres, as Parquet partitions whose rows are sorted by their reach, the distance to the centre.  For a query at
distance d of a centre, no row of the cell is nearer than d less the cell's far edge or its near edge less d.  A first pass reads
the cells that promise most until k rows are seen; their k-th distance then rules out every cell that is
bounded beyond it, and within the others the rows whose reach differs from d by more.  So results are those of a
full scan, ties included; how much is skipped depends on how clustered the vectors are, and evenly spread ones skip nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwright.operators.retrieve import best_of, matrix, query_matrix, sound
from loomwright.session import scratch_root

#: Centres at most, bytes of the sample that they are fitted on and of all centres, and rows of a file.
MOST_CELLS, SAMPLE_BYTES, CENTRE_BYTES, FILE_ROWS = 1 << 14, 32 << 20, 16 << 20, 1 << 17
#: Rounds of fitting, queries of a pass, and rounding allowed for in bounds, relative to the distances' size.
ROUNDS, QUERIES, SLACK = 8, 4096, 1e-9


def _to_centres(x: np.ndarray, centres: np.ndarray, step: int = 1 << 10) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and its distance."""
    cell, reach = np.zeros(len(x), np.int32), np.zeros(len(x))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = (part * part).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * part @ centres.T
        cell[at : at + step] = d.argmin(1)
        reach[at : at + step] = np.sqrt(((part - centres[cell[at : at + step]]) ** 2).sum(1))
    return cell, reach


def fit_centres(x: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """n centres of a sample, by Lloyd's rounds from rows that lie far apart; fewer where the sample has fewer different rows."""
    x, rng = np.unique(x, axis=0), np.random.default_rng(seed)
    if len(x) <= n:
        return x
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < n:
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    centres = x[chosen]
    for _ in range(rounds):
        cell, _ = _to_centres(x, centres)
        size = np.bincount(cell, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


class CellIndex:
    """A clustered index in a folder that all executors share: `rows` by cell, and `cells` with centre, near and far edge and size."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        cells = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # at most MOST_CELLS rows of CENTRE_BYTES together
        self.schema = spark.read.parquet(f"{self.path}/shape").schema
        self.cell = np.array([r.cell for r in cells], np.int64)
        self.centres = np.array([r.centre for r in cells], np.float64).reshape(len(cells), -1 if cells else 0)
        self.near, self.far, self.size = (np.array([r[c] for r in cells], np.float64) for c in ("near", "far", "rows"))

    @staticmethod
    def build(vectors: DataFrame, path: str, dimensions: int, vector: str = "embedding", key: str = "id", cells: int | None = None) -> CellIndex:
        """Index all rows with a sound vector; rows without one are in no cell, and other dimensions fail the job.

        Centres, the square root of the number of rows unless told, are fitted on the rows with the smallest hashes of `key`, as many as SAMPLE_BYTES hold.
        Rows are dealt by ranges of cell, reach and key, so a large cell is many files of neighbouring reaches.  Other columns stay with their rows.
        """
        spark = vectors.sparkSession
        rows = sound(vectors, vector, dimensions)
        total = rows.count()
        most = max(1, min(MOST_CELLS, CENTRE_BYTES // (8 * dimensions)))
        sample = rows.select(vector).orderBy(F.xxhash64(key), key).limit(max(1, SAMPLE_BYTES // (8 * dimensions))).collect()
        fitted = fit_centres(np.array([r[0] for r in sample], np.float64).reshape(len(sample), dimensions), min(most, cells or 1 + int(total**0.5)))
        held = spark.sparkContext.broadcast(fitted)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, reach = _to_centres(matrix(batch.column(batch.num_columns - 1)), held.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cell), pa.array(reach)], [*batch.schema.names[:-1], "cell", "reach"])

        with_place = rows.drop("cell", "reach")
        schema = with_place.withColumns({"cell": F.lit(0), "reach": F.lit(0.0)}).schema
        placed = with_place.withColumn("measured_vector", F.col(vector).cast("array<double>")).mapInArrow(place, schema)
        dealt = placed.repartitionByRange(1 + total // FILE_ROWS, "cell", "reach", key).sortWithinPartitions("cell", "reach")
        dealt.write.partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{path}/shape")  # an index without rows has no other file
        own = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("cell").agg(F.min("reach").alias("near"), F.max("reach").alias("far"), F.count("*").alias("rows"))
        known = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(fitted)], "cell int, centre array<double>")
        own.join(F.broadcast(known), "cell").coalesce(1).write.parquet(f"{path}/cells")
        return CellIndex(spark, path)

    def bounds(self, to_centre: np.ndarray) -> np.ndarray:
        """The least distance that a row of each cell can have to queries at these distances of the centres."""
        slack = SLACK * (1 + to_centre + self.far[None, :])
        return np.maximum(np.maximum(to_centre - self.far[None, :], self.near[None, :] - to_centre) - slack, 0)

    def _pass(self, ids: list, q: np.ndarray, to_centre: np.ndarray, wanted: np.ndarray, within: np.ndarray, k: int, key: str, vector: str, query_type: pa.DataType, schema: str) -> DataFrame:
        """Each query's k best rows of its wanted cells; rows whose reach alone puts them beyond `within` are not measured."""
        read = np.flatnonzero(wanted.any(0))
        number = {int(self.cell[c]): c for c in read}
        held = self.spark.sparkContext.broadcast((ids, q, to_centre[:, read], wanted[:, read], within, {cell: i for i, cell in enumerate(number)}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, to_centre, wanted, within, place = held.value
            for batch in batches:
                cells, x, reach = batch.column(1).to_numpy(), matrix(batch.column(3)), batch.column(2).to_numpy()
                for cell in np.unique(cells):
                    rows, at = np.flatnonzero(cells == cell), place[int(cell)]
                    asked = np.flatnonzero(wanted[:, at])
                    d, edge = to_centre[asked, at], within[asked]
                    # The widest ring of reaches that any of the queries needs.
                    slack = SLACK * (1 + d + reach[rows].max())
                    ring = (reach[rows] >= (d - edge - slack).min()) & (reach[rows] <= (d + edge + slack).max())
                    rows = rows[ring]
                    if len(rows):
                        keys = batch.column(0).take(pa.array(rows))
                        row, col, exact = best_of(q[asked], x[rows], keys, k)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in asked[row]], query_type), keys.take(pa.array(col)), pa.array(exact)], schema_names)

        schema_names = [part.split()[0] for part in schema.split(", ")]
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").where(F.col("cell").isin([int(c) for c in self.cell[read]]))
        return rows.select(key, F.col("cell").cast("int"), "reach", F.col(vector).cast("array<double>")).mapInArrow(run, schema)

    def nearest(self, queries: DataFrame, k: int, vector: str = "embedding", key: str = "id", query_key: str = "query_id", query_vector: str = "query_embedding") -> tuple[DataFrame, float]:
        """(query_key, rank, key, distance) as `retrieve.nearest` has them by squared distance, and the share of (query, cell) pairs that were read.

        Queries go in passes of at most QUERIES, neighbours together so that a pass reads few cells; each pass's hits are
        written to the shared folder, so the driver holds one pass of queries at a time.
        """
        spark, root = self.spark, f"{scratch_root(self.spark)}/cells-{uuid.uuid4().hex}"
        kinds = {query_key: dict(queries.dtypes)[query_key], key: self.schema[key].dataType.simpleString()}
        schema = f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, distance double"
        query_type = to_arrow_type(queries.schema[query_key].dataType)
        ranked = F.row_number().over(Window.partitionBy(query_key).orderBy("distance", key))
        asked = queries.where(F.col(query_vector).isNotNull()).select(query_key, F.col(query_vector).cast("array<double>").alias(query_vector))
        held = spark.sparkContext.broadcast(self.centres)

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, _ = _to_centres(matrix(batch.column(1)), held.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [query_key, query_vector, "home"])

        empty = spark.createDataFrame([], f"{query_key} {kinds[query_key]}, rank int, {key} {kinds[key]}, distance double")
        if not len(self.cell):
            return empty, 0.0
        asked = sound(asked, query_vector, self.centres.shape[1])
        asked.mapInArrow(home, f"{query_key} {kinds[query_key]}, {query_vector} array<double>, home int").write.parquet(f"{root}/asked")
        homes = spark.read.parquet(f"{root}/asked")
        passes, read, pairs = [], 0, 0
        for r in homes.groupBy("home").agg(F.count("*").alias("n")).orderBy("home").collect():  # at most MOST_CELLS rows
            if r.n > QUERIES:
                parts = -(-2 * r.n // QUERIES)
                passes += [(F.col("home") == r.home) & (F.pmod(F.xxhash64(query_key), F.lit(parts)) == p) for p in range(parts)]
            elif passes and isinstance(passes[-1], list) and passes[-1][1] + r.n <= QUERIES:
                passes[-1][0].append(r.home)
                passes[-1][1] += r.n
            else:
                passes.append([[r.home], r.n])
        for number, chosen in enumerate(passes):
            ids, q = query_matrix(homes.where(F.col("home").isin(chosen[0]) if isinstance(chosen, list) else chosen).select(query_key, query_vector).collect())
            to_centre = np.sqrt(np.maximum(((q[:, None, :] - self.centres[None]) ** 2).sum(2), 0)) if len(q) * self.centres.size < 1 << 24 else np.array([np.sqrt(((v - self.centres) ** 2).sum(1)) for v in q])
            least = self.bounds(to_centre)
            order = np.lexsort((to_centre, least), axis=1)
            seen = np.take_along_axis(np.broadcast_to(self.size, least.shape), order, 1).cumsum(1)
            first = np.zeros(least.shape, bool)
            np.put_along_axis(first, order, np.c_[np.zeros(len(q)), seen[:, :-1]] < k, 1)
            everywhere = np.full(len(q), np.inf)
            one = self._pass(ids, q, to_centre, first, everywhere, k, key, vector, query_type, schema).withColumn("rank", ranked).where(F.col("rank") <= k).drop("rank")
            one.write.parquet(f"{root}/first/{number}")
            one = spark.read.schema(schema).parquet(f"{root}/first/{number}")
            place, kth = {i: n for n, i in enumerate(ids)}, everywhere
            for r in one.groupBy(query_key).agg(F.max("distance").alias("d"), F.count("*").alias("n")).where(F.col("n") == k).collect():  # a row a query of the pass
                kth[place[r[query_key]]] = r.d**0.5
            rest = (least <= kth[:, None] * (1 + SLACK)) & ~first
            read, pairs = read + int((first | rest).sum()), pairs + first.size
            if rest.any():
                one = one.unionByName(self._pass(ids, q, to_centre, rest, kth * (1 + SLACK), k, key, vector, query_type, schema))
            one.withColumn("rank", ranked).where(F.col("rank") <= k).select(query_key, "rank", key, "distance").write.parquet(f"{root}/hits/{number}")
        hits = spark.read.schema(empty.schema).parquet(*[f"{root}/hits/{n}" for n in range(len(passes))]) if passes else empty
        return hits, read / pairs if pairs else 0.0
