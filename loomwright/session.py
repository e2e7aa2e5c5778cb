"""What a session needs before its executors run this package's Python functions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()

#: Bytes of an Arrow batch beside Spark's own bound in rows, which says nothing of long texts.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once an application; they need no path of the driver's.

    The session's Arrow batches are bounded by BATCH_BYTES unless it sets a lower bound: one batch of whole texts has to fit beside a
    worker's own memory.  No other setting of the session is touched.
    """
    sc = spark.sparkContext
    bound = sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_KEY))  # 64m, 1g and the like
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="loomwright-src-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)
    return spark


#: Tables of at most so many bytes may be dealt to all cores.
SMALL = 32 << 20


def spread(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df dealt to all cores if its files are small: one row group is one task, however many cores there are.

    Larger tables have row groups enough and are left as they are, so what is shuffled is bounded by `most`.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it; a temporary one in local mode where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="loomwright-")
    return _OWN[app]
