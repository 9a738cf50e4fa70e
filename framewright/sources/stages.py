"""Stages that are computed once: a table is written to the folder that driver and executors share, and read from then on."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: How Parquet files of long arrays are written: sizes are looked at after every few rows, not after 100 or more of them, and
#: row groups are small, so that neither writer nor reader holds many rows.
LONG_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "100", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "100"}


def bound_scans(spark: SparkSession) -> None:
    """Read arrays row by row: the column-wise reader holds 4,096 rows of a nested column at once, whatever their length.

    Spark reads this setting when a plan runs, so it holds for the session. It changes how rows are read, not which.
    """
    spark.conf.set("spark.sql.parquet.enableNestedColumnVectorizedReader", "false")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a fresh local folder, which a cluster does not take."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="framewright-"))
    return sc.getCheckpointDir().rstrip("/")


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def compute_once(spark: SparkSession, name: str, of: list, make: Callable[[], DataFrame], partitions: Callable[[], int] = lambda: 1) -> DataFrame:
    """The table that ``make`` gives, stored under its name and what it depends on (``of``: inputs, settings) in this application.

    The first call computes and writes it, later ones read it, so a chain of operators is not planned into one expression and
    is not run again for each count. A write that broke off has no _SUCCESS file and is done again. What changes in the inputs
    while the application runs is not seen. It is written with at least so many shuffle ``partitions``.
    """
    key = hashlib.sha256(repr(of).encode()).hexdigest()[:24]
    path = f"{shared_folder(spark)}/stages/{spark.sparkContext.applicationId}/{name}-{key}"
    bound_scans(spark)
    if not is_written(spark, path):
        rows = make()
        long = any(t.startswith("array") for _, t in rows.dtypes)
        with spread(spark, partitions()):
            rows.write.mode("overwrite").options(**LONG_ROWS if long else {}).parquet(path)
    return spark.read.parquet(path)


@contextmanager
def spread(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Plans that run in here shuffle to at least so many partitions. A task that sorts more than it has memory for leaves so
    little to a window's rows that they spill hundreds of times, and each spill takes its buffers when it is read back."""
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, str(max(int(was), partitions)))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
