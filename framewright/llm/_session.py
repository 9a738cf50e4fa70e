"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to a Python worker; they bound a worker's memory, not the result.
ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of long texts small enough for a worker's memory.

    Spark reads these settings when a plan runs, so they hold for the session. They are only ever lowered, and change how
    rows travel to Python, not what is computed.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(name, None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def unused(name: str, *columns: str) -> str:
    """``name``, made longer until it is none of ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); where it is unset, as in tests, a fresh local one.

    On a cluster it must be set: a folder of one machine is no place for tables that others read.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="framewright-"))
    return sc.getCheckpointDir()


#: Tables that ``written`` has made and nobody has dropped.
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again, which cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """A point from which on ``drop_scratch`` drops tables."""
    return len(_made)


def drop_scratch(spark: SparkSession, mark: int = 0, keep_last: bool = False) -> None:
    """Delete the tables written since ``mark``, but for the last if it is still read."""
    gone = _made[mark : len(_made) - 1 if keep_last else None]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made[mark:] = _made[mark + len(gone) :]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
