"""Session helpers shared by every operator: table reading, materialisation, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest serialized size, in bytes, that may be broadcast by a hint of ours.
BROADCAST_BYTES = 8 * 1024 * 1024


def local_session(cores: int = 8, partitions: int = 8, app: str = "sievewright") -> SparkSession:
    """A session for tests and the local bench; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a test-data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class NoSharedFolder(RuntimeError):
    """A cluster session names no folder that all executors share."""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the session names as spark.checkpoint.dir.  Only a session
    whose executors are threads of one machine may do without; it gets a private folder that goes with it."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf is None:
        if not sc.master.startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="sievewright-")
        atexit.register(shutil.rmtree, conf, ignore_errors=True)
    sc.setCheckpointDir(conf)
    return sc._jsc.sc().getCheckpointDir().get()


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop API for a path of any kind."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Folders that materialise() wrote and nobody released yet, by application.
_written: dict[str, list[str]] = {}


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and no executor's
    loss repeats the work.  Used where one computed table feeds several branches.  The folder is deleted
    by release(), or when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievewright-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete what materialise() wrote, from the ``since``-th folder on; results that still read it must
    have been consumed.  Returns how many folders went."""
    mine = _written.get(spark.sparkContext.applicationId, [])
    gone = mine[since:]
    del mine[since:]
    for path in gone:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)
    return len(gone)


@contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables written inside are deleted at the end."""
    mine = _written.setdefault(spark.sparkContext.applicationId, [])
    have = len(mine)
    try:
        yield
    finally:
        release(spark, have)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files are fewer than these: work that takes far longer a row
    than moving the row should not wait for one split.  Plans that shuffle already stay as they are."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)


def size_in_bytes(df: DataFrame) -> int:
    """Upper estimate of the planner: exact for local rows, file sizes for scans."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only where the planner's size stays under the bound; else the planner and
    adaptive execution choose the join."""
    return F.broadcast(df) if size_in_bytes(df) <= BROADCAST_BYTES else df
