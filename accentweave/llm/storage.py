"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, in local mode, as in tests, a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
        if not path:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="accentweave-")
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str, narrow: bool = False) -> tuple[DataFrame, str]:
    """Writes a table into the shared folder and reads it back: a short lineage that survives lost executors.

    The shuffle files of the plan that made it are of no more use then and are removed at once. A ``narrow``
    table, of few rows of a few numbers each, is dealt to an eighth of as many files as shuffles have partitions;
    what makes it keeps its own number of tasks.
    No ``_SUCCESS`` is written: only the caller reads the table, once it stands, and the driver spares itself the ``chmod``.
    """
    spark = df.sparkSession
    if narrow:
        df = df.repartition(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path), path


def gathered(df: DataFrame) -> DataFrame:
    """``df``, of small rows, dealt evenly to an eighth of as many files as shuffles have partitions, for :func:`stash`.

    Where Spark adapts its plans, there are fewer files of a small table and more of a large one. Each file that an executor
    writes to a local path makes Hadoop spawn ``chmod`` several times; until such a child has begun its own
    program, whatever adds up the memory of an executor and its children counts the executor twice.
    """
    return df.hint("rebalance", max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bounds the Arrow batches that Python workers get, so that long texts do not pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
