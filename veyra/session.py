"""Session helpers: builder defaults, shared scratch space, durable cuts of lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "veyra", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings this library is tuned for; an existing session is returned unchanged."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session with a local master gets a folder of its own
    (tests); a cluster is refused, as a machine-local folder would lose data there."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "veyra-scratch-" + spark.sparkContext.applicationId)
    if not os.path.isdir(own):
        os.makedirs(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it back.

    The result survives the loss of executors (nothing is kept only in executor memory), its plan starts at a
    Parquet scan with exact sizes, and a plan that uses it twice computes it once.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/veyra/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that cut() wrote in this application. Results that rest on them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/veyra/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where costly Python follows and the table is too small to come in that many splits.

    Judged by the planner's size of the scan: a table of as many splits as cores, or of unknown size, stays as it is, so large
    tables see no shuffle here.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores * 2) if size < cores * split else df
