"""Session helpers.

Library code never creates a session; it works on whatever session the
caller owns.  ``local_session`` is for tests and the bench only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tillcast") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TILLCAST_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    A private temporary folder is chosen only where the setting is unset and the driver runs the tasks
    itself (master ``local[…]``, as in tests).  On a cluster such a folder would be a different one on every
    machine, so an unset setting raises."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tillcast-ckpt-"))
    return sc.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Set Spark's checkpoint folder to the shared one (see ``shared_folder``) and return it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = shared_folder(spark)
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, tag: str):
    """``df`` written once as Parquet into the shared folder and read back.

    Cuts the lineage like ``cut_lineage``, and readers scan only the columns and row groups they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_version(spark: SparkSession, *paths: str) -> tuple:
    """(file, modification time, length) of every file below the paths, on any file system that Spark reads."""
    path_of, conf, out = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration(), []
    for p in paths:
        path = path_of(p)
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return tuple(sorted(out))


def active_spark() -> SparkSession:
    """The caller's session (the thread's active one, else the process default)."""
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
