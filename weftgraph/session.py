"""Session factory and the few settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "weftgraph", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and UTC as its zone; cluster settings given by spark-submit win."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (sc.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"weftgraph-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df to the shared checkpoint folder, once, and return what was written, without its lineage.

    The folder goes when the driver ends; that of `instead_of`, a frame that no other frame is derived from any more,
    goes at once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(at(path))
    old = getattr(instead_of, "_written_to", None)
    if old:
        fs.delete(at(old), True)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out
