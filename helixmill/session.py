"""Session construction and durable intermediates."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from helixmill.errors import ConfigurationError


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that every result of the engine assumes."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("helixmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where all tasks run in the driver's own process (tests, a laptop) and none is named is a
    temporary folder made; on a cluster a missing setting is an error.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ConfigurationError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="helixmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    Parquet keeps the columns compressed and prunable; the copy is removed when the
    driver ends, and an executor that is lost takes nothing of it along.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helixmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone
        pass
