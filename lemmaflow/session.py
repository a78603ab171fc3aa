"""Session defaults shared by tests, the bench and interactive use."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "lemmaflow", cores: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the submitter's own configuration is used instead."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; what is there goes when the application ends.

    Where no such folder is set, the path is a local one, if Spark runs in one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"file://{tempfile.gettempdir()}/lemmaflow-scratch"
    path = f"{root.rstrip('/')}/lemmaflow/{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(target)
    store.deleteOnExit(target)
    return path


def written_once(df: DataFrame) -> DataFrame:
    """Cuts the lineage of what several branches of a plan read."""
    path = f"{shared_path(df.sparkSession)}/data"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
