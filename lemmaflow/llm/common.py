"""What the operators of this subpackage share."""

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these ASCII spaces.
SPACES = " \t\n\x0b\x0c\r"
#: Flags of a broadcast set that says which rows may have a key.
FLAGS = 1 << 20
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; what is there goes when the application ends.

    Where no such folder is set, the path is a local one, if Spark runs in one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"file://{tempfile.gettempdir()}/lemmaflow-scratch"
    own = f"{root.rstrip('/')}/lemmaflow/{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(target)
    store.deleteOnExit(target)
    return f"{own}/data"


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder, in row groups that take little memory, and reads it back."""
    path = scratch(df.sparkSession)
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 200) -> None:
    """From now on, Arrow batches of the session hold at most so many rows; whole texts make larger ones costly."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(rows, int(spark.conf.get(key)))))


def set_apart(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have one of ``keys`` (one column, distinct or not), and the rest, which surely haven't.

    Told by a set of FLAGS flags at most, which is broadcast; so the rest needs no shuffle.
    """
    name = unused("flag", rows)
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(FLAGS)).cast("int").alias(name)
    flags = F.broadcast(keys.select(of(F.col(keys.columns[0]))).distinct())  # FLAGS rows at most
    marked = rows.select("*", of(key))
    return tuple(marked.join(flags, name, how).select(rows.columns) for how in ("left_semi", "left_anti"))


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: What operators keep in a Python worker from task to task, by operator.
KEPT_IN_WORKER: dict[str, dict] = {}


def release(own: str = "") -> None:
    """Gives a Python worker's freed memory back to the system, as workers are kept for later stages.

    What other operators than ``own`` keep in the worker goes first: their stages are over.
    """
    for name, held in KEPT_IN_WORKER.items():
        if name != own:
            held.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def unused(name: str, df: DataFrame) -> str:
    """``name``, or with underscores what no column of ``df`` is called (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
