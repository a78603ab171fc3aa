"""Writers of datasets, failures, metrics and reports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False, omit_nulls: list[str] | None = None) -> None:
    """JSON lines; nulls are written, except those of ``omit_nulls``, which are left out of their line."""
    omit = set(omit_nulls or [])
    always = [c for c in df.columns if c not in omit]
    line = F.to_json(F.struct(*always), {"ignoreNullFields": "false"})
    if omit:
        rest = F.to_json(F.struct(*[c for c in df.columns if c in omit]))
        line = F.when(rest == "{}", line).otherwise(F.concat(F.substr(line, F.lit(1), F.length(line) - 1), F.lit(","), F.substr(rest, F.lit(2))))
    df.select(line.alias("value")).write.mode("append" if append else "overwrite").text(path)


def report_json(rows: DataFrame, aggregate: DataFrame) -> DataFrame:
    """One row: {"rows": [...], "aggregate": {...}}. Meant for reports of run records, a row per log file."""
    listed = rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("rows"))
    return listed.crossJoin(aggregate.select(F.struct(*aggregate.columns).alias("aggregate"))).select(F.to_json(F.struct("rows", "aggregate")).alias("report"))


def metrics_json(metrics: DataFrame) -> DataFrame:
    """One row for each of a few metric rows: the row as readable JSON, nulls included."""
    return metrics.select(F.to_json(F.struct(*metrics.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def _store(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def batch_path(path: str, batch_id: int) -> str:
    """Where ``write_once`` puts a batch's rows."""
    return f"{path}/data/batch={batch_id:012d}"


def write_once(rows: DataFrame, path: str, batch_id: int, by: str | None = None) -> None:
    """A micro-batch under its number, with a manifest of its stamp, row count and digest; one that is there already is left.

    Rows come first, into a folder of their own that a failed try may have left, the manifest last, by a rename. Readers
    take the folders that have a manifest, so a batch that is replayed adds nothing. With ``by``, the one other column is
    written as lines of text, in a folder for each value.
    """
    spark, batch = rows.sparkSession, f"batch={batch_id:012d}"
    store, manifest = _store(spark, f"{path}/manifest/{batch}")
    if store.exists(manifest):
        return
    data = batch_path(path, batch_id)
    if by:
        rows.write.partitionBy(by).mode("overwrite").text(data)
        kept = spark.read.text(data).select("value", F.col(by).cast("string"))
    else:
        rows.write.mode("overwrite").parquet(data)
        kept = spark.read.schema(rows.schema).parquet(data)
    told = kept.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in kept.columns])), F.lit(0)).alias("digest"))
    told = told.select(F.lit(batch_id).cast("long").alias("batch_id"), F.unix_timestamp().alias("stamp"), "n_rows", "digest")
    told.coalesce(1).write.mode("overwrite").json(f"{path}/told/{batch}")
    store.mkdirs(manifest.getParent())
    if not store.rename(_store(spark, f"{path}/told/{batch}")[1], manifest):
        raise OSError(f"the manifest of {batch} can't be put in place under {path}")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, stamp, n_rows, digest of the micro-batches that are whole."""
    return spark.read.schema("batch_id long, stamp long, n_rows long, digest long").json(f"{path}/manifest/*")


def read_once(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows that ``write_once`` has put there whole; with a ``schema``, none where there is nothing yet."""
    store, manifest = _store(spark, f"{path}/manifest")
    if schema and not store.exists(manifest):
        return spark.createDataFrame([], schema)
    whole = manifests(spark, path).select(F.format_string("batch=%012d", "batch_id").alias("_batch"))
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/data/*")
    own = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(batch=\d+)/", 1)
    return rows.withColumn("_batch", own).join(whole, "_batch", "left_semi").drop("_batch")


def write_artifacts(rows: DataFrame, path: str, batch_id: int, by: str = "request_id") -> None:
    """JSON lines in a folder for each value of ``by``, under a folder of the batch whose manifest has stamp, count and digest."""
    line = F.to_json(F.struct(*[c for c in rows.columns if c != by])).alias("line")
    write_once(rows.select(by, line), path, batch_id, by)
