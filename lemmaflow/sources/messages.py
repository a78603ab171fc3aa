"""Readers of event logs, predictions, score maps, problem lists and solver logs."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemmaflow.operators import ordering

MESSAGE = (
    "tag string, clauses array<struct<clause_id:string,clause:string,clause_features:string>>, clause_ids array<string>,"
    " cause_ids array<string>, component string, component_id string, scores array<double>,"
    " sat_lit_gr_vals array<array<boolean>>, status string, szs_status string, result string"
)


def parse_messages(lines: DataFrame) -> DataFrame:
    """``lines`` (source, msg_pos, raw) with the message's columns; rows that aren't one JSON object go."""
    raw = F.regexp_replace("raw", r"(?U)^[\s\x00]+|[\s\x00]+$", "")
    # Where the array of the text has one element, it isn't two objects in a row.
    single = F.coalesce(F.json_array_length(F.concat(F.lit("["), F.regexp_replace("raw", r"\bNaN\b", "null"), F.lit("]"))) == 1, F.lit(False))
    read = lines.withColumn("raw", raw).where(F.col("raw").startswith("{") & single)
    return read.withColumn("m", F.from_json("raw", MESSAGE, {"allowNonNumericNumbers": "true"})).where("m is not null").select("source", "msg_pos", "raw", "m.*")


@F.arrow_udf(T.StringType())
def _without_bad_bytes(values: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.decode("utf-8", "ignore") for x in values.to_pylist()], pa.string())


def decoded(value: Column) -> Column:
    """A text as it was read, without bytes that are no UTF-8; only texts that have some are decoded anew."""
    bad = F.when(~F.is_valid_utf8(value), value.cast("binary"))
    return F.coalesce(_without_bad_bytes(bad), value)


def without_doubled_requests(messages: DataFrame) -> DataFrame:
    """``messages`` without repeated requests: a log has a request when it comes, and again when it is answered.

    Between two answers of a log, requests that are alike in ids and component count once.
    """
    before = Window.partitionBy("source").orderBy("msg_pos").rowsBetween(Window.unboundedPreceding, -1)
    stretch = messages.withColumn("_stretch", F.coalesce(F.sum(F.when(F.col("tag") == "scores_res", 1).otherwise(0)).over(before), F.lit(0)))
    alike = Window.partitionBy("source", "_stretch", "tag", "clause_ids", "component", "component_id").orderBy("msg_pos")
    again = F.coalesce(F.col("tag") == "scores_req", F.lit(False)) & (F.row_number().over(alike) > 1)
    return stretch.withColumn("_again", again).where("not _again").drop("_stretch", "_again")


def read_event_logs(spark: SparkSession, path: str) -> DataFrame:
    """Messages of NUL- or newline-delimited JSON logs; order within a file is (segment, line).

    Files are split at NUL bytes by the scan, so that a large log is read by many tasks; a segment's place is the offset
    of its split and its place therein.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    segments = spark.read.option("lineSep", "\u0000").text(path).select(F.col("_metadata.file_path").alias("source"), place.alias("segment"), decoded(F.col("value")).alias("value"))
    lines = segments.select("source", "segment", F.posexplode(F.split("value", r"\r\n|[\r\n]")).alias("line", "raw")).where(F.trim("raw") != "")
    return parse_messages(lines.select("source", F.struct("segment", "line").alias("msg_pos"), "raw"))


def register_rows(messages: DataFrame) -> DataFrame:
    """One row per registered clause: source, pos, clause_id, text, features (JSON), component, component_id."""
    of = messages.where("tag = 'register_clauses'").select("source", "msg_pos", "component", "component_id", F.posexplode("clauses").alias("item_pos", "c"))
    return of.select(
        "source",
        F.struct("msg_pos", "item_pos").alias("pos"),
        F.expr("try_cast(c.clause_id AS bigint)").alias("clause_id"),
        F.col("c.clause").alias("text"),
        F.col("c.clause_features").alias("features"),
        "component",
        F.expr("try_cast(component_id AS bigint)").alias("component_id"),
    ).where("clause_id is not null")


def clause_index(registered: DataFrame) -> DataFrame:
    """The last text and features of each clause, the last component that isn't null, and its first position."""
    basic = F.get_json_object("features", "$.basic_clause_id").try_cast("bigint")
    return registered.groupBy("source", "clause_id").agg(
        F.max_by(F.struct("text", "features"), "pos").alias("last"),
        F.max_by(basic, F.when(basic.isNotNull(), F.col("pos"))).alias("basic_clause_id"),
        F.max_by("component", F.when(F.col("component").isNotNull(), F.col("pos"))).alias("component"),
        F.max_by("component_id", F.when(F.col("component_id").isNotNull(), F.col("pos"))).alias("component_id"),
        F.min("pos").alias("ord"),
    ).select("source", "clause_id", "last.text", "last.features", "basic_clause_id", "component", "component_id", "ord")


def tagged_ids(messages: DataFrame, tags: list[str]) -> DataFrame:
    """source, tag, msg_pos, item_pos, clause_id of messages with one of ``tags``; ids that aren't whole numbers go."""
    ids = messages.where(F.col("tag").isin(tags)).select("source", "tag", "msg_pos", F.posexplode("clause_ids").alias("item_pos", "id"))
    return ids.withColumn("clause_id", F.expr("try_cast(id AS bigint)")).where("clause_id is not null").drop("id")


def membership(messages: DataFrame) -> DataFrame:
    """Flags of each (source, clause_id): is_proof, is_given, is_simplified, is_passive."""
    tags = {"proof_out": "is_proof", "given_clause": "is_given", "simplified_clauses": "is_simplified", "passive_clauses": "is_passive"}
    return tagged_ids(messages, list(tags)).groupBy("source", "clause_id").agg(*[F.bool_or(F.col("tag") == t).alias(n) for t, n in tags.items()])


def proof_ids_of_text(text):
    """Ids of ``tcf(c_N,`` lines between the refutation markers; an open block reaches to the end."""
    block = F.regexp_extract(text, r"(?s)SZS output start CNFRefutation(.*?)(?:SZS output end CNFRefutation|\z)", 1)
    ids = F.transform(F.split(block, "\n"), lambda line: F.regexp_extract(line, r"tcf\(c_(\d+),", 1))
    return F.array_sort(F.array_distinct(F.transform(F.filter(ids, lambda x: x != ""), lambda x: x.cast("bigint"))))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank and malformed ones go."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")


def read_score_maps(spark: SparkSession, path: str) -> DataFrame:
    """id, score of all {"scores": [...]} lines; the last one of an id counts."""
    rows = spark.read.schema("scores array<struct<id:bigint,score:double>>").json(path).withColumn("line", F.monotonically_increasing_id())
    one = rows.select("line", F.posexplode("scores").alias("k", "s"))
    return one.groupBy("s.id").agg(F.max_by("s.score", F.struct("line", "k")).alias("score"))


def read_problems(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Problems of a JSON list, or of an object with a list under ``problems``."""
    schema = "problem_name string, file_path string, domain string"
    text = spark.read.text(path, wholetext=True).select("value")
    array = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{schema}>>")).otherwise(F.from_json("value", f"problems array<struct<{schema}>>")["problems"])
    checked = F.when(array.isNull(), F.raise_error(F.lit("neither a list nor an object with problems"))).otherwise(array)
    rows = text.select(F.posexplode(checked).alias("pos", "p")).select("pos", "p.*")
    return rows.orderBy("pos").limit(limit) if limit is not None else rows


def read_solver_logs(spark: SparkSession, folder: str) -> DataFrame:
    """pos, path, text of each *.log in a folder, numbered in order of path."""
    logs = spark.read.option("pathGlobFilter", "*.log").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return ordering.positions(logs.select("path"), [F.col("path")], "pos").join(logs, "path").select("pos", "path", "text")
