"""Runs to datasets: proof sources and their fallbacks, outcomes of runs, labelled rows, failures with details.

Logs come as lines (source, msg_pos, raw) in order, solver outputs as texts (source, text), runs as source,
timed_out, exit_code. All is joined by source and clause.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.operators import labeling
from lemmaflow.sources import messages as logs

START, END = "SZS output start CNFRefutation", "SZS output end CNFRefutation"
SUCCESS = r"SZS\s+status\s+(Theorem|Unsatisfiable)\b"


def read_outputs(spark: SparkSession, runs: DataFrame, path: str) -> DataFrame:
    """source, text of each run's solver output by file_name; bytes that aren't UTF-8 are left out, missing files are empty."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "content")
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "")
    return runs.select("source", "file_name").join(files, "file_name", "left").select("source", F.coalesce(text, F.lit("")).alias("text"))


def block_ids(lines: DataFrame) -> DataFrame:
    """source, clause_id of ``tcf(c_N,`` lines in a log's first refutation block; an open block reaches to the end."""
    starts = lines.where(F.contains("raw", F.lit(START))).groupBy("source").agg(F.min("msg_pos").alias("start"))
    inside = lines.join(starts, "source").where("msg_pos >= start")
    ends = inside.where(F.contains("raw", F.lit(END))).groupBy("source").agg(F.min("msg_pos").alias("stop"))
    kept = inside.join(ends, "source", "left").where("stop is null or msg_pos < stop")
    number = F.regexp_extract("raw", r"tcf\(c_(\d+),", 1)
    return kept.where(number != "").select("source", number.cast("bigint").alias("clause_id")).distinct()


def proof_ids(messages: DataFrame, lines: DataFrame, outputs: DataFrame) -> DataFrame:
    """source, clause_id: of the proof messages, or else of the log's refutation block, or else of the output's."""
    told = logs.tagged_ids(messages, ["proof_out"]).select("source", "clause_id", F.lit(1).alias("rank")).distinct()
    logged = block_ids(lines).withColumn("rank", F.lit(2))
    printed = outputs.select("source", F.explode(logs.proof_ids_of_text(F.col("text"))).alias("clause_id"), F.lit(3).alias("rank"))
    found = told.unionByName(logged).unionByName(printed)
    best = found.groupBy("source").agg(F.min("rank").alias("rank"))
    return found.join(best, ["source", "rank"]).select("source", "clause_id")


def run_outcomes(runs: DataFrame, messages: DataFrame, lines: DataFrame, outputs: DataFrame, simulated: bool = False, strict: bool = False) -> DataFrame:
    """``runs`` with has_log, has_proof, has_szs and reason (null for a success). Simulated runs fail only without a proof.

    ``strict`` takes a log's status only where backslashes stand in it for spaces, as older datasets were made.
    """
    success = SUCCESS.replace("\\", "\\\\") if strict else SUCCESS
    said = lines.groupBy("source").agg(F.lit(True).alias("has_log"), F.bool_or(F.contains("raw", F.lit('"proof_out"'))).alias("has_proof"))
    status = messages.where("tag = 'szs_result_out'").groupBy("source").agg(F.bool_or(F.coalesce("szs_status", F.lit("")).rlike(success)).alias("log_szs"))
    printed = outputs.select("source", (F.contains("text", F.lit("% " + START)) | F.col("text").rlike(r"%\s*" + SUCCESS)).alias("out_szs"))
    no = F.lit(False)
    joined = runs.join(said, "source", "left").join(status, "source", "left").join(printed, "source", "left")
    flags = joined.withColumns({"has_log": F.coalesce("has_log", no), "has_proof": F.coalesce("has_proof", no), "has_szs": F.coalesce("log_szs", no) | F.coalesce("out_szs", no)}).drop("log_szs", "out_szs")
    if simulated:
        return flags.withColumn("reason", F.when(~F.col("has_proof") & ~F.col("has_szs"), "no_proof"))
    return labeling.classify_failure(flags)


def labelled_rows(messages: DataFrame, lines: DataFrame, outputs: DataFrame) -> DataFrame:
    """The clause index of each log with label, neg_bucket, and born, conj_dist, horn, unit from its features."""
    flags = logs.membership(messages).drop("is_proof")
    proofs = proof_ids(messages, lines, outputs).withColumn("is_proof", F.lit(True))
    rows = logs.clause_index(logs.register_rows(messages)).join(flags, ["source", "clause_id"], "left").join(proofs, ["source", "clause_id"], "left")
    names = ["is_proof", "is_given", "is_simplified", "is_passive"]
    rows = rows.withColumns({n: F.coalesce(n, F.lit(False)) for n in names})
    feature = lambda name, kind: F.get_json_object("features", f"$.{name}").try_cast(kind)
    rows = rows.withColumns({"born": feature("born", "bigint"), "conj_dist": feature("conj_dist", "bigint"), "horn": feature("horn", "boolean"), "unit": feature("unit", "boolean")})
    return labeling.label_rows(rows)


def kept_sources(outcomes: DataFrame, keep_failed: bool = False) -> DataFrame:
    """Sources that have a log, and didn't fail unless failures are kept."""
    return outcomes.where("has_log").where(F.lit(keep_failed) | F.col("reason").isNull()).select("source")


def sampled_dataset(rows: DataFrame, messages: DataFrame, kept: DataFrame, window: int = 64, **limits) -> DataFrame:
    """Dataset rows of the kept sources: all positives once, sampled negatives, with part (see ``sample_negatives``)."""
    own = rows.join(kept, "source", "left_semi").withColumnRenamed("source", "problem")
    given = logs.tagged_ids(messages, ["given_clause"]).withColumnRenamed("source", "problem")
    chosen = labeling.sample_negatives(own, labeling.last_given(given, window), **limits)
    return chosen.join(own.select("problem", "clause_id", "text", "features", "basic_clause_id"), ["problem", "clause_id"])


def failure_rows(outcomes: DataFrame, rows: DataFrame, messages: DataFrame, window: int = 64) -> DataFrame:
    """A row per failed run: reason, last_given (id, text, in order; null texts of unknown ids) and passive_sample (likewise)."""
    failed = outcomes.where("reason is not null")
    own = rows.join(failed.select("source"), "source", "left_semi").withColumnRenamed("source", "problem")
    given = logs.tagged_ids(messages, ["given_clause"]).join(failed.select("source"), "source", "left_semi").withColumnRenamed("source", "problem")
    last = labeling.last_given(given, window).join(own.select("problem", "clause_id", "text"), ["problem", "clause_id"], "left")
    in_order = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("clause_id").alias("id"), "text"))), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))).alias(name)
    sample = labeling.passive_sample(own).select("problem", "clause_id", "text", "rank")
    joined = failed.withColumnRenamed("source", "problem").join(last.groupBy("problem").agg(in_order("last_given")), "problem", "left")
    return joined.join(sample.groupBy("problem").agg(in_order("passive_sample")), "problem", "left")
