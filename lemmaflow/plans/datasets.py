"""Queries from log lines to datasets and failure rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.operators import dataset
from lemmaflow.plans.registry import CL, SAMPLED, clause_log, query
from lemmaflow.session import written_once
from lemmaflow.sources import messages as logs


def log_lines(spark, sf_dir: str) -> DataFrame:
    """Lines of each problem's log: a message that registers a clause, and the messages that name it.

    By the problem's number mod 4, proofs are told by messages, printed by the solver, in a block of the log's own, or nowhere.
    """
    log = clause_log(spark, sf_dir)
    features = F.struct("born", "conj_dist", "horn", "unit", "basic_clause_id")
    clause = F.struct("clause_id", F.col("text").alias("clause"), features.alias("clause_features"))
    register = F.to_json(F.struct(F.lit("register_clauses").alias("tag"), F.array(clause).alias("clauses")))
    named = lambda tag, of: F.to_json(F.struct(F.lit(tag).alias("tag"), F.array(of).alias("clause_ids")))
    told, blocks = F.col("problem") % 4 == 0, F.col("problem") % 4 == 2
    lines = F.array(
        register,
        F.when(F.col("is_given"), named("given_clause", F.col("clause_id"))),
        F.when(F.col("is_passive"), named("passive_clauses", F.col("clause_id"))),
        F.when(F.col("is_simplified"), named("simplified_clauses", F.col("clause_id").cast("string"))),
        F.when(told & F.col("is_proof"), named("proof_out", F.col("clause_id").cast("string"))),
        F.when(blocks & F.col("is_proof"), F.concat(F.lit("tcf(c_"), F.col("clause_id"), F.lit(",plain,x)"))),
    )
    own = log.select(F.col("problem").alias("source"), "born", "is_proof", F.posexplode(lines).alias("at", "raw")).where("raw is not null")
    # A block's lines stand together at the end.
    place = F.when(F.col("raw").startswith("tcf("), F.lit(10**9)).otherwise(0) + 10 * F.col("born") + F.col("at")
    rows = own.select("source", place.alias("msg_pos"), "raw")
    ends = log.where(blocks).select(F.col("problem").alias("source")).distinct()
    line = lambda pos, raw: F.struct(F.lit(pos).cast("long").alias("msg_pos"), F.lit(raw).alias("raw"))
    status = '{"tag":"szs_result_out","szs_status":"% SZS status Theorem for x"}'
    extra = F.array(line(10**9 - 1, "% " + dataset.START), line(2 * 10**9, "% " + dataset.END), line(2 * 10**9 + 1, status))
    return rows.union(ends.select("source", F.inline(extra)))


def solver_outputs(spark, sf_dir: str) -> DataFrame:
    proofs = clause_log(spark, sf_dir).where("is_proof and problem % 4 = 1")
    listed = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("tcf(c_"), F.col("clause_id"), F.lit(",plain,x)")))), "\n")
    text = F.concat(F.lit("% SZS status Theorem\n% " + dataset.START + "\n"), listed, F.lit("\n% " + dataset.END + "\ntcf(c_1,plain,x)"))
    return proofs.groupBy(F.col("problem").alias("source")).agg(text.alias("text"))


def _parts(spark, sf_dir: str):
    lines, outputs = written_once(log_lines(spark, sf_dir)), solver_outputs(spark, sf_dir)
    messages = logs.parse_messages(lines)
    runs = lines.select("source").distinct().select("source", (F.col("source") % 7 == 0).alias("timed_out"), F.when(F.col("source") % 5 == 0, 1).otherwise(0).alias("exit_code"))
    return lines, messages, outputs, dataset.run_outcomes(runs, messages, lines, outputs)


#: Problems without a purchase have no proof anywhere. Where nothing tells of a proof, all clauses are negatives.
TOLD = """, outcome AS (SELECT problem, CASE WHEN problem % 7 = 0 THEN 'timeout'
      WHEN problem % 4 = 2 OR (problem % 4 = 1 AND bool_or(event_type = 'purchase')) THEN NULL
      WHEN problem % 5 = 0 THEN 'iprover_error' WHEN problem % 4 = 0 AND bool_or(event_type = 'purchase') THEN NULL ELSE 'no_proof' END AS reason FROM e GROUP BY problem)"""
NO_PROOF = CL.replace("event_type = 'purchase' AS is_proof", "event_type = 'purchase' AND problem % 4 <> 3 AS is_proof")


@query(NO_PROOF + " SELECT problem, clause_id, label, neg_bucket, basic_clause_id, born, text FROM labelled")
def dataset_from_log(spark, sf_dir):
    lines, messages, outputs, _ = _parts(spark, sf_dir)
    rows = dataset.labelled_rows(messages, lines, outputs)
    return rows.select(F.col("source").alias("problem"), "clause_id", "label", "neg_bucket", "basic_clause_id", "born", "text")


@query(CL + TOLD + " SELECT * FROM outcome")
def run_outcomes(spark, sf_dir):
    return _parts(spark, sf_dir)[3].select(F.col("source").alias("problem"), "reason")


@query(
    NO_PROOF
    + TOLD
    + SAMPLED
    + """ SELECT every.problem, every.clause_id, every.label, every.neg_bucket, part, c.text FROM every JOIN outcome o ON o.problem = every.problem AND reason IS NULL
      JOIN clause_log c ON c.clause_id = every.clause_id"""
)
def sampled_dataset(spark, sf_dir):
    lines, messages, outputs, outcomes = _parts(spark, sf_dir)
    rows = dataset.labelled_rows(messages, lines, outputs)
    got = dataset.sampled_dataset(rows, messages, dataset.kept_sources(outcomes), window=4, mult=1)
    return got.select("problem", "clause_id", "label", "neg_bucket", "part", "text")


@query(
    CL
    + TOLD
    + """, g AS (SELECT problem, clause_id, text, row_number() OVER (PARTITION BY problem ORDER BY born DESC) AS r FROM clause_log WHERE is_given),
    lg AS (SELECT problem, string_agg(clause_id || ':' || text, ' ' ORDER BY r DESC) AS last_given FROM g WHERE r <= 4 GROUP BY problem),
    s AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY CASE WHEN horn THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - 0.001::DOUBLE * born - 0.0001::DOUBLE * conj_dist DESC, clause_id) AS r
      FROM clause_log WHERE is_passive AND NOT is_given AND NOT is_simplified),
    ps AS (SELECT problem, string_agg(clause_id || ':' || text, ' ' ORDER BY r) AS passive_sample FROM s WHERE r <= 8 GROUP BY problem)
    SELECT o.problem, reason, last_given, passive_sample FROM outcome o LEFT JOIN lg ON lg.problem = o.problem LEFT JOIN ps ON ps.problem = o.problem WHERE reason IS NOT NULL"""
)
def failure_rows(spark, sf_dir):
    lines, messages, outputs, outcomes = _parts(spark, sf_dir)
    rows = dataset.failure_rows(outcomes, dataset.labelled_rows(messages, lines, outputs), messages, window=4)
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["id"], x["text"])), " ").alias(c)
    return rows.select("problem", "reason", joined("last_given"), joined("passive_sample"))
