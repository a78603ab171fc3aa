"""Queries of requests, SAT values, fallbacks, finals and names."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lemmaflow.operators import requests
from lemmaflow.plans.formulas import SHAPES, formula_log
from lemmaflow.plans.registry import CL, _read, clause_log, query
from lemmaflow.sources import messages as logs


def _messages(spark, sf_dir, lines):
    """lines: an array of texts of each clause, in order of born."""
    rows = clause_log(spark, sf_dir).select(F.col("problem").alias("source"), "born", F.posexplode(lines).alias("at", "raw"))
    return logs.parse_messages(rows.where("raw is not null").select("source", (10 * F.col("born") + F.col("at")).alias("msg_pos"), "raw"))


def _sat(spark, sf_dir):
    """Every fourth clause has an answer for its id and the next two, with values for two; every other one is ``cause_ids``."""
    k, name = F.col("k"), F.when(F.col("k") % 8 == 0, "cause_ids").otherwise("clause_ids")
    values = F.when(k % 3 == 0, "[[true,false,true],[]]").otherwise("[[false],[true,true]]")
    line = F.concat(F.lit('{"tag":"cls_sat_eval_gr_res","'), name, F.lit('":['), F.col("clause_id"), F.lit(","), F.col("clause_id") + 1, F.lit(","), F.col("clause_id") + 2, F.lit('],"sat_lit_gr_vals":'), values, F.lit("}"))
    return requests.sat_values(_messages(spark, sf_dir, F.array(F.when(k % 4 == 0, line))))


SAT = """, last AS (SELECT problem, max(born) AS born FROM clause_log WHERE k % 4 = 0 GROUP BY problem),
    sat AS (SELECT c.problem, c.clause_id, c.k % 3 = 0 AS first FROM clause_log c JOIN last ON last.problem = c.problem AND last.born = c.born)"""


@query(
    CL
    + SAT
    + """ SELECT problem, clause_id, CASE WHEN first THEN round(2.0::DOUBLE / 3, 6) ELSE 0.0::DOUBLE END AS support FROM sat
      UNION ALL SELECT problem, clause_id + 1, CASE WHEN first THEN NULL ELSE 1.0::DOUBLE END FROM sat UNION ALL SELECT problem, clause_id + 2, NULL FROM sat"""
)
def sat_support(spark, sf_dir):
    one = _sat(spark, sf_dir).select(F.col("source").alias("problem"), F.explode("values").alias("clause_id", "v"))
    return one.select("problem", "clause_id", F.round(requests.sat_support(F.col("v")), 6).alias("support"))


@query(
    CL
    + SAT
    + """, d AS (SELECT problem, sha1('{"' || clause_id || '": [' || CASE WHEN first THEN 'true, false, true' ELSE 'false' END || '], "' || (clause_id + 1) || '": [' || CASE WHEN first THEN '' ELSE 'true, true' END
        || '], "' || (clause_id + 2) || '": []}') AS sat FROM sat)
      SELECT p.problem, coalesce(sat, 'nosat') AS sat FROM (SELECT DISTINCT problem FROM clause_log) p LEFT JOIN d ON d.problem = p.problem"""
)
def cache_keys(spark, sf_dir):
    problems = clause_log(spark, sf_dir).select("problem").distinct()
    met = problems.join(_sat(spark, sf_dir).withColumnRenamed("source", "problem"), "problem", "left")
    key = requests.cache_key(F.array(F.col("problem")), F.lit("x"), F.lit(1), F.col("values"))
    return met.select("problem", key["sat"].alias("sat"))


@query(
    CL
    + """, pool AS (SELECT * FROM clause_log WHERE conj_dist <> 0), own AS (SELECT problem, arg_min(clause_id, ord) AS own FROM clause_log WHERE conj_dist = 0 AND k % 2 = 0 GROUP BY problem),
      f AS (SELECT problem, min(clause_id) AS first, arg_min(clause_id, (length(text), ord)) AS shortest, arg_min(clause_id, (-length(text), ord)) AS longest FROM pool GROUP BY problem)
      SELECT f.problem, first, shortest, longest, coalesce(own, longest) AS conjecture FROM f LEFT JOIN own ON own.problem = f.problem"""
)
def fallback_conjectures(spark, sf_dir):
    log = clause_log(spark, sf_dir)
    found = [requests.fallback_conjecture(log, how).withColumnRenamed("clause_id", how) for how in ("first", "shortest", "longest")]
    some = log.where("conj_dist <> 0 or k % 2 = 0")
    picked = requests.conjectures(some, "longest").select("problem", F.col("clause_id").alias("conjecture"))
    return found[0].join(found[1], "problem").join(found[2], "problem").join(picked, "problem")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN o_orderstatus IN ('O', 'F') ELSE false END AS is_final FROM orders"""
)
def final_messages(spark, sf_dir):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    tag = F.when(key % 3 == 0, "proof_out").when(key % 3 == 1, "szs_result_out").otherwise("scores_req")
    said = F.when(status == "O", "% SZS status Theorem").when(status == "F", "SZS status GaveUp ").otherwise(F.lit(None))
    return _read(spark, sf_dir, "orders").select("o_orderkey", requests.is_final(tag, said).alias("is_final"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || CASE WHEN o_orderkey % 2 = 0 THEN 'prob' || o_orderkey ELSE 'session' END
      || CASE o_orderkey % 4 WHEN 0 THEN '__a_b_c' WHEN 1 THEN '__bi+CE' ELSE '' END || '.log' AS name FROM orders"""
)
def log_names(spark, sf_dir):
    key = F.col("o_orderkey")
    problem = F.when(key % 2 == 0, F.concat(F.lit("dir/prob"), key, F.lit(".p")))
    tag, mode = F.when(key % 4 == 0, "a b/c(!)"), F.when(key % 4 == 1, "bi_then_cross").otherwise("bi_tf")
    return _read(spark, sf_dir, "orders").select("o_orderkey", requests.log_name(F.col("o_orderdate"), problem, tag, mode).alias("name"))


@query(
    CL
    + """ SELECT problem, arg_min(clause_id, born) || ',' || arg_min(clause_id + 1, born) AS clause_ids, 'c' || problem AS component FROM clause_log WHERE k % 4 = 0 AND born > 1 GROUP BY problem"""
)
def raw_log_request(spark, sf_dir):
    """Logs without a request are left out of these, as reading them fails."""
    clause = F.struct("clause_id", F.col("text").alias("clause"))
    register = F.when(F.col("born") == 1, F.to_json(F.struct(F.lit("register_clauses").alias("tag"), F.array(clause).alias("clauses"))))
    asked = F.to_json(F.struct(F.lit("scores_req").alias("tag"), F.array("clause_id", F.col("clause_id") + 1).alias("clause_ids"), F.concat(F.lit("c"), "problem").alias("component")))
    messages = _messages(spark, sf_dir, F.array(register, F.when((F.col("k") % 4 == 0) & (F.col("born") > 1), asked)))
    whole = messages.where("tag = 'scores_req'").select("source").distinct()
    found = requests.raw_log_request(messages.join(whole, "source", "left_semi"))
    return found.select(F.col("source").alias("problem"), F.array_join(F.col("clause_ids").cast("array<string>"), ",").alias("clause_ids"), "component")


#: The shapes without what reading takes off.
BARE = [*SHAPES[:2], "p_%A(f_%A(X0,c_%C),X0)&~q_%B(X1,c_1)", *SHAPES[3:5], "~ q_%B(X0:$i,c_%C)"]


@query(
    CL
    + f""", s AS (SELECT problem, clause_id, [{", ".join(f"'{x}'" for x in BARE)}][k % 6 + 1] AS shape, k FROM clause_log WHERE born = 1)
      SELECT problem, clause_id, replace(replace(replace(shape, '%A', (k % 3)::VARCHAR), '%B', (problem % 4)::VARCHAR), '%C', (k % 5)::VARCHAR) AS formula FROM s"""
)
def raw_log_clauses(spark, sf_dir):
    clause = F.struct("clause_id", F.col("text").alias("clause"))
    log = formula_log(spark, sf_dir).where("born <= 2")
    raw = F.to_json(F.struct(F.lit("register_clauses").alias("tag"), F.array(clause).alias("clauses")))
    messages = logs.parse_messages(log.select(F.col("problem").alias("source"), F.col("born").alias("msg_pos"), raw.alias("raw")))
    return requests.raw_log_clauses(messages).select(F.col("source").alias("problem"), "clause_id", "formula")


@query(
    """SELECT event_id, epoch_us(ts) // 1000000 AS seconds, epoch_us(ts) // 1000 AS millis, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y%m%d_%H%M%S') AS digits,
      (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id))::DOUBLE / 1000000 AS elapsed FROM events"""
)
def time_stamps(spark, sf_dir):
    """The forms of each event's time, and the seconds since the user's last one."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(micros).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _read(spark, sf_dir, "events").select("event_id", requests.stamps(F.col("ts")).alias("s"), ((micros - before) / 1000000).alias("elapsed")).select("event_id", "s.*", "elapsed")


@query(
    """SELECT event_id, CASE WHEN k % 10 = 0 THEN 'k=none' ELSE 'k=' || k END || ',source=' || event_type AS merged
      FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
)
def merged_features(spark, sf_dir):
    own = F.from_json("props", "map<string,string>")
    k = F.get_json_object("props", "$.k").cast("long")
    extra = F.when(k % 10 == 0, F.create_map(F.lit("source"), F.col("event_type"), F.lit("k"), F.lit("none"))).otherwise(F.create_map(F.lit("source"), F.col("event_type")))
    entries = F.array_sort(F.transform(F.map_entries(requests.merged(own, extra)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return _read(spark, sf_dir, "events").select("event_id", F.array_join(entries, ",").alias("merged"))


@query(
    CL
    + """, m AS (SELECT problem, born, event_type AS tag, k % 3 AS asks, count(*) FILTER (event_type = 'click') OVER (PARTITION BY problem ORDER BY born ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stretch FROM clause_log)
      SELECT problem, tag, count(*) AS n FROM (SELECT problem, tag, born FROM m WHERE tag <> 'purchase'
        UNION ALL SELECT problem, tag, min(born) FROM m WHERE tag = 'purchase' GROUP BY problem, tag, stretch, asks) GROUP BY problem, tag"""
)
def single_requests(spark, sf_dir):
    """Logs whose requests (three different ones) repeat until they are answered: how many messages of a kind are left."""
    event, k = F.col("event_type"), F.col("k")
    asked = F.to_json(F.struct(F.lit("scores_req").alias("tag"), F.array(k % 3).alias("clause_ids"), F.lit("c").alias("component")))
    answer = F.lit('{"tag":"scores_res","scores":[1.0]}')
    other = F.to_json(F.struct(event.alias("tag")))
    messages = _messages(spark, sf_dir, F.array(F.when(event == "purchase", asked).when(event == "click", answer).otherwise(other)))
    left = logs.without_doubled_requests(messages)
    named = F.when(F.col("tag") == "scores_req", "purchase").when(F.col("tag") == "scores_res", "click").otherwise(F.col("tag"))
    return left.groupBy(F.col("source").alias("problem"), named.alias("tag")).agg(F.count(F.lit(1)).alias("n"))
