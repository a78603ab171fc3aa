"""Queries of scoring sessions and of whole score requests, over messages made of the events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lemmaflow.plans.formulas import KINDS, NODES, NUMBERED, TAGS, TARGETS, TOKENS, formula_log
from lemmaflow.plans.registry import CL, clause_log, query
from lemmaflow.session import shared_path
from lemmaflow.streaming import agent, sessions

UNKNOWN = 10**12
TWIN = 10**9
#: Events of this number end their session.
LAST = 97


def _written(scores):
    return F.array_join(F.transform(scores, lambda s: F.round(s, 6).cast("decimal(12,6)").cast("string")), ",")


def _session_messages(spark, sf_dir):
    """Purchases ask for earlier clauses and an unknown one, signups start answers, some events end the session, all others
    register two clauses each."""
    w, k = Window.partitionBy("problem").orderBy("born"), F.col("k")
    lag = lambda n: F.lag("clause_id", n).over(w)
    ids = F.array_compact(F.array(lag(1), lag(2), lag(5), lag(1) + TWIN, F.lit(UNKNOWN)))
    tag = F.when(k == LAST, "szs_result_out").when(F.col("event_type") == "purchase", "scores_req").when(F.col("event_type") == "signup", "server_queries_start").otherwise("register_clauses")
    bare, horn = (k % 11 == 0).alias("bare"), F.lit(True).alias("horn")
    first = F.struct("clause_id", "text", F.when(k % 13 != 0, k % 7).cast("int").alias("conj_dist"), horn, bare)
    second = F.struct((F.col("clause_id") + TWIN).alias("clause_id"), F.concat("text", F.repeat(F.lit("|"), (k % 5).cast("int"))).alias("text"), (F.floor(k / 7) % 7).cast("int").alias("conj_dist"), horn, bare)
    rows = clause_log(spark, sf_dir).withColumns({"tag": tag, "ids": ids})
    return sessions.padded(
        rows.select(F.col("problem").alias("session"), F.col("born").alias("pos"), "tag", F.when(tag == "register_clauses", F.array(first, second)).alias("clauses"), "ids", F.when(k == LAST, "% SZS status Theorem").alias("status"))
    )


def session_sql(single_slot: bool, longest: bool, required: bool) -> str:
    newest = "QUALIFY row_number() OVER (PARTITION BY problem, start_pos ORDER BY request_pos DESC) = 1" if single_slot else ""
    other = "arg_max(clause_id, (length(text), -item))" if longest else "min(clause_id)"
    emergency = "NULL::BIGINT" if required else "CASE WHEN (a.start_pos, a.request_pos) >= (em.start_pos, em.request_pos) THEN em.id END"
    return (
        CL
        + f""", m AS (SELECT *, coalesce(sum((k = {LAST})::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch,
          CASE WHEN k = {LAST} THEN 'end' ELSE CASE event_type WHEN 'purchase' THEN 'request' WHEN 'signup' THEN 'start' ELSE 'register' END END AS tag,
          [x FOR x IN [lag(clause_id, 1) OVER w, lag(clause_id, 2) OVER w, lag(clause_id, 5) OVER w, (lag(clause_id, 1) OVER w) + {TWIN}, {UNKNOWN}] IF x IS NOT NULL] AS ids
          FROM clause_log WINDOW w AS (PARTITION BY problem ORDER BY born)),
        reg AS (SELECT problem, epoch, born, 1 AS item, clause_id, text, CASE WHEN k % 13 <> 0 THEN k % 7 END AS d, k % 11 = 0 AS bare FROM m WHERE tag = 'register'
          UNION ALL SELECT problem, epoch, born, 2, clause_id + {TWIN}, text || repeat('|', (k % 5)::INT), (k // 7) % 7, k % 11 = 0 FROM m WHERE tag = 'register'),
        asked AS (SELECT problem, epoch, born AS request_pos, ids, (SELECT min(s.born) FROM m s WHERE s.problem = m.problem AND s.epoch = m.epoch AND s.tag = 'start' AND s.born > m.born) AS start_pos
          FROM m WHERE tag = 'request'),
        a AS (SELECT * FROM asked WHERE start_pos IS NOT NULL {newest}),
        one AS (SELECT problem, epoch, request_pos, start_pos, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM a),
        met AS (SELECT one.*, r.clause_id IS NOT NULL AS known, r.d, r.text FROM one
          LEFT JOIN reg r ON r.problem = one.problem AND r.epoch = one.epoch AND r.clause_id = id AND r.born < start_pos),
        settled AS (SELECT problem, epoch, min(born) AS settled_at FROM reg WHERE NOT bare GROUP BY ALL),
        pick AS (SELECT problem, epoch, settled_at, coalesce(arg_min(clause_id, item) FILTER (d = 0), {other}) AS id FROM reg JOIN settled USING (problem, epoch) WHERE born = settled_at GROUP BY ALL),
        em AS (SELECT problem, epoch, start_pos, request_pos, id FROM met WHERE known QUALIFY row_number() OVER (PARTITION BY problem, epoch ORDER BY start_pos, request_pos, i) = 1),
        named AS (SELECT a.problem, a.epoch, a.request_pos, a.start_pos,
          CASE WHEN {"true" if required else "em.start_pos IS NULL OR pick.settled_at < em.start_pos"} THEN CASE WHEN pick.settled_at < a.start_pos THEN pick.id END ELSE {emergency} END AS conjecture
          FROM a LEFT JOIN pick USING (problem, epoch) LEFT JOIN em ON em.problem = a.problem AND em.epoch = a.epoch),
        put AS (SELECT met.*, conjecture, length(g.text) AS size FROM met JOIN named USING (problem, epoch, request_pos, start_pos)
          LEFT JOIN reg g ON g.problem = met.problem AND g.epoch = met.epoch AND g.clause_id = conjecture),
        hit AS (SELECT *, known AND conjecture IS NOT NULL AND (start_pos, request_pos) > min(CASE WHEN known AND conjecture IS NOT NULL THEN (start_pos, request_pos) END) OVER (PARTITION BY problem, epoch, id) AS again FROM put)
        SELECT problem AS session, request_pos, start_pos, conjecture, count(*) FILTER (NOT known) AS n_missing, count(*) FILTER (again) AS n_hits,
          CASE WHEN NOT bool_or(known) THEN '' ELSE array_to_string(list(CASE WHEN NOT known OR conjecture IS NULL THEN 0.0::DOUBLE
            ELSE round(2.0::DOUBLE / (1 + coalesce(d, 9999)) - abs(size - length(text))::DOUBLE / 1000, 6) END::DECIMAL(12, 6)::VARCHAR ORDER BY i), ',') END AS scores
        FROM hit GROUP BY problem, request_pos, start_pos, conjecture"""
    )


def _answers(spark, sf_dir, **options):
    got = sessions.run_sessions(spark, _session_messages(spark, sf_dir), shared_path(spark), **options)
    return got.withColumn("scores", _written("scores"))


@query(session_sql(single_slot=False, longest=True, required=False))
def session_answers(spark, sf_dir):
    return _answers(spark, sf_dir, fallback="longest")


@query(session_sql(single_slot=True, longest=False, required=True))
def single_slot_answers(spark, sf_dir):
    return _answers(spark, sf_dir, single_slot=True, require_conjecture=True)


CONTEXT, KEPT, FAILING = 16, 2, 5


def _agent_messages(spark, sf_dir):
    """Purchases ask for the clauses before them or the session's first ones, signups start queries, errors bring ground values, some
    events end the session, all others register a clause."""
    w, k = Window.partitionBy("problem").orderBy("born"), F.col("k")
    lag = lambda n: F.lag("clause_id", n).over(w)
    first = lambda n: F.max(F.when(F.col("born") == n, F.col("clause_id"))).over(Window.partitionBy("problem"))
    event = F.col("event_type")
    tag = F.when(k == LAST, "proof_out").when(event == "purchase", "scores_req").when(event == "signup", "server_queries_start").when(event == "error", "cls_sat_eval_gr_res").otherwise("register_clauses")
    asked = F.when(k % 3 == 0, F.array(first(1), first(2), first(3))).otherwise(F.array_compact(F.array(lag(1), lag(2), lag(3), lag(5), lag(1), F.lit(UNKNOWN))))
    truths = F.from_json(F.when(k % 3 == 0, "[[true,false,true],[]]").otherwise("[[false],[true,true]]"), "array<array<boolean>>")
    clause = F.struct("clause_id", "text", F.col("conj_dist").cast("int"), "horn", F.lit(False).alias("bare"))
    rows = formula_log(spark, sf_dir).withColumn("tag", tag)
    rows = rows.withColumn("ids", F.when(tag == "scores_req", asked).otherwise(F.array_compact(F.array(lag(1), lag(2), lag(4)))))
    rows = rows.select(
        F.col("problem").alias("session"), F.col("born").alias("pos"), "tag", F.when(tag == "register_clauses", F.array(clause)).alias("clauses"), "ids", F.when(k % 2 == 0, "a").alias("component"), truths.alias("values")
    )
    return sessions.padded(rows)


def _ran(spark, sf_dir):
    path = shared_path(spark)
    _agent_messages(spark, sf_dir).repartition("session").write.parquet(f"{path}/in")

    def scorer(rows):
        return F.when(F.col("request_pos") % FAILING != 0, 1.0 / (1 + F.col("conj_dist")))

    stream = spark.readStream.schema(sessions.MESSAGE.replace(", ", ",")).parquet(f"{path}/in")
    agent.run_agent(spark, stream, path, scorer, agent.Agent(CONTEXT), most=KEPT)
    return path


RELEASED = (
    CL.replace("WITH", "WITH RECURSIVE", 1)
    + f""", m AS (SELECT *, coalesce(sum((k = {LAST})::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch,
      CASE WHEN k = {LAST} THEN 'end' ELSE CASE event_type WHEN 'purchase' THEN 'request' WHEN 'signup' THEN 'start' WHEN 'error' THEN 'values' ELSE 'register' END END AS tag,
      CASE WHEN event_type = 'purchase' AND k % 3 = 0 THEN [max(clause_id) FILTER (born = 1) OVER p, max(clause_id) FILTER (born = 2) OVER p, max(clause_id) FILTER (born = 3) OVER p]
        WHEN event_type = 'purchase' THEN [x FOR x IN [lag(clause_id, 1) OVER w, lag(clause_id, 2) OVER w, lag(clause_id, 3) OVER w, lag(clause_id, 5) OVER w, lag(clause_id, 1) OVER w, {UNKNOWN}] IF x IS NOT NULL]
        ELSE [x FOR x IN [lag(clause_id, 1) OVER w, lag(clause_id, 2) OVER w, lag(clause_id, 4) OVER w] IF x IS NOT NULL] END AS ids
      FROM clause_log WINDOW w AS (PARTITION BY problem ORDER BY born), p AS (PARTITION BY problem)),
    walk AS (SELECT DISTINCT problem, 0::BIGINT AS born, NULL::BIGINT AS pending, 0::BIGINT AS round, NULL::BIGINT AS released, false AS asks, NULL::BIGINT AS told FROM m
      UNION ALL SELECT w.problem, m.born,
        CASE WHEN tag = 'request' THEN m.born WHEN tag IN ('values', 'end') OR (tag = 'start' AND (round + 1) % 3 <> 0) THEN NULL ELSE pending END,
        CASE WHEN tag = 'end' THEN 0 WHEN tag = 'start' AND pending IS NOT NULL THEN round + 1 ELSE round END,
        CASE WHEN tag = 'values' OR (tag = 'start' AND (round + 1) % 3 <> 0) THEN pending END,
        tag = 'start' AND pending IS NOT NULL AND (round + 1) % 3 = 0,
        CASE WHEN tag IN ('request', 'end') THEN NULL WHEN tag = 'values' THEN m.born ELSE told END
      FROM walk w JOIN m ON m.problem = w.problem AND m.born = w.born + 1)"""
)


@query(RELEASED + " SELECT w.problem AS session, pending AS request_pos, w.born AS start_pos, round, array_to_string(ids, ',') AS ids FROM walk w JOIN m ON m.problem = w.problem AND m.born = pending WHERE asks")
def sat_rounds(spark, sf_dir):
    return agent.sat_queries(spark, _ran(spark, sf_dir)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


REQUESTS = (
    RELEASED
    + f""", rel AS (SELECT w.problem, m.epoch, w.born AS release_pos, released AS request_pos, round, m.ids, s.ids AS sat_ids, s.k AS sat_k, m.problem * 100000 + released AS batch,
      first(released) OVER (PARTITION BY m.problem, m.epoch, m.ids, m.k % 2 = 0, CASE WHEN len(s.ids) > 0 THEN told END ORDER BY w.born) AS first_pos
      FROM walk w JOIN m ON m.problem = w.problem AND m.born = released LEFT JOIN m s ON s.problem = w.problem AND s.born = told WHERE released IS NOT NULL),
    fresh AS (SELECT * FROM rel WHERE first_pos = request_pos),
    known AS (SELECT f.batch, c.*, list_position(f.ids, c.clause_id) AS asked_at FROM fresh f JOIN m c ON c.problem = f.problem AND c.epoch = f.epoch AND c.tag = 'register' AND c.born < f.release_pos),
    goal AS (SELECT batch, arg_min(clause_id, born) AS clause_id FROM known WHERE conj_dist = 0 GROUP BY batch),
    others AS (SELECT known.* FROM known LEFT JOIN goal ON goal.batch = known.batch AND goal.clause_id = known.clause_id WHERE goal.batch IS NULL),
    chosen AS (SELECT batch, clause_id, 1 AS use FROM goal
      UNION ALL SELECT batch, clause_id, 1000 + row_number() OVER (PARTITION BY batch ORDER BY born) FROM others WHERE asked_at IS NULL QUALIFY row_number() OVER (PARTITION BY batch ORDER BY born) <= {CONTEXT}
      UNION ALL SELECT batch, clause_id, 2000 + row_number() OVER (PARTITION BY batch ORDER BY asked_at) FROM others WHERE asked_at IS NOT NULL),
    used AS (SELECT c.batch, use, known.* EXCLUDE (batch, ord) FROM chosen c JOIN known ON known.batch = c.batch AND known.clause_id = c.clause_id),
    scoped AS (SELECT *, use AS ord FROM used)"""
    + NODES
    + TOKENS
    + KINDS
    + NUMBERED
    + TARGETS
    + TAGS
    + rf""", cand AS (SELECT c.batch, c.clause_id, canonical, coalesce(equation, false) AS equation, coalesce(touches AND first_arg, false) AS near, coalesce(len(shared), 0) AS n_shared
        FROM canonical c LEFT JOIN done d ON d.batch = c.batch AND d.clause_id = c.clause_id WHERE c.use >= 2000),
      pr AS (SELECT *, CASE WHEN equation THEN 3500 WHEN near THEN 1000 + 5 * 85 ELSE 5 * trunc(least(0.6::DOUBLE, 0.15::DOUBLE * n_shared) * 100::DOUBLE)::INT END + CASE WHEN contains(canonical, '|') THEN 0 ELSE 50 END
        - trunc(0.3::DOUBLE * (len(regexp_extract_all(canonical, '\b[A-Z]\w*\b')) + 2 * len(regexp_extract_all(canonical, '\|'))))::INT AS prio FROM cand),
      sel AS (SELECT pr.batch, pr.clause_id, CASE WHEN pr.batch % 100000 % {FAILING} <> 0 THEN 1.0::DOUBLE / (1 + u.conj_dist) END AS score FROM pr JOIN used u ON u.batch = pr.batch AND u.clause_id = pr.clause_id
        QUALIFY row_number() OVER (PARTITION BY pr.batch ORDER BY prio DESC, pr.clause_id DESC) <= {KEPT}),
      failed AS (SELECT batch, count(*) AS n_selected, bool_or(score IS NULL) AS is_fallback FROM sel GROUP BY batch),
      each_id AS (SELECT batch, sat_ids, sat_k, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM fresh),
      told_of AS (SELECT e.*, u.clause_id IS NOT NULL AS known, u.conj_dist, u.horn, u.k, list_position(sat_ids, id) AS place FROM each_id e LEFT JOIN used u ON u.batch = e.batch AND u.clause_id = id),
      raws AS (SELECT *, CASE WHEN known THEN 2.0::DOUBLE / (1 + conj_dist) ELSE 0.2::DOUBLE END + CASE WHEN known AND k % 6 IN (0, 4) THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END
        + CASE WHEN known AND k % 6 IN (1, 3, 4) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN known AND horn THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
        + coalesce(0.3::DOUBLE * (1 - CASE place WHEN 1 THEN CASE WHEN sat_k % 3 = 0 THEN 2.0::DOUBLE / 3 ELSE 0.0::DOUBLE END WHEN 2 THEN CASE WHEN sat_k % 3 <> 0 THEN 1.0::DOUBLE END END), 0) AS raw FROM told_of),
      ends AS (SELECT batch, min(raw) AS low, max(raw) AS high FROM raws GROUP BY batch),
      lists AS (SELECT r.batch, array_to_string(list(round(CASE WHEN is_fallback THEN CASE WHEN high - low < 1e-9 THEN 0.5::DOUBLE ELSE (raw - low) / (high - low) END ELSE coalesce(score, 0.02::DOUBLE) END, 6)::DECIMAL(12, 6)::VARCHAR ORDER BY i), ',') AS scores
        FROM raws r JOIN ends USING (batch) LEFT JOIN failed f ON f.batch = r.batch LEFT JOIN sel ON sel.batch = r.batch AND sel.clause_id = r.id GROUP BY r.batch)
      SELECT rel.problem AS session, rel.request_pos, rel.release_pos, rel.round, CASE WHEN first_pos <> rel.request_pos THEN first_pos END AS answer_of,
        coalesce(n_selected, 0) AS n_selected, coalesce(is_fallback, false) AS is_fallback, scores
      FROM rel LEFT JOIN lists l ON l.batch = rel.problem * 100000 + first_pos LEFT JOIN failed f ON f.batch = rel.problem * 100000 + first_pos"""
)


@query(REQUESTS)
def request_answers(spark, sf_dir):
    return agent.responses(spark, _ran(spark, sf_dir)).withColumn("scores", _written("scores"))
