"""Queries of vocabularies, truncation and scorers."""

from pyspark.sql import functions as F

from lemmaflow.functions import text
from lemmaflow.operators import encoding, ordering, scorers
from lemmaflow.plans.registry import CL, _read, clause_log, query

#: A vocabulary file with a repeated token, a line of words and an empty line.
LINES = ["(\t-1", ")\t-2", ",\t-3", "tcf\t-4", "plain more words", "X0\t-5", "(\t-9", "", "!\t-6", ":$i\t-7", "p_1\t-8", "p_2\t-8"]
TOKEN_SQL = r"regexp_extract_all(text, '[A-Za-z0-9_]+|[()=,~|&!]|:\$i|:\$o')"
WORDS = ["<pad>", "(", ")", ",", "tcf", "plain", "X0", "!", ":$i", "p_1", "p_2", "<unk>"]


def _words(spark):
    return encoding.vocabulary(spark.createDataFrame(list(enumerate(LINES)), "pos int, value string"))


@query(
    f"""WITH t AS (SELECT unnest({TOKEN_SQL}) AS token FROM documents), n AS (SELECT token, count(*) AS n FROM t GROUP BY token)
    SELECT token, row_number() OVER (ORDER BY n DESC, token)::INTEGER AS id FROM n UNION ALL SELECT '<pad>', 0 UNION ALL SELECT '<unk>', (count(*) + 1)::INTEGER FROM n"""
)
def vocabulary(spark, sf_dir):
    """Of lines with the documents' tokens, the most frequent first."""
    tokens = _read(spark, sf_dir, "documents").select(F.explode(text.static_tokens(F.col("text"), whole=False)).alias("token"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    lines = ordering.positions(counted, [F.desc("n"), F.col("token")], "pos")
    return encoding.vocabulary(lines.select("pos", F.concat("token", F.lit("\t-"), "n").alias("value")))


@query(
    CL
    + f""", w AS (SELECT MAP([{", ".join(f"'{w}'" for w in WORDS)}], {list(range(len(WORDS)))}) AS m)
    SELECT clause_id, array_to_string([coalesce(m[t], 11) FOR t IN {TOKEN_SQL}], ' ') AS ids FROM clause_log, w"""
)
def encode_static(spark, sf_dir):
    ids = encoding.encode_static(clause_log(spark, sf_dir), _words(spark), "clause_id")
    return ids.select("clause_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


LENGTHS = """, n AS (SELECT clause_id, 1 + k % 37 AS nq, 1 + (k * 7) % 301 AS nc, CASE k % 4 WHEN 0 THEN 400 WHEN 1 THEN 60 WHEN 2 THEN 20 ELSE 4 END AS most FROM clause_log),
    s AS (SELECT *, range(1, nq + 1) AS q, [7, 8] AS sep, range(1001, 1001 + nc) AS c FROM n),
    w AS (SELECT *, q || sep || c AS whole, most - 2 AS room, nq + nc AS total, greatest(1, nq // 4) AS kq, greatest(1, nc // 4) AS kc FROM s),
    o AS (SELECT *, CASE WHEN nq > 2 * kq THEN q[:kq] || q[nq - kq + 1:] ELSE q END AS oq, CASE WHEN nc > 2 * kc THEN c[:kc] || c[nc - kc + 1:] ELSE c END AS oc,
      least(greatest(1, trunc(room * (nq::DOUBLE / total))::INT), nq, room - 1) AS uq FROM w),
    p AS (SELECT *, len(oq) + len(oc) AS outer_n, trunc(room * (len(oq)::DOUBLE / (len(oq) + len(oc))))::INT AS pq FROM o),
    plan AS (SELECT clause_id, most, CASE WHEN len(whole) <= most THEN 'full_fit' WHEN room <= 2 THEN 'extreme_truncated' ELSE 'truncated' END AS kind,
      CASE WHEN len(whole) <= most THEN whole WHEN room <= 2 THEN whole[:most] WHEN total > 3 * most THEN
        (CASE WHEN outer_n > room THEN oq[:pq] || sep || oc[:room - pq] ELSE oq || sep || oc END)[:most] ELSE (q[:uq] || sep || c[:room - uq])[:most] END AS ids FROM p)"""


def _plan(spark, sf_dir):
    k = F.col("k")
    most = F.when(k % 4 == 0, 400).when(k % 4 == 1, 60).when(k % 4 == 2, 20).otherwise(4)
    q, c = F.sequence(F.lit(1), (1 + k % 37).cast("int")), F.sequence(F.lit(1001), (1001 + (k * 7) % 301).cast("int"))
    rows = clause_log(spark, sf_dir).select("clause_id", most.alias("most"), q.alias("q"), F.array(F.lit(7), F.lit(8)).alias("sep"), c.alias("c"))
    kind, ids = encoding.truncated_pair(F.concat("q", "sep", "c"), F.col("q"), F.col("sep"), F.col("c"), F.col("most"))
    return rows.select("clause_id", "most", kind.alias("kind"), ids.alias("ids"))


@query(CL + LENGTHS + " SELECT clause_id, kind, array_to_string(ids, ' ') AS ids FROM plan")
def truncation_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("clause_id", "kind", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(CL + LENGTHS + " SELECT most, count(*) FILTER (kind = 'full_fit') AS full_fit, count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (kind = 'extreme_truncated') AS extreme_truncated FROM plan GROUP BY most")
def truncation_counts(spark, sf_dir):
    return encoding.truncation_counts(_plan(spark, sf_dir), ["most"])


@query(
    CL
    + LENGTHS
    + """, safe AS (SELECT clause_id, [CASE WHEN i >= 1200 THEN 11 ELSE i END FOR i IN ids] AS ids, least(most, 64) AS size FROM plan WHERE most <= 60)
    SELECT clause_id, array_to_string(ids || [0 FOR i IN range(greatest(size - len(ids), 0))], ' ') AS ids, least(len(ids), greatest(size, len(ids))) AS n_real FROM safe"""
)
def padded_ids(spark, sf_dir):
    plan = _plan(spark, sf_dir).where("most <= 60")
    safe = plan.withColumn("ids", encoding.safe_ids(F.col("ids"), F.lit(1200), F.lit(11)))
    ids, mask = encoding.padded(F.col("ids"), encoding.effective_length(F.col("most"), F.lit(64)))
    return safe.select("clause_id", F.array_join(ids.cast("array<string>"), " ").alias("ids"), F.aggregate(mask, F.lit(0), lambda a, m: a + m).cast("long").alias("n_real"))


#: A stand-in for a model: the shorter a text and the longer its prompt, the likelier.
def _logprob(prompt, suffix):
    return -F.length(suffix) / (1.0 + F.length(prompt))


PAIRS = """, cq AS (SELECT problem, arg_min(text, ord) AS query FROM clause_log WHERE conj_dist = 0 GROUP BY problem),
    pairs AS (SELECT c.problem, c.clause_id, c.ord, query, text, -length(text)::DOUBLE / (1.0::DOUBLE + length(query) + 1) AS cond, -length(text)::DOUBLE AS uncond FROM clause_log c JOIN cq USING (problem))"""


def _pairs(spark, sf_dir):
    log = clause_log(spark, sf_dir)
    queries = log.where("conj_dist = 0").groupBy("problem").agg(F.min_by("text", "ord").alias("query"))
    return log.select("problem", "clause_id", F.col("ord").alias("pos"), "text", "k").join(queries, "problem")


@query(CL + PAIRS + " SELECT clause_id, round(cond - 0.7::DOUBLE * uncond, 6) AS score FROM pairs")
def pmi_scores(spark, sf_dir):
    scored = scorers.load_scorer("pmi", logprob=_logprob)(_pairs(spark, sf_dir))
    return scored.select("clause_id", F.round("score", 6).alias("score"))


@query(
    CL
    + PAIRS
    + """, f AS (SELECT *, (clause_id * 7919 % 1009)::DOUBLE AS first FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY first DESC, ord) AS r FROM f)
    SELECT clause_id, r <= 5 AS reranked, round(CASE WHEN r <= 5 THEN cond ELSE first END, 6) AS score FROM r"""
)
def rerank_scored(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("first", (F.col("clause_id") * 7919 % 1009).cast("double"))
    scored = scorers.score_then_rerank(pairs, lambda q, t: F.col("first"), scorers.direct(_logprob), 5, ["problem"])
    return scored.select("clause_id", "reranked", F.round("score", 6).alias("score"))


@query(
    """WITH v AS (SELECT vec_id, [embedding[i * 8 + 1 : i * 8 + 8]::DOUBLE[] FOR i IN range(8)] AS vs, [CASE WHEN i % 3 = vec_id % 3 THEN 0 ELSE 1 END FOR i IN range(8)] AS m FROM embeddings),
    u AS (SELECT vec_id, j, sum(vs[i + 1][j + 1] * m[i + 1]) / greatest(1, sum(m[i + 1])) AS x FROM v, range(8) AS a(i), range(8) AS b(j) GROUP BY vec_id, j)
    SELECT vec_id, j, round(x, 6) + 0.0 AS x FROM u"""
)
def masked_mean(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    wide = F.transform("embedding", lambda x: x.cast("double"))
    vectors = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(wide, i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i % 3 == F.col("vec_id") % 3, 0).otherwise(1))
    pooled = e.select("vec_id", F.posexplode(encoding.masked_mean(vectors, mask, 8)).alias("j", "x"))
    return pooled.select("vec_id", "j", (F.round("x", 6) + 0.0).alias("x"))
