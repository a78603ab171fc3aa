"""Score requests of logs: strict raw logs, ground SAT values and their keys, fallback conjectures, finals, file names."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions import formula as trees
from lemmaflow.functions import text

#: Words of a status that ends a session.
FINAL = ["theorem", "unsatisfiable", "satisfiable", "timeout", "countersatisfiable", "gaveup", "unknown"]
MODE_TAGS = {"bi_then_cross": "bi+CE", "bi_then_llm": "bi+LLM"}


def raw_log_request(messages: DataFrame) -> DataFrame:
    """source, clause_ids, component of each log's first request; fails where a log doesn't begin with clauses or has no request."""
    asked = F.col("tag") == "scores_req"
    per = messages.groupBy("source").agg(
        F.min_by("tag", "msg_pos").alias("first_tag"),
        F.min_by(F.struct("clause_ids", "component"), F.when(asked, F.col("msg_pos"))).alias("request"),
        F.count_if(asked).alias("n"),
    )
    bad = F.when(F.col("first_tag") != "register_clauses", "the first message doesn't register clauses").when(F.col("n") == 0, "no request in the log")
    ids = F.transform("request.clause_ids", lambda x: x.try_cast("bigint"))
    return per.select("source", F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(ids).alias("clause_ids"), F.col("request.component").alias("component"))


def raw_log_clauses(messages: DataFrame) -> DataFrame:
    """source, item_pos, clause_id, text, cleaned, formula, features of the clauses that a log's first message registers."""
    first = messages.groupBy("source").agg(F.min_by("clauses", "msg_pos").alias("clauses"))
    one = first.select("source", F.posexplode("clauses").alias("item_pos", "c"))
    cleaned = text.clean_clause(F.col("c.clause"))
    rows = one.select("source", "item_pos", F.col("c.clause_id").try_cast("bigint").alias("clause_id"), F.col("c.clause").alias("text"), cleaned.alias("cleaned"), F.col("c.clause_features").alias("features"))
    return rows.withColumn("formula", trees.wrapped_formula(F.col("cleaned")))


def sat_values(messages: DataFrame) -> DataFrame:
    """source, values: a map of clause id to the ground values of the last answer; ids beyond its values have none.

    An answer with an id that is no whole number counts as empty; of an id that is there twice the last values count.
    """
    ids = F.transform(F.coalesce(F.when(F.size("clause_ids") > 0, F.col("clause_ids")), F.col("cause_ids"), F.array().cast("array<string>")), lambda x: x.try_cast("bigint"))
    whole = F.when(F.exists(ids, lambda x: x.isNull()), F.array().cast("array<bigint>")).otherwise(ids)
    none = F.array().cast("array<boolean>")
    last = lambda x: F.size("ids") - F.array_position(F.reverse("ids"), x).cast("int")
    own = F.transform(F.array_distinct("ids"), lambda x: F.struct(x.alias("k"), F.coalesce(F.get("sat_lit_gr_vals", last(x)), none).alias("v")))
    answers = messages.where("tag = 'cls_sat_eval_gr_res'").select("source", "msg_pos", "sat_lit_gr_vals", whole.alias("ids")).select("source", "msg_pos", own.alias("entries"))
    return answers.groupBy("source").agg(F.max_by("entries", "msg_pos").alias("entries")).select("source", F.map_from_entries("entries").alias("values"))


def sat_support(values: Column) -> Column:
    """The share of true values; null where there are none."""
    return F.when(F.size(values) > 0, F.size(F.filter(values, lambda v: v)) / F.greatest(F.lit(1), F.size(values)))


def cache_key(ids: Column, component: Column, component_id: Column, values: Column) -> Column:
    """A struct that names an answer: the request and a digest of the SAT values, or ``nosat`` without any."""
    written = F.transform(
        F.array_sort(F.map_entries(values)), lambda e: F.concat(F.lit('"'), e["key"].cast("string"), F.lit('": ['), F.array_join(F.transform(e["value"], lambda v: F.when(v, "true").otherwise("false")), ", "), F.lit("]"))
    )
    digest = F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.sha1(F.concat(F.lit("{"), F.array_join(written, ", "), F.lit("}")))).otherwise("nosat")
    return F.struct(ids.alias("ids"), component.alias("component"), component_id.alias("component_id"), digest.alias("sat"))


def fallback_conjecture(clauses: DataFrame, how: str = "first") -> DataFrame:
    """problem, clause_id: of the clauses that aren't of distance 0 the one of least id, or the shortest or longest (of equals the first)."""
    size = F.length("text")
    order = {"first": F.struct("clause_id"), "shortest": F.struct(size, "ord"), "longest": F.struct(-size, "ord")}[how]
    return clauses.where("conj_dist is null or conj_dist <> 0").groupBy("problem").agg(F.min_by("clause_id", order).alias("clause_id"))


def conjectures(clauses: DataFrame, how: str = "first") -> DataFrame:
    """problem, clause_id, is_fallback: the first clause of distance 0, or else a fallback."""
    own = clauses.where("conj_dist = 0").groupBy("problem").agg(F.min_by("clause_id", "ord").alias("own"))
    both = own.join(fallback_conjecture(clauses, how), "problem", "full")
    return both.select("problem", F.coalesce("own", "clause_id").alias("clause_id"), F.col("own").isNull().alias("is_fallback"))


def is_final(tag: Column, status: Column) -> Column:
    """Whether a message ends its session."""
    said = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    named = tag.isin("szs_result_out", "szs_status_out") & said.rlike("|".join(FINAL))
    return F.coalesce((tag == "proof_out") | named, F.lit(False))


def asks_sat(query_round: Column) -> Column:
    """Every third round of queries asks for ground values."""
    return query_round % 3 == 0


def stamps(ts: Column) -> Column:
    """The forms in which logs write a time: seconds and milliseconds since 1970, a clock, and digits for file names."""
    at = ts.cast("timestamp")
    return F.struct(F.unix_seconds(at).alias("seconds"), F.unix_millis(at).alias("millis"), F.date_format(at, "HH:mm:ss").alias("clock"), F.date_format(at, "yyyyMMdd_HHmmss").alias("digits"))


def merged(first: Column, second: Column) -> Column:
    """Both maps as one; where both have a key, the second's value counts."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)


def log_name(stamp: Column, problem: Column, tag: Column, mode: Column) -> Column:
    """``<stamp>_<problem's base name>[__tag].log``; without a tag some modes have their own, without a problem the base is session."""
    base = F.coalesce(F.nullif(F.regexp_extract(problem, r"([^/]*)\.p$", 1), F.lit("")), F.lit("session"))
    own = F.coalesce(F.nullif(tag, F.lit("")), *[F.when(mode == m, t) for m, t in MODE_TAGS.items()], F.lit(""))
    safe = F.regexp_replace(F.translate(own, " /\\:", "____"), r"[^A-Za-z0-9_+.-]", "")
    return F.concat(F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit("_"), base, F.when(own != "", F.concat(F.lit("__"), safe)).otherwise(""), F.lit(".log"))
