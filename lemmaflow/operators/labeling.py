"""Labels, buckets, frontiers and quota sampling of negatives.

All windows are partitioned by problem, so that the chain needs one shuffle; a problem's clauses must fit in one
task's sort, which spills.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions.scores import negative_score

GIVEN, SIMPLIFIED, PASSIVE, NEVER = "NEG_given_nonproof", "NEG_simplified", "NEG_passive_only", "NEG_never_seen"


def label_rows(clauses: DataFrame) -> DataFrame:
    """``clauses`` with label and neg_bucket from the flags is_proof, is_given, is_simplified, is_passive."""
    bucket = F.when(F.col("is_proof"), F.lit(None)).when(F.col("is_given"), GIVEN).when(F.col("is_simplified"), SIMPLIFIED).when(F.col("is_passive"), PASSIVE).otherwise(NEVER)
    return clauses.withColumn("label", F.when(F.col("is_proof"), 1).otherwise(0)).withColumn("neg_bucket", bucket)


def last_given(messages: DataFrame, limit: int) -> DataFrame:
    """messages: problem, msg_pos, item_pos, clause_id. The newest messages that hold ``limit`` ids, of these the oldest ids.

    rank 0 is the oldest row of the result; 0 as the limit gives all.
    """
    n_ids = messages.groupBy("problem", "msg_pos").agg(F.count(F.lit(1)).alias("n"))
    newest = Window.partitionBy("problem").orderBy(F.desc("msg_pos"))
    before = F.coalesce(F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = n_ids.withColumn("before", before).where((F.col("before") < limit) | F.lit(limit == 0)).drop("before", "n")
    rows = messages.join(kept, ["problem", "msg_pos"])
    order = Window.partitionBy("problem").orderBy(F.desc("msg_pos"), "item_pos")
    total = F.count(F.lit(1)).over(Window.partitionBy("problem"))
    ranked = rows.withColumn("r", F.row_number().over(order)).withColumn("total", total)
    return ranked.where((F.col("r") > F.col("total") - limit) | F.lit(limit == 0)).select("problem", "clause_id", (F.col("total") - F.col("r")).cast("long").alias("rank"))


def passive_sample(clauses: DataFrame, n: int = 8) -> DataFrame:
    """The best ``n`` clauses that were passive and neither given nor simplified."""
    missing = F.lit(1 << 30)
    score = F.when(F.col("horn"), 1.0).otherwise(0.0) - 0.001 * F.coalesce("born", missing) - 0.0001 * F.coalesce("conj_dist", missing)
    rows = clauses.where("is_passive and not is_given and not is_simplified").withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("problem").orderBy(F.desc("score"), "clause_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def dedup_positives(positives: DataFrame) -> DataFrame:
    """The row with the smallest born of each basic clause, in order of the clause's first row (pos_rank)."""
    key = Window.partitionBy("problem", F.coalesce("basic_clause_id", "clause_id"))
    best = F.row_number().over(key.orderBy(F.coalesce("born", F.lit(0)), "ord"))
    rows = positives.withColumn("first_ord", F.min("ord").over(key)).withColumn("best", best).where("best = 1").drop("best")
    return rows.withColumn("pos_rank", F.row_number().over(Window.partitionBy("problem").orderBy("first_ord"))).drop("first_ord")


def born_section(by: list):
    """early, mid or late third by born; the remainder is late."""
    w = Window.partitionBy(*by)
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(F.coalesce("born", F.lit(0)), "ord"))
    third = F.greatest(F.lit(1), F.floor(n / 3))
    return F.when(n < 3, "late").when(r <= third, "early").when(r <= 2 * third, "mid").otherwise("late")


def scored_negatives(labelled: DataFrame, frontier: DataFrame) -> DataFrame:
    """Rows of label 0 with frontier and score; frontier: problem, clause_id."""
    marked = labelled.where("label = 0").join(frontier.select("problem", "clause_id").distinct().withColumn("frontier", F.lit(True)), ["problem", "clause_id"], "left")
    marked = marked.withColumn("frontier", F.coalesce("frontier", F.lit(False)))
    w = Window.partitionBy("problem")
    low, high = F.min("born").over(w), F.max("born").over(w)
    return marked.withColumn("score", negative_score(F.col("frontier"), F.col("born"), low, high, F.col("unit"), F.col("horn"), F.col("conj_dist")))


def sample_negatives(labelled: DataFrame, frontier: DataFrame, mult: int = 8, cap: int = 1000, fallback: int = 300) -> DataFrame:
    """Deduplicated positives and quota-sampled negatives: problem, clause_id, label, neg_bucket, part, place.

    Among negatives a null bucket counts as never seen, an unknown one as passive only.
    part 0 is positives; 1 to 9 are frontier, early, mid, late, given leftovers, simplified, passive, never seen and
    the top-up. place is a row's rank in its part; by part and place, a problem's rows are in their order of output.
    """
    positives = dedup_positives(labelled.where("label = 1"))
    n_pos = positives.groupBy("problem").agg(F.count(F.lit(1)).alias("n_pos"))
    wanted = F.least(F.when(F.coalesce("n_pos", F.lit(0)) > 0, mult * F.col("n_pos")).otherwise(fallback), F.lit(cap)).cast("int")
    neg = scored_negatives(labelled, frontier).join(n_pos, "problem", "left").withColumn("t", wanted).where("t > 0")
    neg = neg.withColumns({"qg": F.expr("t div 2"), "qs": F.expr("t div 5"), "qp": F.expr("t div 4")})
    neg = neg.withColumn("qn", F.col("t") - F.col("qg") - F.col("qs") - F.col("qp"))
    known = F.coalesce("neg_bucket", F.lit(NEVER))
    bucket = F.when(known.isin(GIVEN, SIMPLIFIED, PASSIVE, NEVER), known).otherwise(PASSIVE)
    given = bucket == GIVEN
    neg = neg.withColumn("kind", F.when(given & F.col("frontier"), "frontier").when(given, "open").otherwise(bucket))
    neg = neg.withColumn("kind", F.when(F.col("kind") == "open", born_section(["problem", "kind"])).otherwise(F.col("kind")))
    by_kind, whole = Window.partitionBy("problem", "kind"), Window.partitionBy("problem")
    best = [F.desc("score"), F.when(F.col("kind").isin("early", "mid", "late"), F.col("born")), F.asc("ord")]
    rank = F.when(F.col("kind") == NEVER, F.row_number().over(by_kind.orderBy("clause_id"))).otherwise(F.row_number().over(by_kind.orderBy(*best)))
    neg = neg.withColumn("r", rank)
    counts = {f"n_{k}": F.count(F.when(F.col("kind") == k, 1)).over(whole) for k in ("frontier", "early", "mid", "late")}
    neg = neg.withColumns(counts)
    take_f = F.when((F.col("n_frontier") > 0) & (F.col("qg") > 0), F.greatest(F.lit(1), F.least(F.col("n_frontier"), F.expr("qg div 3")))).otherwise(0)
    neg = neg.withColumn("take_f", take_f).withColumn("rem", F.col("qg") - F.col("take_f"))
    neg = neg.withColumn("sec", F.when(F.col("rem") > 0, F.greatest(F.lit(1), F.expr("rem div 3"))).otherwise(0))
    neg = neg.withColumn("e", F.least("sec", "n_early"))
    neg = neg.withColumn("m", F.when(F.col("rem") - F.col("e") > 0, F.least("sec", "n_mid")).otherwise(0))
    neg = neg.withColumn("l", F.when(F.col("rem") - F.col("e") - F.col("m") > 0, F.least("sec", "n_late")).otherwise(0))
    take = {"frontier": "take_f", "early": "e", "mid": "m", "late": "l", SIMPLIFIED: "qs", PASSIVE: "qp", NEVER: "qn"}
    number = {"frontier": 1, "early": 2, "mid": 3, "late": 4, SIMPLIFIED: 6, PASSIVE: 7, NEVER: 8}
    part = F.lit(None).cast("int")
    for kind, column in take.items():
        part = F.when((F.col("kind") == kind) & (F.col("r") <= F.col(column)), number[kind]).otherwise(part)
    neg = neg.withColumn("part", part)
    open_left = F.col("part").isNull() & F.col("kind").isin("early", "mid", "late")
    in_open = F.row_number().over(Window.partitionBy("problem", open_left).orderBy(F.desc("score"), "ord"))
    left = F.col("rem") - F.col("e") - F.col("m") - F.col("l")
    neg = neg.withColumn("place", F.when(open_left, in_open).otherwise(F.col("r")))
    neg = neg.withColumn("part", F.when(open_left & (in_open <= left), 5).otherwise(F.col("part")))
    taken = F.count("part").over(whole)
    top = F.row_number().over(Window.partitionBy("problem", F.col("part").isNull()).orderBy(F.desc("score"), "ord"))
    neg = neg.withColumns({"place": F.when(F.col("part").isNull(), top).otherwise(F.col("place")), "part": F.when(F.col("part").isNull() & (top <= F.col("t") - taken), 9).otherwise(F.col("part"))})
    chosen = neg.where("part is not null").select("problem", "clause_id", "label", "neg_bucket", "part", "place")
    return positives.select("problem", "clause_id", "label", "neg_bucket", F.lit(0).alias("part"), F.col("pos_rank").alias("place")).union(chosen)


def classify_failure(runs: DataFrame) -> DataFrame:
    """``runs`` (timed_out, exit_code, has_szs, has_proof) with reason, null for a success."""
    reason = (
        F.when(F.col("timed_out"), "timeout")
        .when((F.col("exit_code") != 0) & ~F.col("has_szs"), "iprover_error")
        .when((F.col("exit_code") == 0) & ~F.col("has_szs") & ~F.col("has_proof"), "no_proof")
    )
    return runs.withColumn("reason", reason)
