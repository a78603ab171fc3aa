"""Ranking and classification metrics by windows, and the run report."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.operators import ordering
from lemmaflow.session import written_once


def resolve_predictions(rows: DataFrame) -> DataFrame:
    """group_id, score, label, pos of rows whose score and label are numbers; the first alias that isn't null counts."""
    have = set(rows.columns)

    def first(*names: str):
        return F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(None).cast("string"))

    query = F.coalesce(F.nullif(first("query"), F.lit("")), first("text_a"), F.lit(""))
    group = F.coalesce(F.nullif(first("group_id"), F.lit("")), F.concat(F.coalesce(first("problem_name"), F.lit("")), F.lit("||"), query))
    score, label = first("score", "ce_score", "bi_score", "llm_score").try_cast("double"), first("label", "y", "target").try_cast("double")
    pos = F.col("pos") if "pos" in have else F.monotonically_increasing_id()
    return rows.select(group.alias("group_id"), score.alias("score"), label.alias("label"), pos.alias("pos")).where("score is not null and label is not null")


def ranking_metrics(preds: DataFrame, ks: list[int]) -> DataFrame:
    """k, hit, recall, ndcg, mrr: means over groups. ``preds`` is read twice.

    Only the best rows of a group that some k needs are ranked; ideal gains and positives come from counts by label.
    """
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("score"), "pos"))
    top = preds.select("group_id", "label", rank.alias("r")).where(F.col("r") <= max(ks))
    return metrics_of(top, preds.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n")), ks)


def metrics_of(top: DataFrame, counts: DataFrame, ks: list[int]) -> DataFrame:
    """``ranking_metrics`` of the best rows of each group (group_id, label, r) and the number of rows by label (group_id, label, n)."""
    group = Window.partitionBy("group_id")
    gain, positive = F.pow(F.lit(2.0), F.col("label")) - 1, F.col("label") > 0
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(group.orderBy(F.desc("label")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def ideal(k: int):
        """The gains of a label's rows at ideal places up to k."""
        places = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k)))
        discounts = F.aggregate(places, F.lit(0.0), lambda t, r: t + 1.0 / F.log2(r + 1.0))
        return F.when(F.col("before") < k, gain * discounts).otherwise(0.0).alias(f"ideal_{k}")

    found = top.withColumn("dcg", gain / F.log2(F.col("r") + 1.0)).unionByName(counts.select("group_id", F.when(positive, F.col("n")).otherwise(0).alias("positives"), *map(ideal, ks)), allowMissingColumns=True)

    def per(k: int):
        inside = F.col("r") <= k
        hits = F.coalesce(F.sum(F.when(inside & positive, 1)), F.lit(0))
        best, first = F.coalesce(F.sum(f"ideal_{k}"), F.lit(0.0)), F.min(F.when(inside & positive, F.col("r")))
        return F.struct(
            F.lit(k).alias("k"),
            F.when(hits > 0, 1.0).otherwise(0.0).alias("hit"),
            F.coalesce(F.try_divide(hits, F.sum("positives")), F.lit(0.0)).alias("recall"),
            F.when(best > 0, F.coalesce(F.sum(F.when(inside, F.col("dcg"))), F.lit(0.0)) / best).otherwise(0.0).alias("ndcg"),
            F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"),
        )

    groups = found.groupBy("group_id").agg(F.array(*[per(k) for k in ks]).alias("each")).select(F.inline("each"))
    return groups.groupBy("k").agg(*[F.avg(m).alias(m) for m in ("hit", "recall", "ndcg", "mrr")])


def auc_ap(preds: DataFrame) -> DataFrame:
    """One row: auc, ap; null where labels are of one class.

    Rows are counted by distinct score first, and running sums go by ranges of scores, each in its own task: a
    range's offset comes from a small table of range totals.
    """
    per = preds.groupBy("score").agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("n"))
    ranged = ordering.in_ranges(per, [F.desc("score")])
    totals = ranged.groupBy("_part").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    before = ordering.offsets(ranged, op=F.sum("p"), on=F.sum("n"))
    whole = totals.agg(F.sum("sp").alias("all_p"), F.sum("sn").alias("all_n"))
    within = Window.partitionBy("_part").orderBy(F.desc("score"))
    rows = ranged.join(F.broadcast(before), "_part").withColumn("tp", F.col("op") + F.sum("p").over(within)).withColumn("seen", F.col("on") + F.sum("n").over(within))
    negatives = F.col("n") - F.col("p")
    pairs = F.sum(negatives * (F.col("tp") - F.col("p")) + 0.5 * negatives * F.col("p"))
    sums = rows.agg(pairs.alias("pairs"), F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("area"))
    mixed = (F.col("all_p") > 0) & (F.col("all_p") < F.col("all_n"))
    return sums.crossJoin(whole).select(
        F.when(mixed, F.col("pairs") / (F.col("all_p") * (F.col("all_n") - F.col("all_p")))).alias("auc"),
        F.when(mixed, F.col("area") / F.col("all_p")).alias("ap"),
    )


def rank_diagnostics(preds: DataFrame, ks: list[int]) -> DataFrame:
    """One row of counts and means. ``preds`` is read twice: for the counts and best score of each group, and for who has it."""
    per = preds.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") > 0).alias("p"), F.max("score").alias("top"))
    per = written_once(per)
    best = per.select(F.col("group_id").alias("_group"), F.col("top").alias("_top"))
    tops = preds.join(best, F.col("group_id").eqNullSafe(F.col("_group")) & F.col("score").eqNullSafe(F.col("_top")))
    firsts = tops.groupBy("group_id").agg(F.min(F.struct("pos", "label"))["label"].alias("label"))
    hits = firsts.agg(F.sum(F.when(F.col("label") > 0, 1.0).otherwise(0.0)).alias("first"))
    groups = F.greatest(F.lit(1), F.col("groups"))
    counts = per.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("candidates"), F.sum("p").alias("positives"))
    return counts.crossJoin(hits).select(
        "groups",
        "candidates",
        "positives",
        (F.col("first") if 1 in ks else F.lit(0.0)).alias("hit_at_1"),
        F.col("first").alias("hit_at_1_pos"),
        (F.col("candidates") / groups).alias("avg_candidates"),
        (F.col("positives") / groups).alias("avg_positives"),
    )


def run_report(runs: DataFrame) -> DataFrame:
    """One row of counts and means over solved runs; loops are summed over all."""
    solved = F.col("solved")

    def mean(column):
        return F.bround(F.avg(F.when(solved, column)), 3)

    return runs.agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(solved).alias("solved"),
        mean(F.nullif(F.col("proof_steps"), F.lit(0))).alias("mean_proof_steps"),
        mean(F.col("total_time")).alias("mean_total_time"),
        *[mean(F.col(f"{e}_passive")).alias(f"mean_{e}_passive") for e in ("inst", "sup", "res")],
        *[F.coalesce(F.sum(f"{e}_loops"), F.lit(0)).alias(f"sum_{e}_loops") for e in ("inst", "sup", "res")],
    )
