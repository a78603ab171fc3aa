"""Quality rules with robust multivariate outliers, with built-in functions only.

Text statistics give base rules; beside them, the minimum covariance determinant of a transformed statistic
vector is estimated for each language and source. Three deterministic starts (medians with the diagonal of median
absolute deviations, with the correlations of tanh-transformed scores, and with the spatial sign covariance) take two
concentration steps each: keep the ``support`` share of rows with the smallest distances, estimate mean and
covariance from them, measure again. Of each group the start with the least determinant goes on for as long as a step
lowers the determinant by a hundredth, which ends, as determinants have a least value. Then each group's mean and covariance are averaged with those of all groups' kept rows,
which count as ``prior`` rows; so a small group leans on the others and a large one on itself, by one rule at all sizes.

A row is rejected where its squared Mahalanobis distance would be exceeded with ``probability`` under a log-normal
law that has the quartiles of its group's distances (averaged likewise with those of all rows): real statistics have
heavier tails than the normal law, whose chi-square quantiles would reject them.

Defined cases: a null text has no words and fails the base rule; a null lang or source is a group of its
own; every row gives a row, repeated ones too; other columns are ignored; an empty table gives no rows.
Estimates are aggregates of fixed width and quantile summaries, so a group of any size takes no more memory;
they are joined back by group, and such joins can be split where a group is hot.
"""

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import SPACE_RUN, SPACES, materialize, text_of

#: Median of the chi-square law with 4 degrees of freedom, and the quartile of the normal law.
CHI2_4_MEDIAN = 3.3567
QUARTILE = 0.67449
VECTOR = ["v1", "v2", "v3", "v4"]
K = len(VECTOR)
PAIRS = [(i, j) for i in range(K) for j in range(i, K)]
#: Least variances: the statistics are partly discrete, and a group can be all alike in one.
FLOORS = [0.25, 0.05, 0.05, 0.05]
MEANS = [f"m{i}" for i in range(K)]
SPREAD = [f"c{i}{j}" for i, j in PAIRS]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def _repeated(windows: Column) -> Column:
    """Words that lie in windows of five occurring twice or more."""

    def covered(found: Column) -> Column:
        step = F.transform(found, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(found, k + 1) - p, F.lit(5))))
        return F.aggregate(step, F.lit(0), lambda total, x: total + x)

    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.transform(
        F.array(placed),
        lambda s: F.transform(
            F.filter(s, lambda p, k: (F.get(s, k + 1)["h"] == p["h"]) | (F.get(s, k - 1)["h"] == p["h"])), lambda p: p["i"]
        ),
    )
    return F.get(F.transform(twice, lambda found: F.transform(F.array(F.array_sort(found)), covered)), 0)[0]


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each whole text."""
    n = F.size("words")
    staged = docs.select(*keep, text_of().alias("text")).withColumn("words", words_of(F.col("text")))
    hashes = F.transform(F.slice("words", F.lit(1), n - 4), lambda w, i: F.xxhash64(F.slice("words", i + 1, F.lit(5))))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    staged = staged.withColumn("windows", F.when(n >= 5, hashes)).withColumn("lines", lines)
    return staged.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _repeated(F.col("windows")))
        .otherwise(0)
        .cast("long")
        .alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _whitening(c: dict[tuple[int, int], Column]) -> tuple[list[Column], Column]:
    """Rows w of the inverse Cholesky factor of a covariance (as w00, w10, w11, ...), and the log of its determinant."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(K):
        for j in range(i + 1):
            rest = c[j, i]
            for x in range(j):
                rest = rest - low[i, x] * low[j, x]
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] / 10))) if i == j else rest / low[j, j]
    inverse: dict[tuple[int, int], Column] = {}
    for i in range(K):
        inverse[i, i] = 1 / low[i, i]
        for j in range(i):
            inverse[i, j] = -reduce(lambda a, b: a + b, [low[i, x] * inverse[x, j] for x in range(j, i)]) / low[i, i]
    log_det = reduce(lambda a, b: a + b, [2 * F.log(low[i, i]) for i in range(K)])
    return [inverse[i, j].alias(f"w{i}{j}") for i in range(K) for j in range(i + 1)], log_det


def _prepared(estimates: DataFrame) -> DataFrame:
    """A few rows of estimates, written with what measuring needs of them."""
    w, log_det = _whitening({(i, j): F.col(f"c{i}{j}") for i, j in PAIRS})
    return materialize(estimates.select("*", *w, log_det.alias("log_det")))


def _distance() -> Column:
    """Squared Mahalanobis distance of VECTOR to a joined estimate."""
    gap = [F.col(v) - F.col(m) for v, m in zip(VECTOR, MEANS, strict=True)]
    rows = [reduce(lambda a, b: a + b, [F.col(f"w{i}{j}") * gap[j] for j in range(i + 1)]) for i in range(K)]
    return reduce(lambda a, b: a + b, [r * r for r in rows])


def _moments() -> list[Column]:
    spread = [(F.covar_pop(VECTOR[i], VECTOR[j]) + F.lit(FLOORS[i] if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    return [F.avg(v).alias(m) for v, m in zip(VECTOR, MEANS, strict=True)] + spread + [F.count(F.lit(1)).alias("n")]


def _starts(rows: DataFrame) -> DataFrame:
    """g, start, and the estimates that concentration starts from."""
    median = lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(1000))
    middle = materialize(rows.groupBy("g").agg(*[median(F.col(v)).alias(m) for v, m in zip(VECTOR, MEANS, strict=True)]))
    gaps = rows.join(middle, "g").groupBy("g", *MEANS).agg(*[median(F.abs(F.col(v) - F.col(m))).alias(f"g{i}") for i, (v, m) in enumerate(zip(VECTOR, MEANS, strict=True))])
    scale = [F.sqrt(F.pow(F.col(f"g{i}") * 1.4826, 2) + FLOORS[i]).alias(f"s{i}") for i in range(K)]
    scales = materialize(gaps.select("g", *MEANS, *scale))
    z = [(F.col(v) - F.col(m)) / F.col(f"s{i}") for i, (v, m) in enumerate(zip(VECTOR, MEANS, strict=True))]
    scored = rows.join(scales, "g").select("g", *MEANS, *[f"s{i}" for i in range(K)], *[x.alias(f"z{i}") for i, x in enumerate(z)])
    norm = reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(K)])
    alike = [F.covar_pop(F.tanh(f"z{i}"), F.tanh(f"z{j}")).alias(f"t{i}{j}") for i, j in PAIRS]
    signs = [F.avg(F.when(norm > 0, F.col(f"z{i}") * F.col(f"z{j}") / norm).otherwise(0.0)).alias(f"u{i}{j}") for i, j in PAIRS]
    summed = materialize(scored.groupBy("g", *MEANS, *[f"s{i}" for i in range(K)]).agg(*alike, *signs))
    product = lambda i, j: F.col(f"s{i}") * F.col(f"s{j}")
    kinds = [
        [product(i, j) * (1.0 if i == j else 0.0) for i, j in PAIRS],
        [product(i, j) * (F.lit(1.0) if i == j else F.col(f"t{i}{j}") / F.greatest(F.sqrt(F.col(f"t{i}{i}") * F.col(f"t{j}{j}")), F.lit(1e-9))) for i, j in PAIRS],
        [product(i, j) * (F.col(f"u{i}{j}") * K + (0.1 if i == j else 0.0)) for i, j in PAIRS],
    ]
    own = lambda k: summed.select("g", F.lit(k).alias("start"), *MEANS, *[x.alias(n) for x, n in zip(kinds[k], SPREAD, strict=True)])
    return own(0).union(own(1)).union(own(2))


def _concentrated(rows: DataFrame, estimates: DataFrame, support: float) -> DataFrame:
    """One concentration step of each estimate (g, start)."""
    measured = rows.join(estimates.select("g", "start", *MEANS, *[f"w{i}{j}" for i in range(K) for j in range(i + 1)]), "g")
    measured = measured.select("g", "start", *VECTOR, _distance().alias("d2"))
    cut = materialize(measured.groupBy("g", "start").agg(F.percentile_approx("d2", F.lit(support), F.lit(1000)).alias("cut")))
    return _prepared(measured.join(cut, ["g", "start"]).where("d2 <= cut").groupBy("g", "start").agg(*_moments()))


def _pooled(estimates: DataFrame, prior: float) -> DataFrame:
    """Each group's mean and covariance averaged with those of all groups' kept rows."""
    n = F.sum("n")
    of_all = estimates.agg(*[(F.sum(F.col(m) * F.col("n")) / n).alias(f"all_{m}") for m in MEANS])
    moved = estimates.crossJoin(F.broadcast(of_all))  # one row
    within = [F.col(f"c{i}{j}") + (F.col(f"m{i}") - F.col(f"all_m{i}")) * (F.col(f"m{j}") - F.col(f"all_m{j}")) for i, j in PAIRS]
    spread = moved.agg(*[(F.sum(x * F.col("n")) / n).alias(f"all_{c}") for x, c in zip(within, SPREAD, strict=True)])
    both = moved.crossJoin(F.broadcast(spread))  # one row
    share = F.col("n") / (F.col("n") + prior)
    return both.select("g", *[(share * F.col(c) + (1 - share) * F.col(f"all_{c}")).alias(c) for c in MEANS + SPREAD])


def robust_distance(rows: DataFrame, groups: list[str], support: float = 0.75, prior: float = 10.0) -> DataFrame:
    """``rows`` with d2 and its group's log_mid and log_scale, the median and scale of log d2.

    They need VECTOR's columns without nulls; the group columns may be null.
    """
    rows = rows.withColumn("g", F.to_json(F.struct(*groups)))
    own = rows.select("g", *VECTOR)
    estimates = _prepared(_starts(own))
    for _ in range(2):
        estimates = _concentrated(own, estimates, support)
    best = estimates.groupBy("g").agg(F.min(F.struct("log_det", "start")).alias("best"))
    estimates = estimates.join(best, "g").where(F.col("start") == F.col("best.start")).drop("best")
    ended = []
    while True:
        before = estimates.select("g", F.col("log_det").alias("before"))
        fell = materialize(_concentrated(own, estimates, support).join(before, "g").where(F.col("before") - F.col("log_det") >= 0.01).drop("before"))
        ended.append(estimates.join(fell, "g", "left_anti").select(fell.columns))
        if fell.isEmpty():
            break
        estimates = fell
    estimates = materialize(reduce(DataFrame.union, ended))
    final = _prepared(_pooled(estimates, prior))
    measured = materialize(rows.join(final.select("g", *MEANS, *[f"w{i}{j}" for i in range(K) for j in range(i + 1)]), "g").select(*rows.columns, F.greatest(_distance(), F.lit(1e-6)).alias("d2")))
    quartiles = F.percentile_approx(F.log("d2"), F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]), F.lit(1000))
    each = measured.groupBy("g").agg(quartiles.alias("q"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(measured.agg(quartiles.alias("all_q"))))  # one row
    share = F.col("n") / (F.col("n") + prior)
    q = [share * F.col("q")[k] + (1 - share) * F.col("all_q")[k] for k in range(3)]
    laws = materialize(each.select("g", q[1].alias("log_mid"), ((q[2] - q[0]) / (2 * QUARTILE)).alias("log_scale")))
    return measured.join(laws, "g").drop("g")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", probability: float = 1e-3, support: float = 0.75, prior: float = 10.0) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2 (null if base_failed), kept.

    d2 is scaled so that its group's median is that of the chi-square law.
    """
    per = text_statistics(docs, [id_col, "lang", "source"])
    n = F.col("n_words").cast("double")
    safe = F.greatest(n, F.lit(1.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    per = per.withColumn("base_failed", failed).select(
        "*",
        F.log1p(n).alias("v1"),
        (F.col("word_chars") / safe).alias("v2"),
        F.log1p(100 * F.col("n_symbols") / safe).alias("v3"),
        F.log1p(10 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("v4"),
    )
    per = materialize(per)
    judged = robust_distance(per.where(~F.col("base_failed")), ["lang", "source"], support, prior)
    beyond = F.log("d2") > F.col("log_mid") + F.lit(NormalDist().inv_cdf(1 - probability)) * F.col("log_scale")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    scaled = F.col("d2") * CHI2_4_MEDIAN / F.exp("log_mid")
    rows = judged.select(id_col, *names, scaled.alias("d2"), (~beyond).alias("kept"))
    return rows.union(per.where("base_failed").select(id_col, *names, F.lit(None).cast("double"), F.lit(False)))
