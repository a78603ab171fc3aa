"""The scorer seam: a scorer is a function of a query's and a candidate's column to a column of scores.

Any such function serves, built-in expressions or a vectorized UDF around a model; no model is part of this library.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions import scores
from lemmaflow.operators.scoring import fuse, shortlist

Scorer = Callable[[Column, Column], Column]


def of_clause(score: Callable[[Column], Column]) -> Scorer:
    """A scorer that leaves the query aside."""
    return lambda query, candidate: score(candidate)


def of_vectors(encode: Callable[[Column], Column]) -> Scorer:
    """Dot products of both texts' vectors."""
    return lambda query, candidate: scores.dot(encode(query), encode(candidate))


def mean_logprob(logprobs: Column, mask: Column) -> Column:
    """The mean of the tokens' log-probabilities under the mask; 0 where it is empty."""
    n = F.aggregate(mask, F.lit(0), lambda a, m: a + m)
    total = F.aggregate(F.zip_with(logprobs, mask, lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, total / n).otherwise(0.0)


def direct(logprob: Scorer) -> Scorer:
    """``logprob`` of the candidate after the query and a line end; a null query is empty."""
    return lambda query, candidate: logprob(F.concat(F.coalesce(query, F.lit("")), F.lit("\n")), candidate)


def with_pmi(logprob: Scorer, weight: float = 0.7) -> Scorer:
    return lambda query, candidate: scores.pmi(direct(logprob)(query, candidate), logprob(F.lit(""), candidate), weight)


def score(pairs: DataFrame, scorer: Scorer, query: str = "query", text: str = "text") -> DataFrame:
    return pairs.withColumn("score", scorer(F.col(query), F.col(text)).cast("double"))


def score_then_rerank(pairs: DataFrame, first: Scorer, second: Scorer, k: int, by: list[str], query: str = "query", text: str = "text") -> DataFrame:
    """``pairs`` (pos, query, text) with score and reranked: the best ``k`` of each group by ``first`` have ``second``'s score.

    Only those are given to ``second``.
    """
    scored = score(pairs, first, query, text)
    top = shortlist(scored, k, by).drop("rank")
    top = top.withColumn("second", second(F.col(query), F.col(text)).cast("double")).select(*by, "pos", "second")
    joined = scored.join(top, [*by, "pos"], "left")
    return joined.withColumn("reranked", F.col("second").isNotNull()).withColumn("score", F.coalesce("second", "score")).drop("second")


def load_scorer(mode: str, **parts) -> Callable[[DataFrame], DataFrame]:
    """A function of pairs to scored pairs, by mode: clause, cross, bi, direct, pmi, bi_then_cross, bi_then_direct, bi_then_pmi, fusion."""
    if mode == "fusion":
        return lambda pairs: pairs.join(fuse(pairs.select("id").distinct(), parts["sources"], parts["weights"]), "id")
    second = {"cross": lambda: parts["score"], "direct": lambda: direct(parts["logprob"]), "pmi": lambda: with_pmi(parts["logprob"], parts.get("weight", 0.7))}
    if mode.startswith("bi_then_"):
        return lambda pairs: score_then_rerank(pairs, of_vectors(parts["encode"]), second[mode.removeprefix("bi_then_")](), parts.get("k", 128), parts.get("by", ["query"]))
    if mode == "clause":
        return lambda pairs: score(pairs, of_clause(parts["score"]))
    if mode == "bi":
        return lambda pairs: score(pairs, of_vectors(parts["encode"]))
    if mode not in second:
        raise ValueError(f"no scorer mode {mode}")
    return lambda pairs: score(pairs, second[mode]())
