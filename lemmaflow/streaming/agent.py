"""Whole score requests on a stream: what is asked becomes a canonical batch, is prefiltered, scored and answered.

State of a session (``Agent``): clauses in their order, the one request that waits, rounds of queries, ground SAT
values, and the keys of requests that were answered. A start of queries asks for ground values every third round and
waits for them, and otherwise releases the request; a request that comes sets the values back. A released request
comes out with the clauses of its batch: the conjecture, the first others as context, and those asked for.

A micro-batch of released requests (``score_released``) is one plan of joins: canonical batch, tags, prefilter, scorer,
a floor for what wasn't selected, and a fallback for requests whose scorer fails (gives a null). Micro-batches are
written once each (``sinks.write_once``). A request that was answered before under the same key has that answer.
"""

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from lemmaflow.functions import formula as trees
from lemmaflow.functions import scores, text
from lemmaflow.operators import scoring, symbols
from lemmaflow.session import written_once
from lemmaflow.sources.sinks import read_once, write_once
from lemmaflow.streaming.sessions import Held, Map, Processor, Value, missing, start

OUT = (
    "session bigint, request_pos bigint, release_pos bigint, kind string, round bigint, ids array<bigint>, supports array<double>,"
    " answer_of bigint, clause_id bigint, role string, rank bigint, text string, conj_dist int, horn boolean"
)
ANSWER = "session bigint, request_pos bigint, release_pos bigint, round bigint, answer_of bigint, n_selected bigint, is_fallback boolean, scores array<double>"
#: Places of the roles in a batch's order.
ROLE = 1 << 40


class Agent(Processor):
    """Emits rows of kind sat_query (ids to ask values of), request, and clause (of a request's batch)."""

    names = [x.split()[0] for x in OUT.split(", ")]

    def __init__(self, context: int = 128, sat_every: int | None = 3, sat_in_key: bool = True, idle_ms: int | None = None):
        super().__init__(idle_ms)
        self.context, self.sat_every, self.sat_in_key = context, sat_every, sat_in_key

    def states(self, handle: StatefulProcessorHandle, held: Held) -> list:
        self.clauses = Map(handle, "clauses", "clause_id long", "place long, text string, conj_dist int, horn boolean", held)
        self.places = Map(handle, "places", "place long", "clause_id long", held)
        self.goals = Map(handle, "goals", "place long", "clause_id long", held)  # clauses of distance 0
        self.count = Value(held, "count")  # n
        self.pending = Value(held, "pending")  # pos, ids, component, component_id
        self.rounds = Value(held, "rounds")  # n
        self.values = Map(handle, "values", "clause_id long", "truths array<boolean>", held)
        self.answered = Map(handle, "answered", "request string", "pos long", held)
        return [self.clauses, self.places, self.goals, self.count, self.pending, self.rounds, self.values, self.answered]

    def message(self, session: int, row: dict) -> list[dict]:
        tag, pos = row["tag"], int(row["pos"])
        if tag == "register_clauses":
            for c in row["clauses"] if row["clauses"] is not None else []:
                self._register(c)
        elif tag == "scores_req":
            if self.sat_every:
                self.values.clear()
            component_id = None if missing(row["component_id"]) else int(row["component_id"])
            self.pending.update((pos, [int(i) for i in row["ids"]], row["component"], component_id))
        elif tag == "server_queries_start" and self.pending.exists():
            if not self.sat_every:
                return self._release(session, pos)
            n = self._next(self.rounds)
            if n % self.sat_every:
                return self._release(session, pos)
            asked, ids = self.pending.get()[:2]
            return [dict(session=session, request_pos=asked, release_pos=pos, kind="sat_query", round=n, ids=list(ids))]
        elif tag == "cls_sat_eval_gr_res":
            self.values.clear()
            ids, values = ([] if x is None else list(x) for x in (row["ids"], row["values"]))
            for k, own in enumerate(ids):  # the last one of an id counts
                self.values.updateValue((int(own),), ([bool(v) for v in values[k]] if k < len(values) else [],))
            if self.pending.exists():
                return self._release(session, pos)
        return []

    def _next(self, counter) -> int:
        n = int(counter.get()[0]) + 1 if counter.exists() else 1
        counter.update((n,))
        return n

    def _register(self, c: dict) -> None:
        own = (int(c["clause_id"]),)
        place = int(self.clauses.getValue(own)[0]) if self.clauses.containsKey(own) else self._next(self.count)
        distance = None if missing(c["conj_dist"]) else int(c["conj_dist"])
        self.clauses.updateValue(own, (place, c["text"] or "", distance, bool(c["horn"])))
        self.places.updateValue((place,), own)
        if distance == 0:
            self.goals.updateValue((place,), own)
        elif self.goals.containsKey((place,)):
            self.goals.removeKey((place,))

    def _release(self, session: int, pos: int) -> list[dict]:
        asked, ids, component, component_id = self.pending.get()
        ids = [int(i) for i in ids]
        self.pending.clear()
        values = {int(k[0]): [bool(x) for x in v[0]] for k, v in self.values.iterator()}
        snapshot = json.dumps(values, sort_keys=True) if values and self.sat_in_key else "nosat"
        key = (hashlib.sha1(json.dumps([ids, component, component_id, snapshot]).encode()).hexdigest(),)
        base = dict(session=session, request_pos=int(asked), release_pos=pos)
        head = base | dict(kind="request", round=int(self.rounds.get()[0]) if self.rounds.exists() else 0, ids=ids)
        if self.answered.containsKey(key):
            return [head | dict(answer_of=int(self.answered.getValue(key)[0]))]
        self.answered.updateValue(key, (int(asked),))
        head["supports"] = [sum(v) / len(v) if (v := values.get(i)) else None for i in ids]
        out, goal = [head], min((int(p[0]) for p in self.goals.keys()), default=None)
        conjecture = int(self.goals.getValue((goal,))[0]) if goal is not None else None

        def add(own: int, role: str, rank: int) -> None:
            _, written, distance, horn = self.clauses.getValue((own,))
            out.append(base | dict(kind="clause", clause_id=own, role=role, rank=rank, text=written, conj_dist=distance, horn=horn))

        if conjecture is not None:
            add(conjecture, "conjecture", 1)
        wanted, place, taken = {*ids, conjecture}, 1, 0
        while self.places.containsKey((place,)):
            own = int(self.places.getValue((place,))[0])
            if own not in wanted:
                taken += 1
                add(own, "context", taken)
                if taken >= self.context:  # as many as asked for, but one at least
                    break
            place += 1
        candidates = [i for i in dict.fromkeys(ids) if i != conjecture and self.clauses.containsKey((i,))]
        for rank, own in enumerate(candidates, 1):
            add(own, "candidate", rank)
        return out


def score_released(rows: DataFrame, scorer: Callable[[DataFrame], Column], floor: float = 0.02, **keep) -> DataFrame:
    """ANSWER of released requests (rows of Agent; read several times). ``scorer``: a column over the selected candidates.

    It may use batch, request_pos, clause_id, formula and conjecture (both canonical), conj_dist and horn.
    ``keep``: the arguments of the prefilter.
    """
    name = F.concat_ws(":", "session", "request_pos").alias("batch")
    requests = rows.where("kind = 'request'").select(name, *OUT_HEAD)
    raw = trees.wrapped_formula(text.clean_clause(F.col("text")))
    order = F.when(F.col("role") == "conjecture", 0).when(F.col("role") == "context", 1).otherwise(2) * ROLE + F.col("rank")
    clauses = written_once(rows.where("kind = 'clause'").select(name, F.col("clause_id").alias("key"), order.alias("ord"), raw.alias("formula"), "conj_dist", "horn"))
    own = clauses.select("batch", "key", "ord", "formula")
    canonical = written_once(symbols.canonical_batch(own, own)[0].select("batch", "key", "ord", "canonical"))
    conjectures = canonical.where(F.col("ord") < ROLE).select("batch", "canonical")
    asked = canonical.where(F.col("ord") >= 2 * ROLE).select("batch", "key", "canonical")
    tags = symbols.tree_tags(asked, symbols.conjecture_targets(conjectures)).select("batch", "key", "touches", "equation", "first_arg", "n_shared")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    candidates = asked.join(tags, ["batch", "key"], "left").join(clauses.select("batch", "key", "conj_dist", "horn"), ["batch", "key"])
    candidates = candidates.join(conjectures.withColumnRenamed("canonical", "conjecture"), "batch", "left").join(requests.select("batch", "request_pos"), "batch")
    candidates = candidates.select("batch", F.col("key").alias("clause_id"), F.col("canonical").alias("formula"), "conjecture", "conj_dist", "horn", "request_pos", *map(no, ("touches", "equation", "first_arg")), F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    selected = scoring.prefilter(candidates, "batch", **keep)
    scored = written_once(selected.withColumn("score", scorer(selected).cast("double")).select("batch", "clause_id", "score"))
    failed = scored.groupBy("batch").agg(F.count(F.lit(1)).alias("n_selected"), F.bool_or(F.col("score").isNull()).alias("is_fallback"))

    fresh = requests.where("answer_of is null").join(failed, "batch", "left").withColumn("is_fallback", F.coalesce("is_fallback", F.lit(False)))
    one = fresh.select("batch", "is_fallback", F.posexplode(F.arrays_zip("ids", "supports")).alias("at", "x")).select("batch", "is_fallback", "at", F.col("x.ids").alias("clause_id"), F.col("x.supports").alias("support"))
    met = one.join(clauses.select("batch", F.col("key").alias("clause_id"), "formula", "conj_dist", "horn"), ["batch", "clause_id"], "left").join(scored, ["batch", "clause_id"], "left")
    raw_score = scores.fallback_raw(F.coalesce("formula", F.lit("")), F.col("conj_dist"), F.coalesce("horn", F.lit(False)), F.col("support"))
    met = met.withColumn("raw", raw_score).withColumn("fallback", scores.normalized(F.col("raw"), ["batch"], "minmax"))
    final = F.when(F.col("is_fallback"), F.col("fallback")).otherwise(F.coalesce("score", F.lit(floor)))
    listed = met.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", final.alias("s")))), lambda x: x["s"]).alias("scores"))
    answers = fresh.join(listed, "batch", "left").select("batch", F.coalesce("n_selected", F.lit(0)).alias("n_selected"), "is_fallback", F.coalesce("scores", F.array().cast("array<double>")).alias("scores"))
    return requests.join(answers, "batch", "left").select(*[F.col(c).cast(t) for c, t in (x.split(" ", 1) for x in ANSWER.split(", "))])


OUT_HEAD = ["session", "request_pos", "release_pos", "round", "ids", "supports", "answer_of"]


def run_agent(spark: SparkSession, messages: DataFrame, path: str, scorer: Callable[[DataFrame], Column], agent: Agent | None = None, **keep) -> None:
    """Streams ``messages`` (streaming, MESSAGE) to their end; what comes out is under ``path``, each micro-batch once."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = written_once(batch)
        write_once(score_released(rows, scorer, **keep), f"{path}/answers", batch_id)
        write_once(rows.where("kind = 'sat_query'").select("session", "request_pos", F.col("release_pos").alias("start_pos"), "round", "ids"), f"{path}/sat_queries", batch_id)

    start(spark, messages, path, agent or Agent(), OUT, sink)


def responses(spark: SparkSession, path: str) -> DataFrame:
    """ANSWER of all requests so far; those that repeat an answered one have its scores."""
    answers = read_once(spark, f"{path}/answers")
    first = answers.where("answer_of is null").select("session", F.col("request_pos").alias("answer_of"), *[F.col(c).alias(f"own_{c}") for c in ("scores", "n_selected", "is_fallback")])
    met = answers.join(first, ["session", "answer_of"], "left")
    return met.select(*[F.coalesce(c, f"own_{c}").alias(c) if c in ("scores", "n_selected", "is_fallback") else F.col(c) for c in answers.columns])


def sat_queries(spark: SparkSession, path: str) -> DataFrame:
    """session, request_pos, start_pos, round, ids of the queries for ground values."""
    return read_once(spark, f"{path}/sat_queries")
