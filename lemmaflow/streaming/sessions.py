"""Scoring sessions over a stream: clauses, waiting requests, a conjecture and scored pairs of each session as state.

Messages of a session, in order of pos: ``register_clauses``, ``scores_req`` (ids), ``server_queries_start``, which
answers all waiting requests in their order (in single-slot mode the newest one, which replaces those before it), and
messages that end the session (``is_final``), whose state then goes. What comes after that begins anew.

The conjecture is settled once a message is read whole: the first clause of distance 0 that is registered, or else,
where none was found yet, one of the message's other clauses (the least id, or the shortest or longest text); clauses
without any features count as neither. It stays. A request that finds no conjecture takes its first known clause as
one, or is answered by zeros if a conjecture is required.
"""

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lemmaflow.operators.requests import FINAL

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLAUSES = "array<struct<clause_id:bigint,text:string,conj_dist:int,horn:boolean,bare:boolean>>"
MESSAGE = f"session bigint, pos bigint, tag string, clauses {CLAUSES}, ids array<bigint>, component string, component_id bigint, values array<array<boolean>>, status string"
OUT = "session long, request_pos long, start_pos long, conjecture long, n_missing long, n_hits long, scores array<double>"


def ends_session(tag: str, status: str | None) -> bool:
    """The row form of ``requests.is_final``, with the tags that end a connection."""
    named = tag in ("szs_result_out", "szs_status_out") and any(word in (status or "").strip().lower() for word in FINAL)
    return named or tag in ("proof_out", "timeout", "terminate")


def missing(value) -> bool:
    """Whether a cell of a batch is null."""
    return value is None or value != value  # NaN


#: Entries of a map state that are kept beside it; more go to the map itself.
RECENT = 1024


class Held:
    """What a session's states hold, by name, as one value: a call reads it once and writes it once."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.state = handle.getValueState("held", "held string")

    def begin(self) -> None:
        self.read = self.changed = False

    def _all(self) -> dict:
        if not self.read:
            got = self.state.get()
            self.read, self.there, self.own = True, got is not None, json.loads(got[0]) if got is not None else {}
        return self.own

    def get(self, name: str) -> list | None:
        return self._all().get(name)

    def put(self, name: str, value: list | tuple | None) -> None:
        self._all()[name] = value
        self.changed = True

    def flush(self) -> None:
        if not self.changed:
            return
        own = {k: v for k, v in self.own.items() if v is not None}
        if own:
            self.state.update((json.dumps(own),))
        elif self.there:
            self.state.clear()


class Alone:
    """The same of one map that no other state stands beside: a list state."""

    def __init__(self, handle: StatefulProcessorHandle, state, name: str, key: str, value: str):
        self.state, self.list = state, handle.getListState(f"{name}_recent", f"{key}, {value}, gone boolean")
        self.keys_of, self.width = len(key.split(", ")), len(value.split(", "))

    def get(self, name: str) -> tuple[bool, list]:
        rows = [tuple(r) for r in self.list.get()] if self.list.exists() else []
        return self.state.exists(), [(r[: self.keys_of], None if r[-1] else r[self.keys_of : -1]) for r in rows]

    def put(self, name: str, value: list | None) -> None:
        none = (None,) * self.width
        if value and value[1]:
            self.list.put([(*k, *(none if v is None else v), v is None) for k, v in value[1]])
        elif self.list.exists():
            self.list.clear()


class Value:
    """A row of a session, or none."""

    def __init__(self, held: Held, name: str):
        self.held, self.name = held, name

    def begin(self) -> None:
        pass

    def get(self) -> list | tuple | None:
        return self.held.get(self.name)

    def exists(self) -> bool:
        return self.get() is not None

    def update(self, value: tuple | None) -> None:
        self.held.put(self.name, value)

    def clear(self) -> None:
        self.update(None)

    def flush(self) -> None:
        pass


class Several(Value):
    """A list of rows."""

    def put(self, values: list) -> None:
        self.update(values or None)

    def appendValue(self, value: tuple) -> None:
        self.update([*(self.get() or []), value])


class Map:
    """A map state. What changed lately is held beside it, RECENT entries at most.

    So a small session's entries need no exchange of their own with the state store, and a large one's only those it names.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, key: str, value: str, held: Held | None = None):
        self.state = handle.getMapState(name, key, value)
        self.held, self.name = held or Alone(handle, self.state, name, key, value), name

    def begin(self) -> None:
        self.read = self.changed = self.dropped = False

    def _recent(self) -> dict:
        if not self.read:
            self.below, rows = self.held.get(self.name) or (False, [])  # below: whether the map itself holds anything
            self.own = {tuple(k): None if v is None else tuple(v) for k, v in rows}
            self.read = True
        return self.own

    def getValue(self, key: tuple) -> tuple | None:
        own = self._recent()
        if key in own:
            return own[key]
        return self.state.getValue(key) if self.below and self.state.containsKey(key) else None

    def containsKey(self, key: tuple) -> bool:
        return self.getValue(key) is not None

    def updateValue(self, key: tuple, value: tuple | None) -> None:
        self._recent()[key] = value
        self.changed = True

    def removeKey(self, key: tuple) -> None:
        self.updateValue(key, None)

    def iterator(self):
        own = self._recent()
        yield from ((k, v) for k, v in own.items() if v is not None)
        if self.below:
            yield from ((tuple(k), v) for k, v in self.state.iterator() if tuple(k) not in own)

    def keys(self):
        return (k for k, _ in self.iterator())

    def clear(self) -> None:
        self._recent()
        self.dropped |= self.below
        self.own, self.changed, self.below = {}, True, False

    def flush(self) -> None:
        if self.dropped:
            self.state.clear()
        if not self.changed:
            return
        if len(self.own) > RECENT:
            for key, value in self.own.items():
                if value is not None:
                    self.state.updateValue(key, value)
                elif self.below and self.state.containsKey(key):
                    self.state.removeKey(key)
            self.own, self.below = {}, self.below or any(v is not None for v in self.own.values())
        elif not self.below:
            self.own = {k: v for k, v in self.own.items() if v is not None}
        self.held.put(self.name, [self.below, list(self.own.items())] if self.own or self.below else None)


class Processor(StatefulProcessor):
    """Messages in order of pos; all state of a session goes when it ends, or when nothing came for ``idle_ms``.

    ``states`` are Value, Several and Map: they meet the state store when a call begins to use them and when it ends, all
    but the entries of large maps in one exchange.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def states(self, handle: StatefulProcessorHandle, held: Held) -> list:
        raise NotImplementedError

    def message(self, session: int, row: dict) -> list[dict]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.whole = handle, Held(handle)
        self.held = self.states(handle, self.whole)

    def clear(self) -> None:
        for state in self.held:
            state.clear()

    def begin(self) -> None:
        for state in (self.whole, *self.held):
            state.begin()

    def flush(self) -> None:
        for state in (*self.held, self.whole):
            state.flush()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        out: list[dict] = []
        self.begin()
        # Arrival order is the only clock: a session's rows of one batch are put in order of pos.
        for row in sorted((json.loads(row["message"]) for row in rows), key=lambda row: row["pos"]):
            if ends_session(row["tag"], row["status"]):
                self.clear()
            else:
                out += self.message(int(key[0]), row)
        self.flush()
        if self.idle_ms is not None:
            for (due,) in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        return (Row(**{c: row.get(c) for c in self.names}) for row in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.begin()
        self.clear()
        self.flush()
        return iter(())


def by_distance(conjecture: str, texts: list[str], distances: list[int | None]) -> list[float]:
    """A stand-in for a model: near clauses of the conjecture's length score high."""
    return [2.0 / (1 + (9999 if d is None else d)) - abs(len(conjecture) - len(t)) / 1000 for t, d in zip(texts, distances, strict=True)]


class Session(Processor):
    """Maps for clauses and scores, so that a batch of a large session touches only what it names."""

    names = [x.split()[0] for x in OUT.split(", ")]

    def __init__(self, single_slot: bool = False, fallback: str = "first", require_conjecture: bool = False, score: Callable = by_distance, idle_ms: int | None = None):
        super().__init__(idle_ms)
        self.single_slot, self.fallback, self.require_conjecture, self.score = single_slot, fallback, require_conjecture, score

    def states(self, handle: StatefulProcessorHandle, held: Held) -> list:
        self.clauses = Map(handle, "clauses", "clause_id long", "text string, conj_dist int", held)
        self.scored = Map(handle, "scored", "clause_id long, text_hash string", "score double", held)
        self.waiting = Several(held, "waiting")  # pos, ids
        self.conjecture = Value(held, "conjecture")  # clause_id, text
        return [self.clauses, self.scored, self.waiting, self.conjecture]

    def message(self, session: int, row: dict) -> list[dict]:
        if row["tag"] == "register_clauses":
            self._register(row["clauses"])
        elif row["tag"] == "scores_req":
            asked = (int(row["pos"]), [int(i) for i in row["ids"]])
            self.waiting.put([asked]) if self.single_slot else self.waiting.appendValue(asked)
        elif row["tag"] == "server_queries_start" and self.waiting.exists():
            answers = [dict(session=session, request_pos=pos, start_pos=int(row["pos"]), **self._answer(list(ids))) for pos, ids in list(self.waiting.get())]
            self.waiting.clear()
            return answers
        return []

    def _register(self, clauses) -> None:
        pool: dict[int, str] = {}  # where a conjecture is missing, so are other clauses of earlier messages
        for c in clauses if clauses is not None else []:
            own, text = int(c["clause_id"]), c["text"] or ""
            distance = None if missing(c["conj_dist"]) else int(c["conj_dist"])
            self.clauses.updateValue((own,), (text, distance))
            if c["bare"]:
                continue
            if distance != 0:
                pool[own] = text
            elif not self.conjecture.exists():
                self.conjecture.update((own, text))
        if pool and not self.conjecture.exists():
            pick = {"first": min, "shortest": lambda p: min(p, key=lambda k: len(p[k])), "longest": lambda p: max(p, key=lambda k: len(p[k]))}[self.fallback]
            own = pick(pool)
            self.conjecture.update((own, pool[own]))

    def _answer(self, ids: list[int]) -> dict:
        """Scores: none if no id is known, else one for each id, 0 for unknown ones."""
        known = {i: self.clauses.getValue((i,)) for i in ids if self.clauses.containsKey((i,))}
        out = {"n_missing": sum(i not in known for i in ids), "n_hits": 0, "scores": [0.0] * len(ids) if known else []}
        if known and not self.conjecture.exists() and not self.require_conjecture:
            first = next(i for i in ids if i in known)
            self.conjecture.update((first, known[first][0]))
        out["conjecture"] = int(self.conjecture.get()[0]) if self.conjecture.exists() else None
        if not known or not self.conjecture.exists():
            return out
        # A pair of the conjecture, which stays, and a clause's text is scored once.
        keys = {i: (i, hashlib.sha1(text.encode()).hexdigest()) for i, (text, _) in known.items()}
        scores = {i: self.scored.getValue(k)[0] for i, k in keys.items() if self.scored.containsKey(k)}
        new = [i for i in known if i not in scores]
        for i, score in zip(new, self.score(self.conjecture.get()[1], [known[i][0] for i in new], [known[i][1] for i in new]), strict=True):
            scores[i] = float(score)
            self.scored.updateValue(keys[i], (float(score),))
        return out | {"n_hits": len(known) - len(new), "scores": [float(scores.get(i, 0.0)) for i in ids]}


def answer_sessions(messages: DataFrame, processor: StatefulProcessor | None = None, out: str = OUT) -> DataFrame:
    """messages (streaming): the columns of MESSAGE."""
    processor = processor or Session()
    # Spark reads a group's rows cell by cell, so a message is one cell.
    rest = [c for c in messages.columns if c != "session"]
    whole = messages.select("session", F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("message"))
    return whole.groupBy("session").transformWithState(processor, out, "Append", "None" if processor.idle_ms is None else "ProcessingTime")


def start(spark: SparkSession, messages: DataFrame, path: str, processor: StatefulProcessor, out: str, sink: Callable | None = None):
    """A query that streams the messages' files to their end, into files under ``path`` or to ``sink`` by batch.

    With timers a stream has no end: start such a one from ``answer_sessions``, with a trigger of its own.
    """
    if processor.idle_ms is not None:
        raise ValueError("a stream with idle_ms has no end")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = answer_sessions(messages, processor, out)
        writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
        query = (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{path}/out")).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return query


def run_sessions(spark: SparkSession, messages: DataFrame, path: str, **options) -> DataFrame:
    """Writes ``messages`` (batch) under ``path``, streams them to their end, and gives the answers."""
    messages.repartition("session").write.parquet(f"{path}/in")
    start(spark, spark.readStream.schema(messages.schema).parquet(f"{path}/in"), path, Session(**options), OUT)
    return spark.read.schema(OUT).parquet(f"{path}/out")


def padded(messages: DataFrame) -> DataFrame:
    """``messages`` with all columns of MESSAGE; missing ones are null."""
    fields = [f.strip().split(" ", 1) for f in MESSAGE.split(", ")]
    return messages.select(*[(F.col(n) if n in messages.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
