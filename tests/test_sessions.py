"""Scoring sessions and whole requests: rules that need more than one message or batch."""

import pytest
import json
import random
import shutil
import time

from pyspark.sql import functions as F

from lemmaflow.session import shared_path
from lemmaflow.sources import sinks
from lemmaflow.streaming import agent, sessions


def clause(own, distance, text="p(X)", bare=False):
    return (own, text, distance, True, bare)


def messages(spark, rows):
    """rows: (session, pos, tag, clauses, ids, status)."""
    return sessions.padded(spark.createDataFrame(rows, f"session long, pos long, tag string, clauses {sessions.CLAUSES}, ids array<bigint>, status string"))


def register(pos, *clauses, session=1):
    return (session, pos, "register_clauses", list(clauses), None, None)


def ask(pos, *ids, session=1):
    return (session, pos, "scores_req", None, list(ids), None)


def start(pos, session=1):
    return (session, pos, "server_queries_start", None, None, None)


def final(pos, tag="proof_out", status=None, session=1):
    return (session, pos, tag, None, None, status)


def answers(spark, rows, **options):
    got = sessions.run_sessions(spark, messages(spark, rows), shared_path(spark), **options)
    return {(r["session"], r["request_pos"]): r for r in got.collect()}


def test_conjecture_is_settled_by_message(spark):
    rows = [register(1, clause(5, 3), clause(6, 0)), ask(2, 5, 9), start(3)]
    rows += [register(1, clause(7, None, "long text"), clause(8, 2, "s"), session=2), register(2, clause(9, 0), session=2), ask(3, 7, session=2), start(4, session=2)]
    got = answers(spark, rows, fallback="shortest")
    assert got[1, 2]["conjecture"] == 6 and got[1, 2]["n_missing"] == 1 and got[1, 2]["scores"] == [0.5, 0.0]
    assert got[2, 3]["conjecture"] == 8  # stays, though a clause of distance 0 comes later


def test_no_conjecture(spark):
    rows = [register(1, clause(5, None, bare=True)), ask(2, 4), start(3), ask(4, 4, 5), start(5), register(6, clause(6, 0)), ask(7, 6), start(8)]
    got = answers(spark, rows)
    assert [(got[1, p]["conjecture"], len(got[1, p]["scores"])) for p in (2, 4, 7)] == [(None, 0), (5, 2), (5, 1)]
    got = answers(spark, rows, require_conjecture=True)
    assert [(got[1, p]["conjecture"], got[1, p]["scores"]) for p in (2, 4)] == [(None, []), (None, [0.0, 0.0])] and got[1, 7]["conjecture"] == 6


def test_pairs_are_scored_once(spark):
    rows = [register(1, clause(5, 0), clause(6, 1)), ask(2, 5), start(3), ask(4, 5, 6, 6), start(5), register(6, clause(6, 1, "new text")), ask(7, 6), start(8)]
    got = answers(spark, rows)
    assert [got[1, p]["n_hits"] for p in (2, 4, 7)] == [0, 1, 0]
    assert got[1, 4]["scores"][1] == got[1, 4]["scores"][2] == 1.0 and got[1, 7]["scores"] == [1.0 - 4 / 1000]


def held(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_a_session_that_ends_leaves_no_state(spark):
    path = shared_path(spark)
    live = [register(1, clause(5, 0)), ask(2, 5), start(3), ask(4, 5)]
    ended = [*live, final(5, "szs_result_out", "% SZS status Theorem")]
    again = [*ended, register(6, clause(5, 3)), ask(7, 5), start(8)]
    counts = []
    for name, rows in (("live", live), ("ended", ended), ("again", again), ("open", [*live, final(5, "szs_result_out", "no word")])):
        messages(spark, rows).write.parquet(f"{path}/{name}/in")
        query = sessions.start(spark, spark.readStream.schema(messages(spark, rows).schema).parquet(f"{path}/{name}/in"), f"{path}/{name}", sessions.Session(), sessions.OUT)
        counts.append(held(query))
    assert counts[0] > 0 and counts[1] == 0 and counts[2] > 0 and counts[3] == counts[0]
    got = spark.read.schema(sessions.OUT).parquet(f"{path}/again/out").orderBy("request_pos").collect()
    assert [(r["request_pos"], r["scores"]) for r in got] == [(2, [2.0]), (7, [0.5])]  # request 4 went with its session


def test_an_idle_session_leaves_no_state(spark):
    path, rows = shared_path(spark), [register(1, clause(5, 0)), ask(2, 5)]
    messages(spark, rows).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(messages(spark, rows).schema).parquet(f"{path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    query = sessions.answer_sessions(stream, sessions.Session(idle_ms=1000)).writeStream.format("noop").option("checkpointLocation", f"{path}/state").trigger(processingTime="500 milliseconds").start()
    counts, until = [], time.time() + 60
    while time.time() < until and not (counts and counts[-1] == 0 and max(counts) > 0):
        time.sleep(0.5)
        if query.lastProgress and query.lastProgress["stateOperators"]:
            counts.append(held(query))
    query.stop()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert max(counts) > 0 and counts[-1] == 0


def run_agent(spark, rows, path, **options):
    messages(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(messages(spark, rows).schema).parquet(f"{path}/in")
    agent.run_agent(spark, stream, path, lambda rows: 1.0 / (1 + F.col("conj_dist")), agent.Agent(2, **options))


def test_rounds_ask_for_values_and_wait(spark):
    path = shared_path(spark)
    rows = [register(1, clause(1, 0, "tcf(c_1,plain,(p(c_1)),x)"), clause(2, 1, "tcf(c_2,plain,(p(c_2)),x)"), clause(3, 2), clause(4, 4), clause(5, 1))]
    for k in range(3):  # the third round waits for values, which come in a later batch
        rows += [ask(10 + 2 * k, 2, 8, 3 + k), start(11 + 2 * k)]
    run_agent(spark, rows, path)
    assert [tuple(r) for r in agent.sat_queries(spark, path).collect()] == [(1, 14, 15, 3, [2, 8, 5])]
    assert sorted(r["request_pos"] for r in agent.responses(spark, path).collect()) == [10, 12]
    values = spark.createDataFrame([(1, 16, "cls_sat_eval_gr_res", [2, 2, 8], [[True], [False]])], "session long, pos long, tag string, ids array<bigint>, values array<array<boolean>>")
    sessions.padded(values).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run_agent(spark, [ask(17, 2, 8, 3), start(18)], path)
    got = {r["request_pos"]: r for r in agent.responses(spark, path).collect()}
    assert sorted(got) == [10, 12, 14, 17] and got[17]["answer_of"] == 10 and got[17]["scores"] == got[10]["scores"] == [0.5, 0.02, 1 / 3]
    assert got[14]["release_pos"] == 16 and got[14]["scores"] == [0.5, 0.02, 0.5]


def test_a_batch_that_runs_again_adds_nothing(spark):
    path = shared_path(spark)
    run_agent(spark, [register(1, clause(1, 0), clause(2, 1)), ask(2, 2), start(3)], path)
    before = sinks.manifests(spark, f"{path}/answers").collect()
    # Without the commit of the last batch, the stream runs it again.
    store = path.removeprefix("file://")
    for name in ("0", ".0.crc"):
        shutil.move(f"{store}/state/commits/{name}", f"{store}/{name}")
    run_agent(spark, [ask(4, 1), start(5)], path)
    after = {r["batch_id"]: r for r in sinks.manifests(spark, f"{path}/answers").collect()}
    assert before == [after[0]] and sorted(after) == [0, 1]
    assert sorted(r["request_pos"] for r in agent.responses(spark, path).collect()) == [2, 4]


def test_a_failing_scorer_falls_back(spark):
    path = shared_path(spark)
    messages(spark, [register(1, clause(1, 0), clause(2, 1), clause(3, 5)), ask(2, 2, 3, 7), start(3)]).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(messages(spark, [start(1)]).schema).parquet(f"{path}/in")
    agent.run_agent(spark, stream, path, lambda rows: F.when(F.col("clause_id") != 3, 1.0), agent.Agent())
    got = agent.responses(spark, path).first()
    low, high = 0.7, 1.7  # an unknown clause, and one of distance 1 that is a horn unit
    assert got["is_fallback"] and got["n_selected"] == 2
    assert [round(s, 6) for s in got["scores"]] == [1.0, round((2 / 6 + 0.7 - low) / (high - low), 6), 0.0]


class _Store:
    """A state store that counts what is asked of it."""

    def __init__(self):
        self.maps, self.lists, self.calls = {}, {}, 0

    def getMapState(self, name, key, value):
        return _MapState(self, self.maps.setdefault(name, {}))

    def getListState(self, name, schema):
        return _ListState(self, self.lists.setdefault(name, []))


class _MapState:
    def __init__(self, store, own):
        self.store, self.own = store, own

    def __getattribute__(self, name):
        if name not in ("store", "own"):
            self.store.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return bool(self.own)

    def containsKey(self, k):
        return k in self.own

    def getValue(self, k):
        return self.own[k]

    def updateValue(self, k, v):
        self.own[k] = v

    def removeKey(self, k):
        del self.own[k]

    def iterator(self):
        return iter(list(self.own.items()))

    def clear(self):
        self.own.clear()


class _ListState(_MapState):
    def get(self):
        return iter(list(self.own))

    def put(self, values):
        self.own[:] = values


@pytest.mark.parametrize("recent", [0, 3, 1000])
def test_map_states_over_many_calls(monkeypatch, recent):
    monkeypatch.setattr(sessions, "RECENT", recent)
    rng, store, want = random.Random(recent), _Store(), {}
    for _ in range(400):
        state = sessions.Map(store, "m", "k long", "v long, w string")
        state.begin()
        for _ in range(rng.randrange(6)):
            key, act = (rng.randrange(9),), rng.random()
            if act < 0.5:
                want[key] = (rng.randrange(100), "x")
                state.updateValue(key, want[key])
            elif act < 0.7 and key in want:
                del want[key]
                state.removeKey(key)
            elif act > 0.97:
                want.clear()
                state.clear()
            assert state.containsKey(key) == (key in want) and state.getValue(key) == want.get(key)
        assert dict(state.iterator()) == want and set(state.keys()) == set(want)
        state.flush()


def test_a_small_session_meets_the_store_a_few_times():
    store = _Store()
    state = sessions.Map(store, "m", "k long", "v long")
    state.begin()
    for k in range(500):
        state.updateValue((k,), (k,))
        assert state.containsKey((k,)) and not state.containsKey((k + 500,))
    state.flush()
    assert store.calls <= 5


def test_all_states_of_a_session_are_read_and_written_at_once():
    class Value(_MapState):
        def get(self):
            return self.own.get("held")

        def update(self, row):
            self.own["held"] = row

    store, one = _Store(), {}
    store.getValueState = lambda name, schema: Value(store, one)
    for pos in range(0, 30, 3):
        session = sessions.Session()
        session.init(store)
        store.calls = 0
        clause = dict(clause_id=pos, text="p(\u00e4)", conj_dist=None, bare=False)
        told = [dict(pos=pos, tag="register_clauses", clauses=[clause], status=None), dict(pos=pos + 1, tag="scores_req", ids=[0, pos], status=None), dict(pos=pos + 2, tag="server_queries_start", status=None)]
        (got,) = session.handleInputRows((1,), iter([{"message": json.dumps(m)} for m in reversed(told)]), None)
        assert store.calls == 2 and got["n_missing"] == 0 and got["conjecture"] == 0 and got["n_hits"] == (pos > 0)
    told = {"message": json.dumps(dict(pos=99, tag="timeout", status=None))}
    assert not list(session.handleInputRows((1,), iter([told]), None)) and not one
