"""Golden cases and properties of the operators."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lemmaflow.functions import formula, scores, text
from lemmaflow.operators import caching, dataset, encoding, evaluation, labeling, ordering, requests, scorers, scoring, symbols
from lemmaflow.plans import registry
from lemmaflow.sources import messages, sinks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_clean_clause(spark):
    assert one(spark, "p(X),file('a', u1)).", text.clean_clause) == "p(X)"
    assert one(spark, "p(X) , inference(r)", text.clean_clause) == "p(X)"
    assert one(spark, "profile(X)", text.clean_clause) == "pro"


def test_normalize_masks_long_words_twice(spark):
    assert one(spark, "a" * 41 + " Xy=f(b)", text.normalize_text) == "<VAR> VAR = f ( b )"


def test_messages_from_a_log(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(
        b'{"tag":"register_clauses","clauses":[{"clause_id":1,"clause":"p(X)","clause_features":{"born":3}},{"clause_id":"x"}]}\x00'
        b'{"tag":"given_clause","clause_ids":[1,"2"]}\n{bad\n[1]\n{"tag":"a"}{"tag":"b"}\x00'
        b'{"tag":"register_clauses","clauses":[{"clause_id":1,"clause":null}]}\x00{"tag":"proof_out","clause_ids":[1],"w":NaN}\n'
    )
    read = messages.read_event_logs(spark, str(log)).cache()
    assert [r["tag"] for r in read.orderBy("msg_pos").collect()] == ["register_clauses", "given_clause", "register_clauses", "proof_out"]
    index = messages.clause_index(messages.register_rows(read)).collect()
    assert [(r["clause_id"], r["text"]) for r in index] == [(1, None)]
    flags = {r["clause_id"]: (r["is_proof"], r["is_given"]) for r in messages.membership(read).collect()}
    assert flags == {1: (True, True), 2: (False, True)}


def test_proof_ids(spark):
    t = "x\nSZS output start CNFRefutation\ntcf(c_12,plain,a\ntcf(c_7,plain,b\nSZS output end CNFRefutation\ntcf(c_9,"
    assert one(spark, t, messages.proof_ids_of_text) == [7, 12]
    assert one(spark, "SZS output start CNFRefutation tcf(c_3,", messages.proof_ids_of_text) == [3]
    assert one(spark, "nothing", messages.proof_ids_of_text) == []


def test_last_given_overshoots(spark):
    rows = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 0, 20), ("a", 2, 1, 21), ("a", 2, 2, 22)], "problem string, msg_pos int, item_pos int, clause_id int")
    got = labeling.last_given(rows, 2).orderBy("rank").collect()
    assert [r["clause_id"] for r in got] == [22, 21]


def test_symbols_and_variables():
    rows = formula.scan("![X0:$i]: (~p(f(X0,a))|g(b)=c)")
    assert [(name, "variable" if variable else "constant" if constant else "call", arity) for _, _, name, variable, constant, arity, _ in rows[:-1]] == [
        ("X0", "variable", 0), ("p", "call", 1), ("f", "call", 2), ("X0", "variable", 0), ("a", "constant", 0),
        ("g", "call", 1), ("b", "constant", 0), ("c", "constant", 0),
    ]


def test_auc_of_one_class_is_null(spark):
    rows = spark.createDataFrame([("g", 1.0, 1.0, 0)], "group_id string, score double, label double, pos long")
    assert tuple(evaluation.auc_ap(rows).first()) == (None, None)


def test_predictions_by_alias(spark):
    rows = spark.createDataFrame([("p", "q", "", None, "0.5", "1"), ("p", "q", "g", "x", None, "1")], "problem_name string, query string, group_id string, score string, ce_score string, y string")
    assert [tuple(r)[:3] for r in evaluation.resolve_predictions(rows).collect()] == [("p||q", 0.5, 1.0)]


def test_jsonl_leaves_out_optional_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, None), (2, "b", "c")], "a int, bucket string, component string")
    sinks.write_jsonl(rows.coalesce(1), str(tmp_path / "o"), omit_nulls=["component"])
    lines = sorted(x for f in (tmp_path / "o").glob("part-*") for x in f.read_text().split("\n") if x)
    assert lines == ['{"a":1,"bucket":null}', '{"a":2,"bucket":"b","component":"c"}']


def test_chunks_stop_after_a_short_one(spark):
    df = spark.range(1).select(text.chunks(F.sequence(F.lit(1), F.lit(10)), 4, 3).alias("c"))
    assert df.first()["c"] == [[1, 2, 3, 4], [4, 5, 6, 7], [7, 8, 9, 10], [10]]


def test_bytes_that_are_no_text_go(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b'{"tag":"a\xff\xc3","component":"\xef\xbf\xbd\xc3\xa9\xe2\x82"}\n{"tag":"b"}\x00\xfe')
    read = messages.read_event_logs(spark, str(log)).orderBy("msg_pos").collect()
    assert [(r["tag"], r["component"]) for r in read] == [("a", "\ufffd\u00e9"), ("b", None)]


def test_doubled_requests_count_once(spark):
    lines = ['{"tag":"scores_req","clause_ids":[1]}', '{"tag":"given_clause","clause_ids":[1]}', '{"tag":"scores_req","clause_ids":[1],"component":null}', '{"tag":"scores_res","scores":[1.0]}']
    lines += [lines[0], '{"tag":"scores_req","clause_ids":[2]}', lines[0], lines[3], '{"clauses":[]}']
    rows = spark.createDataFrame([("a", k, x) for k, x in enumerate(lines)] + [("b", 0, lines[0])], "source string, msg_pos int, raw string")
    left = messages.without_doubled_requests(messages.parse_messages(rows)).orderBy("source", "msg_pos").collect()
    assert [(r["source"], r["msg_pos"]) for r in left] == [("a", 0), ("a", 1), ("a", 3), ("a", 4), ("a", 5), ("a", 7), ("a", 8), ("b", 0)]


def test_last_ground_values_of_an_id_count(spark):
    raw = '{"tag":"cls_sat_eval_gr_res","clause_ids":[5,6,5,7],"sat_lit_gr_vals":[[true],[false],[false,true]]}'
    got = requests.sat_values(messages.parse_messages(spark.createDataFrame([("a", 1, raw)], "source string, msg_pos int, raw string")))
    assert got.first()["values"] == {5: [False, True], 6: [False], 7: []}


def test_positions_over_ranges_and_ties_of_files(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("p").alias("part")).repartition(7)
    got = ordering.positions(rows, [F.desc("x")])
    assert got.where("position <> 999 - x").isEmpty() and got.count() == 1000 and got.columns == ["x", "part", "position"]
    assert ordering.positions(rows.limit(0), [F.desc("x")]).isEmpty()
    ordering.write_in_order(rows, [F.col("x")], str(tmp_path / "o"))
    lines = [x for f in sorted((tmp_path / "o").glob("part-*")) for x in f.read_text().split()]
    assert lines == [f'{{"x":{k},"part":"p"}}' for k in range(1000)]


def test_dynamic_ids_with_split_tokens(spark):
    rows = [(2, "b a  b"), (1, " a a c"), (3, ""), (4, None)]
    for share in (1, 1000):
        got = {r["k"]: r["ids"] for r in encoding.encode_dynamic(spark.createDataFrame(rows, "k int, text string"), "k", share=share).collect()}
        assert got == {1: [2, 2, 3], 2: [4, 2, 4], 3: [5]}  # an empty text is one empty token


def test_a_batch_is_written_once(spark, tmp_path):
    path = str(tmp_path / "w")
    assert sinks.read_once(spark, path, "x long").isEmpty()
    for number, n in ((0, 3), (1, 5), (1, 50)):
        sinks.write_once(spark.range(n).toDF("x"), path, number)
    assert sinks.read_once(spark, path).count() == 8
    told = {r["batch_id"]: r for r in sinks.manifests(spark, path).collect()}
    assert {k: r["n_rows"] for k, r in told.items()} == {0: 3, 1: 5} and all(r["stamp"] > 0 and r["digest"] for r in told.values())
    # A try that died before its manifest leaves rows that don't count, and are written over.
    spark.range(9).toDF("x").write.parquet(f"{path}/data/batch=000000000002")
    assert sinks.read_once(spark, path).count() == 8
    sinks.write_once(spark.range(1).toDF("x"), path, 2)
    assert sinks.read_once(spark, path).count() == 9
    sinks.write_artifacts(spark.createDataFrame([("r1", 1), ("r2", 2)], "request_id string, v int"), str(tmp_path / "a"), 0)
    found = {f.parent.name: f.read_text() for f in (tmp_path / "a" / "data").rglob("part-*.txt")}
    assert found == {"request_id=r1": '{"v":1}\n', "request_id=r2": '{"v":2}\n'}


def test_kept_scores_equal_new_ones(spark, tmp_path):
    def pairs(ids):
        return spark.createDataFrame([(q, i, float(q * 10 + i)) for q in (1, 2) for i in ids], "query_id long, id long, x double")

    path, scorer = str(tmp_path / "kept"), F.col("x") * 2
    rounds = [caching.score_new(pairs(ids), scorer, path, n) for n, ids in enumerate((range(5), range(3, 8), range(8)))]
    assert [(r.candidates, r.hits) for r in rounds] == [(10, 0), (10, 4), (16, 16)]
    assert all(r["score"] == 2 * r["x"] for one in rounds for r in one.rows.collect())


def test_frequent_tokens_dont_move_to_their_ids(spark):
    texts = [(1, "a b a  a c"), (0, "c a\td a"), (2, None), (3, ""), (4, "a a a a e b")]
    rows = spark.createDataFrame(texts, "k long, text string")
    ids, want = {}, {}
    for k, text_ in sorted(texts):
        if text_ is not None:
            want[k] = [ids.setdefault(t, len(ids) + 2) for t in text_.split() or [""]]
    for share in (1, 4, 50_000):
        coded = encoding.encode_dynamic(rows, "k", share=share)
        assert {r["k"]: r["ids"] for r in coded.collect()} == want
    assert "explode(sequence" not in coded._jdf.queryExecution().optimizedPlan().toString()  # no copies of ids


def test_kept_scores_as_lists(spark, tmp_path):
    vectors = {n: [float(n % 5), float(n % 3 - 1), 0.0001234567 * n] for n in range(60)} | {7: None, 11: [1.0], 13: [1.0, None, 2.0]}
    of = lambda ids, key: spark.createDataFrame([(n, vectors[n], n % 4) for n in ids], f"{key} long, vector array<double>, label int")
    second = F.round(2.0 * F.col("dot") + F.col("label"), 6)
    kept, topped = set(), set()
    for number, asked, met in ((1, range(0, 20), range(0, 60, 2)), (2, range(5, 30), range(0, 60, 3)), (3, range(30), range(0, 60, 6))):
        rows, counts = caching.two_stages_of_blocks(of(asked, "query_id").drop("label"), of(met, "id"), second, 4, 3, 6, str(tmp_path), number)
        got = {(r["query_id"], r["id"]): r["final"] for r in rows.collect()}
        dots = {}
        for q in asked:
            for i in met:
                x, y = vectors[q], vectors[i]
                whole = x and y and len(x) == len(y) and None not in x + y
                dots[q, i] = sum(a * b for a, b in zip(x, y, strict=True)) if whole else None
        top = {(q, i) for q in asked for i in sorted(met, key=lambda i: (dots[q, i] is None, -round(dots[q, i] or 0, 6), i))[:4]}
        assert got.keys() == dots.keys()
        for (q, i), x in dots.items():
            want = None if x is None else 2.0 * x + i % 4 if (q, i) in top else x
            assert got[q, i] is None if want is None else abs(got[q, i] - want) < 1e-6
        assert sorted(tuple(r)[1:4] for r in counts.collect()) == [("first", len(dots), len(kept & dots.keys())), ("second", len(top), len(topped & top))]
        kept |= dots.keys()
        topped |= top


def test_attention_of_one_chunk_is_the_chunk(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 0.0]), ("b", [0.0, 1.0])], "g string, vector array<double>")
    got = {r["g"]: r["vector"] for r in scoring.attend_chunks(rows, ["g"], F.array(F.lit(0.0), F.lit(0.0)), 2).collect()}
    assert got == {"a": [1.0, 2.0], "b": [0.5, 0.5]}


def test_readers_of_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"scores":[{"id":1,"score":0.5},{"id":2,"score":1}]}\n\n{"scores":[{"id":1,"score":0.25}]}\n')
    assert sorted(map(tuple, messages.read_score_maps(spark, str(tmp_path / "s.jsonl")).collect())) == [(1, 0.25), (2, 1.0)]
    (tmp_path / "p.jsonl").write_text('{"score":1.0}\n\n{bad\n{"score":2.0,"label":1.0}\n')
    assert sorted(map(tuple, messages.read_jsonl(spark, str(tmp_path / "p.jsonl"), "score double, label double").collect()), key=str) == [(1.0, None), (2.0, 1.0)]
    for name, whole in (("a.json", '[{"problem_name":"x","file_path":"x.p"},{"file_path":"y.p"}]'), ("b.json", '{"problems":[{"problem_name":"x","file_path":"x.p"},{"file_path":"y.p"}]}')):
        (tmp_path / name).write_text(whole)
        assert [(r["pos"], r["problem_name"], r["file_path"]) for r in messages.read_problems(spark, str(tmp_path / name)).orderBy("pos").collect()] == [(0, "x", "x.p"), (1, None, "y.p")]
        assert messages.read_problems(spark, str(tmp_path / name), 1).count() == 1
    (tmp_path / "c.json").write_text('{"other":1}')
    with pytest.raises(Exception, match="neither a list"):
        messages.read_problems(spark, str(tmp_path / "c.json")).collect()
    for name in ("run.log", "b.log", "Z.log"):
        (tmp_path / name).write_text(f"% SZS status {name}\n")
    read = messages.read_solver_logs(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["pos"], r["path"].rsplit("/")[-1], r["text"]) for r in read] == [(k, n, f"% SZS status {n}\n") for k, n in enumerate(("Z.log", "b.log", "run.log"))]


def test_reports_as_json(spark):
    rows = spark.createDataFrame([("b", 1), ("a", None)], "path string, n int")
    told = json.loads(sinks.report_json(rows, spark.createDataFrame([(2,)], "count int")).first()["report"])
    assert [r["path"] for r in told["rows"]] == ["a", "b"] and told["aggregate"] == {"count": 2}
    metric = sinks.metrics_json(spark.createDataFrame([(1, None)], "k int, auc double")).first()["json"]
    assert json.loads(metric) == {"k": 1, "auc": None} and "\n" in metric


def test_outcomes_of_simulated_and_strict_runs(spark):
    runs = spark.createDataFrame([("a", True, 1), ("b", False, 0), ("c", False, 1)], "source string, timed_out boolean, exit_code int")
    raw = [("a", '{"tag":"proof_out"}'), ("b", '{"tag":"szs_result_out","szs_status":"SZS status Theorem"}'), ("c", '{"tag":"szs_result_out","szs_status":"SZS\\\\sstatus\\\\sTheorem\\\\b"}')]
    lines = spark.createDataFrame([(s, 1, x) for s, x in raw], "source string, msg_pos int, raw string")
    outputs = spark.createDataFrame([("a", "")], "source string, text string")

    def reasons(**options):
        got = dataset.run_outcomes(runs, messages.parse_messages(lines), lines, outputs, **options)
        return {r["source"]: r["reason"] for r in got.collect()}

    assert reasons() == {"a": "timeout", "b": None, "c": "iprover_error"}
    assert reasons(strict=True) == {"a": "timeout", "b": "no_proof", "c": None}
    assert reasons(simulated=True) == {"a": None, "b": None, "c": "no_proof"}


def test_truncated_pairs_equal_the_plain_rule(spark):
    def plain(q, sep, c, most):
        def outer(x):
            k = max(1, len(x) // 4)
            return x[:k] + x[-k:] if len(x) > 2 * k else x

        whole, room = q + sep + c, most - len(sep)
        if len(whole) <= most:
            return "full_fit", whole
        if room <= 2:
            return "extreme_truncated", whole[:most]
        total = len(q) + len(c)
        if total > 3 * most:
            oq, oc = outer(q), outer(c)
            if len(oq) + len(oc) > room:
                part = int(room * (len(oq) / (len(oq) + len(oc))))
                return "truncated", (oq[:part] + sep + oc[: room - part])[:most]
            return "truncated", (oq + sep + oc)[:most]
        n = min(max(1, int(room * (len(q) / total))), len(q), room - 1)
        return "truncated", (q[:n] + sep + c[: room - n])[:most]

    r = random.Random(3)
    cases = [(list(range(r.randint(0, 40))), [-1] * r.randint(0, 3), list(range(100, 100 + r.choice([0, 1, 2, 9, 80, 300]))), r.randint(1, 60)) for _ in range(800)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "i int, q array<int>, s array<int>, c array<int>, most int")
    kind, ids = encoding.truncated_pair(F.concat("q", "s", "c"), F.col("q"), F.col("s"), F.col("c"), F.col("most"))
    got = {x["i"]: (x["kind"], x["ids"]) for x in rows.select("i", kind.alias("kind"), ids.alias("ids")).collect()}
    assert got == {k: plain(*c) for k, c in enumerate(cases)}


def test_logprobs_projections_and_merges(spark):
    df = spark.range(1)
    assert df.select(scorers.mean_logprob(F.array(F.lit(-1.0), F.lit(-3.0), F.lit(-5.0)), F.array(F.lit(0), F.lit(1), F.lit(1)))).first()[0] == -4.0
    assert df.select(scorers.mean_logprob(F.array(F.lit(-1.0)), F.array(F.lit(0)))).first()[0] == 0.0
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(*[F.lit(float(k)) for k in range(4)])
    want = sum(x * sum(k * math.sin(3 + 12.9898 * (k + 1) + 78.233 * (j + 1)) for k in range(4)) / 2 for j, x in enumerate((1.0, 2.0)))
    for left, right in ((a, b), (b, a)):
        assert abs(df.select(scores.dot_of_any(left, right, 3)).first()[0] - want) < 1e-9
    merged = requests.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))
    assert df.select(merged).first()[0] == {"a": "1", "b": "3"}


def test_readable_documents(spark):
    own = spark.createDataFrame([("x", 1, 0, "~p(a)|q(X,a)"), ("x", 2, 1000, "q(X,b)")], "batch string, key long, ord long, formula string")
    clauses, numbers, conflicts = symbols.canonical_batch(own, own)
    clauses = clauses.withColumn("role", F.when(F.col("ord") == 0, "conjecture").otherwise("context"))
    targets = symbols.conjecture_targets(clauses.where("ord = 0").select("batch", "canonical"))
    tags = symbols.tree_tags(clauses.where("ord > 0").select("batch", "key", "canonical"), targets)
    text = symbols.readable(symbols.batch_documents(clauses, numbers, conflicts, targets, tags)).first()["text"]
    assert text.split("\n\n")[1:] == ["Conjecture:\n  ID 1: ~P1(C1)|P2(V0,C1)", "Context clauses:\n  ID 2: P2(V0,C2)", "Candidate clauses:"]
    assert "  P2/2 (kind=predicate, arity=2): q/2" in text


def test_dot_pairs_of_odd_vectors_on_all_cores(spark):
    vectors = [[1.0, 2.0], None, [3.0], [0.5, None], [float("nan"), 1.0], [], [1e300, 1e300], [0.1, 0.2]]
    rows = spark.createDataFrame(list(enumerate(vectors)) + [(k, [float(k), 0.5]) for k in range(8, 2000)], "id long, v array<double>")
    queries = rows.where("id < 8").select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    met = scoring.dot_pairs(queries, rows, "q", "v", 1)
    assert met.rdd.getNumPartitions() >= 7  # all queries are of one block
    got = {(r.q_id, r.id): (r.score, r.rounded) for r in met.collect()}
    assert len(got) == 8 * 2000
    assert got[0, 0] == (5.0, 5.0) and got[7, 9] == (0.1 * 9.0 + 0.2 * 0.5, 1.0) and got[5, 5] == (0.0, 0.0) and got[6, 0] == (3e300, 3e300)
    assert all(got[0, k] == (None, None) for k in (1, 2, 3, 5)) and all(v == (None, None) for (q, _), v in got.items() if q in (1, 3))
    assert got[0, 4][0] != got[0, 4][0] and got[2, 2] == (9.0, 9.0) and got[2, 0] == (None, None)


def test_ranking_metrics_rank_only_the_best(spark):
    rows = [("g", (k * 37) % 101 / 50, float(k % 4 == 0) * (1 + k % 3), k) for k in range(300)] + [("h", 0.5, 0.0, 7), ("i", 1.0, 1.0, 2), ("i", 1.0, 0.0, 1)]
    preds = spark.createDataFrame(rows, "group_id string, score double, label double, pos long")
    plan = evaluation.ranking_metrics(preds, [1, 10])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    got = {r.k: r for r in evaluation.ranking_metrics(preds, [1, 10]).collect()}
    want = {1: [0.0] * 4, 10: [0.0] * 4}
    for g in "ghi":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[3]))
        best = sorted((r[2] for r in own), reverse=True)
        dcg = lambda ls: sum((2**x - 1) / math.log2(i + 2) for i, x in enumerate(ls))
        for k, sums in want.items():
            head = [r[2] for r in own[:k]]
            hits, n = sum(x > 0 for x in head), sum(x > 0 for x in best)
            values = [float(hits > 0), hits / n if n else 0.0, dcg(head) / dcg(best[:k]) if n else 0.0, next((1 / (i + 1) for i, x in enumerate(head) if x > 0), 0.0)]
            want[k] = [a + b / 3 for a, b in zip(sums, values, strict=True)]
    for k, values in want.items():
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k][1:], values, strict=True))


def test_rank_diagnostics_without_a_window(spark):
    rows = [("g", 2.0, 0.0, 5), ("g", 2.0, 1.0, 3), ("g", 1.0, 1.0, 1), ("h", 1.0, 0.0, 1), ("h", 0.0, 1.0, 2)]
    told = evaluation.rank_diagnostics(spark.createDataFrame(rows, "group_id string, score double, label double, pos long"), [1])
    assert "Window" not in told._jdf.queryExecution().toString()
    assert list(told.first()) == [2, 5, 3, 1.0, 1.0, 2.5, 1.5]


def of_all(spark, name, vectors, ids):
    return spark.createDataFrame([(i, vectors[i % len(vectors)], None if i % 6 == 5 else i % 3) for i in ids], f"{name} long, vector array<double>, label int")


ODD_VECTORS = [[1.0, 2.0], None, [3.0], [0.5, None], [float("nan"), 1.0], [0.0, -0.0], [1e300, 1e300], [0.1, 0.2], [-0.3, 0.25], [float("inf"), 1.0]]


def plain_order(q, rows, vectors, digits=6):
    """(score, id) of all rows for a vector, best first, as SQL sorts: NaN, numbers, nulls; then by id."""
    told = []
    for i in rows:
        x, y = q, vectors[i % len(vectors)]
        whole = x is not None and y is not None and len(x) == len(y) and None not in x + y
        dot = sum(a * b for a, b in zip(x, y, strict=True)) if whole else None
        score = dot if dot is None or not math.isfinite(dot) else round(dot, digits) + 0.0
        told.append((2 if dot is None else 0 if dot != dot else 1, -score if dot is not None and dot == dot else 0.0, i, dot))
    return [(dot, i) for _, _, i, dot in sorted(told, key=lambda t: t[:3])]


def test_ranks_of_all_pairs_without_a_shuffle_of_pairs(spark):
    ids = [*range(40), 7, 7]  # ids that repeat, in rows and queries
    queries = of_all(spark, "q_id", ODD_VECTORS, [*range(12), 3]).withColumnRenamed("vector", "q").drop("label")
    rows = of_all(spark, "id", ODD_VECTORS, ids)
    for sizes in ({}, {"held": 100}, {"block": 1}):
        met = scoring.dot_ranks(queries, rows, "q_id", "id", "q", "vector", 6, 5, **sizes)
        got = {}
        for r in met.collect():
            got.setdefault(r.q_id, []).append(r)
        assert len(got) == 12
        for q, own in got.items():
            want = plain_order(ODD_VECTORS[q % 10], ids * (2 if q == 3 else 1), ODD_VECTORS)
            own.sort(key=lambda r: r.rank)
            assert [r.rank for r in own] == list(range(1, len(want) + 1)) and [r.id for r in own] == [i for _, i in want]
            for r, (dot, i) in zip(own, want, strict=True):
                assert r.label == (None if i % 6 == 5 else i % 3) and (r.score is None) == (dot is None)
                assert (r.exact is None) == (dot is None or r.rank > 5) and (r.exact is None or dot != dot or r.exact == dot)
                assert dot is None or dot != dot or abs(dot) > 1e300 or r.score == round(dot, 6)
    for empty in (queries.limit(0), rows.limit(0)):
        sides = (empty, rows) if "q" in empty.columns else (queries, empty)
        assert scoring.dot_ranks(*sides, "q_id", "id", "q", "vector", 6, 5).count() == 0


def test_two_stage_rerank_shuffles_rows_and_no_pairs(spark):
    plan = registry.QUERIES["two_stage_rerank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("MapInArrow meet") < plan.index("Repartition")  # the pairs' rows are made last


def plain_rounds(queries, rounds, k):
    """{(round, q): [(id, dot, best)]} of ids that repeat, and STAGE's counts; hits are of pairs that earlier rounds had."""
    told, counts, kept, topped = {}, [], set(), set()
    for number, ids in rounds.items():
        pairs, tops, n = set(), set(), [0] * 4
        for q in sorted(set(queries)):
            own = [(i, dot, at < k) for at, (dot, i) in enumerate(plain_order(ODD_VECTORS[q % 10], ids * queries.count(q), ODD_VECTORS))]
            told[number, q] = own
            for i, _, best in own:
                n = [n[0] + 1, n[1] + ((q, i) in kept), n[2] + best, n[3] + (best and (q, i) in topped)]
            pairs |= {(q, i) for i, _, _ in own}
            tops |= {(q, i) for i, _, best in own if best}
        counts += [(number, "first", n[0], n[1], n[0]), (number, "second", n[2], n[3], n[2])] if n[0] else []
        kept |= pairs
        topped |= tops
    return told, sorted(counts)


def test_rounds_of_blocks_without_kept_files(spark):
    ids, queries = [*range(1, 60), 8, 8, 9], [*range(10), 3]
    asked = of_all(spark, "query_id", ODD_VECTORS, queries).drop("label")
    rows = of_all(spark, "id", ODD_VECTORS, ids)
    conditions = {1: (lambda i: i % 3 != 0, "id % 3 <> 0"), 2: (lambda i: i % 2 == 0, "id % 2 = 0"), 3: (lambda i: i > 99, "id > 99"), 4: (lambda i: i % 6 == 2, "id % 6 = 2")}
    want, _ = plain_rounds(queries, {n: [i for i in ids if f(i)] for n, (f, _) in conditions.items()}, 4)
    got = {}
    met = caching.rounds_of_blocks(asked, rows, {n: sql for n, (_, sql) in conditions.items()}, F.round(2.0 * F.col("dot") + F.col("label"), 6), 4, 6)
    assert "Window" not in met._jdf.queryExecution().optimizedPlan().toString()
    for r in met.collect():
        got.setdefault((r["round"], r.query_id), []).append((r.id, r.final))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items() if v}
    text_of = lambda rows: sorted((i, "null" if x is None else f"{x:.5g}") for i, x in rows)
    for key, own in got.items():
        second = lambda i, dot: None if dot is None or i % 6 == 5 else 2.0 * dot + i % 3
        assert text_of(own) == text_of([(i, second(i, dot) if best else dot) for i, dot, best in want[key]])


def test_cached_rerank_keeps_no_pairs_in_files(spark, monkeypatch):
    for writes in ("write_once", "read_once"):
        monkeypatch.setattr(caching, writes, lambda *_: pytest.fail("scores of all pairs are kept in files"))
    rows = registry.QUERIES["cached_rerank"](spark, "/root/testdata/sf0.001")
    assert rows.count() == 5830
    assert "Join LeftOuter" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_stages_of_blocks_without_kept_files(spark):
    ids, queries = [*range(1, 60), 8, 8, 9], [*range(10), 3]
    asked = of_all(spark, "query_id", ODD_VECTORS, queries).drop("label")
    rows = of_all(spark, "id", ODD_VECTORS, ids)
    conditions = {5: (lambda i: i % 3 != 0, "id % 3 <> 0"), 2: (lambda i: i % 2 == 0, "id % 2 = 0"), 3: (lambda i: i > 99, "id > 99"), 4: (lambda i: i % 6 == 2, "id % 6 = 2")}
    _, want = plain_rounds(queries, {n: [i for i in ids if f(i)] for n, (f, _) in conditions.items()}, 4)
    told = caching.stages_of_blocks(asked, rows, {n: sql for n, (_, sql) in conditions.items()}, 4, 6)
    assert sorted(map(tuple, told.collect())) == want
    assert caching.stages_of_blocks(asked, rows.limit(0), {1: "id > 0"}, 4, 6).count() == 0


def test_stage_counts_keep_no_pairs_in_files(spark, monkeypatch):
    for writes in ("write_once", "read_once"):
        monkeypatch.setattr(caching, writes, lambda *_: pytest.fail("scores of all pairs are kept in files"))
    told = registry.QUERIES["stage_counts"](spark, "/root/testdata/sf0.001")
    assert {(r["round"], r["stage"]): r["candidates"] for r in told.collect()} == {(1, "first"): 3330, (1, "second"): 320, (2, "first"): 2500, (2, "second"): 320}


def test_gains_of_all_pairs_equal_those_of_rows(spark):
    ids = [*range(40), 7, None]
    rows = spark.createDataFrame([(i, ODD_VECTORS[(i or 0) % 10], None if (i or 0) % 6 == 5 else (i or 0) % 3, 1 + i % 4 if i else None) for i in ids], "id long, vector array<double>, label int, gain long")
    queries = rows.where("id < 12").select(F.col("id").alias("query_id"), "vector", "label")
    pairs = scoring.dot_pairs(queries.withColumnsRenamed({"vector": "q", "label": "q_label"}), rows, "q", "vector", 6)
    label = F.when(F.col("label") == F.col("q_label"), F.col("gain")).otherwise(0)
    preds = evaluation.resolve_predictions(pairs.select(F.col("query_id").alias("group_id"), F.col("rounded").alias("score"), label.alias("label"), F.col("id").alias("pos")).where("pos is not null"))
    told = scoring.dot_gains(queries, rows.where("id is not null"), 9, 6, block=3)
    assert sorted(told.where("n > 0").select(F.col("group_id").cast("string"), "label", "n").collect()) == sorted(preds.groupBy("group_id", "label").count().collect())
    got = evaluation.metrics_of(told.where("r > 0"), told.where("n > 0"), [1, 3, 9]).collect()
    want = evaluation.ranking_metrics(preds, [1, 3, 9]).collect()
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))
    gainless = scoring.dot_gains(queries, rows.where("id is null or id = 0"), 9, 6).where("n > 0").collect()
    assert {r.group_id: (r.label, r.n) for r in gainless if r.group_id in (7, 9)} == {7: (0.0, 4)}  # two queries 7; 9 has their label, but they no gain


def test_ranking_metrics_of_searches_make_no_row_of_a_pair(spark):
    plan = registry.QUERIES["ranking_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "WindowGroupLimit" not in plan  # what it reads are a few rows for each query
