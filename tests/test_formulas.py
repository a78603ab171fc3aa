"""Formula trees, tokens and reading of raw logs on cases that trip up simple scanners."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lemmaflow.functions import formula as trees
from lemmaflow.operators import dataset, encoding, requests, scorers, scoring, symbols
from lemmaflow.sources import messages as logs


def tree(text, **how):
    """A tree as nested text."""
    nodes = trees.parse(text, **how)

    def written(k):
        kids = [written(n[0]) for n in nodes if n[1] == k]
        return nodes[k][4] + (f"({','.join(kids)})" if kids else "")

    return written(0)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("p(X)|q(Y)&~r", "or(p(X),and(q(Y),not(r)))"),
        ("~a=b", "=(not(a),b)"),
        ("a=>b", "=(a,>b)"),
        ("f(X)!=g(Y)", "neq(f(X),g(Y))"),
        ("((a)", "(a"),
        ("(p(X))|(q)", "or(p(X),q)"),
        ("![X0:$i]: p(X0)|q", "forall(or(p(X0),q))"),
        ("?[Y]: (p(Y)=c)", "exists(=(p(Y),c))"),
        ("f()", "f()"),
        ("f(a,b", "f(a)"),
        ("p(f(X,(a|b)),c)", "p(f(X,or(a,b)),c)"),
        ("$true", "$true"),
        ("", ""),
    ],
)
def test_trees(text, want):
    assert tree(text) == want


def test_terms_and_negation():
    nodes = {n[4]: (n[6], n[7]) for n in trees.parse("~p(f(c))|g(d)=e")}
    assert nodes["p"] == (False, True) and nodes["f"] == nodes["c"] == (True, True)
    assert nodes["g"] == nodes["d"] == nodes["e"] == (True, False)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("tcf(c_1,plain,(p(X)|q))", "(p(X)|q))"),
        ("tcf(c_1,plain,(p(X)|q)", "p(X)|q"),
        (" tcf ( f(a,b) ,plain, ((q)).", "((q))"),
        ("tcf(c_1,plain", "tcf(c_1,plain"),
        ("p(X)", "p(X)"),
        ("tcf(c_1,plain,~q. ", "~q"),
    ],
)
def test_unwrapped(text, want):
    assert trees.unwrap(text) == want


def test_tokens_give_the_text_back():
    for text in ("![X0:$i]: (p(X0,f(),g(a,b))!=c)", "", " ~ é1(Ü) = x", "f(a,(b,c),d", "))((", "$a"):
        rows = trees.scan(text)
        assert rows[-1][2] is None and [r[0] for r in rows] == list(range(len(rows)))
        assert "".join(r[1] + (r[2] or "") for r in rows) == text.replace(":$i", "")
    assert [(r[2], r[5]) for r in trees.scan("f()=g(a,(b,c),d)")[:2]] == [("f", 1), ("g", 3)]
    assert trees.count_literals("a|(b|c)|d") == 3


def test_a_symbol_of_both_kinds_gets_a_second_number(spark):
    rows = spark.createDataFrame([(1, "a", 1, "g(c)|h(c)"), (1, "b", 2, "g(c)=d"), (1, "e", 3, None)], "batch long, key string, ord long, formula string")
    clauses, numbers, conflicts = symbols.canonical_batch(rows, rows)
    assert {r["key"]: r["canonical"] for r in clauses.collect()} == {"a": "P1(C1)|P2(C1)", "b": "F1(C1)=C2", "e": ""}
    assert conflicts.collect()[0]["conflicts"] == ["g/1"]
    assert {(r["name"], r["kind"], r["canon"]) for r in numbers.collect()} == {("g", "predicate", "P1"), ("h", "predicate", "P2"), ("g", "function", "F1"), ("c", "constant", "C1"), ("d", "constant", "C2")}


def test_raw_logs_that_are_not_whole_fail(spark):
    lines = [("a", 1, '{"tag":"ack"}'), ("b", 1, '{"tag":"register_clauses","clauses":[]}')]
    read = logs.parse_messages(spark.createDataFrame(lines, "source string, msg_pos long, raw string"))
    for source in ("a", "b"):
        with pytest.raises(Exception, match="first message|no request"):
            requests.raw_log_request(read.where(f"source = '{source}'")).collect()


def test_outputs_of_runs(spark, tmp_path):
    (tmp_path / "a.out").write_bytes(b"% SZS status Theorem\xff\n")
    runs = spark.createDataFrame([(1, "a.out"), (2, "b.out")], "source long, file_name string")
    assert {r["source"]: r["text"] for r in dataset.read_outputs(spark, runs, str(tmp_path)).collect()}[2] == ""


def test_vocabulary_file_and_empty_texts(spark, tmp_path):
    (tmp_path / "v").write_text("<unk>\t0\na\t-1\n\n b c\na\t-2\n")
    words = encoding.read_vocabulary(spark, str(tmp_path / "v"))
    assert {r["token"]: r["id"] for r in words.collect()} == {"<pad>": 0, "<unk>": 1, "a": 2, "b": 3}
    rows = spark.createDataFrame([(1, "a b?"), (2, ""), (3, "?")], "key long, text string")
    assert {r["key"]: r["ids"] for r in encoding.encode_static(rows, words, "key").collect()} == {1: [2, 3], 2: [], 3: [1]}


def test_scorer_modes(spark):
    from pyspark.sql import functions as F

    pairs = spark.createDataFrame([(0, "q", "aa"), (1, "q", "a"), (2, "q", "aaa")], "pos long, query string, text string")
    lengths = scorers.load_scorer("clause", score=F.length)(pairs)
    assert [r["score"] for r in lengths.orderBy("pos").collect()] == [2.0, 1.0, 3.0]
    both = scorers.load_scorer("bi_then_cross", encode=lambda t: F.array(F.length(t)), score=lambda q, t: -F.length(t), k=1)(pairs)
    assert [r["score"] for r in both.orderBy("pos").collect()] == [2.0, 1.0, -3.0]
    with pytest.raises(ValueError, match="no scorer mode"):
        scorers.load_scorer("other")


def test_formulas_that_repeat_are_read_once(spark, tmp_path):
    log = tmp_path / "read"

    def of(text):
        with log.open("a") as f:
            f.write(text + "\n")
        return [(k, c) for k, c in enumerate(text)]

    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "ab"), (4, "c"), (5, "")], "id long, f string").coalesce(1)
    got = trees.token_table(rows, "f", {"n": pa.int32(), "c": pa.string()}, of).collect()
    assert [tuple(r) for r in got] == [(1, 0, "a"), (1, 1, "b"), (3, 0, "a"), (3, 1, "b"), (4, 0, "c")]
    assert sorted(log.read_text().split("\n")) == ["", "", "ab", "c"]


def test_wrapped_fields_that_repeat_are_read_once(monkeypatch):
    read, field = [], trees._field
    monkeypatch.setattr(trees, "_field", lambda text: read.append(text) or field(text))
    texts = [f"tcf(c_{i},plain,((p(X{i % 2})|q)).)" for i in range(100)] + [None, "p(a)", "tcf(f(a,b),(c,d),e)", "tcf(a,b"]
    got = trees._unwrapped.func(pa.array(texts)).to_pylist()
    assert got == [None if x is None else trees.unwrap(x) for x in texts] and len(read) == 3 + 101


def test_canonical_nodes_are_those_of_the_table(spark):
    texts = ["F1(C1,V0)=F1(V1,C2)", "(~P1(V0)|P2(C1))", "", "![V0]: P1(V0)", "C1"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, formula string")
    flat = trees.formula_nodes(rows, canonical=True).select("i", *trees.TOLD)
    inlined = rows.select("i", F.inline(trees.canonical_nodes(F.col("formula"))))
    assert sorted(map(tuple, flat.collect()), key=str) == sorted(map(tuple, inlined.collect()), key=str)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_roles_of_a_batch_are_those_of_its_requests_in_one_shuffle(spark):
    rows = [(1, 10, 1, 3, None), (1, 11, 2, 0, 1), (1, 12, 3, 0, 4), (1, 13, 4, None, None), (1, 14, 5, 1, 2), (2, None, 1, 0, None), (2, 11, 2, 5, 1), (2, 12, 3, 0, None), (2, 13, 4, 1, None), (3, 10, 7, 0, None)]
    clauses = spark.createDataFrame(rows, "problem long, clause_id long, ord long, conj_dist int, pos int").withColumn("asked", F.col("pos").isNotNull())
    got = scoring.with_roles(clauses, 1, 2)
    assert _plan(got).count("Exchange") == 1 and _plan(got).count("Scan ") == 1
    taken = got.where("role is not null").select("problem", "clause_id", "role", "rank")
    want = {(1, 10, "context", 1), (1, 11, "conjecture", 1), (1, 12, "candidate", 2), (1, 14, "candidate", 1), (2, None, "context", 1), (2, 11, "candidate", 1), (2, 12, "conjecture", 1), (3, 10, "conjecture", 1)}
    assert got.count() == len(rows) and set(map(tuple, taken.collect())) == want
    named = clauses.where("clause_id is not null")
    selected = scoring.select_batch(named.drop("pos", "asked"), named.where("asked").select("problem", "clause_id", "pos"), 1, 2)
    again = scoring.with_roles(named, 1, 2).where("role is not null").select("problem", "clause_id", "role", "rank")
    assert sorted(map(tuple, selected.collect())) == sorted(map(tuple, again.collect()))


def test_targets_and_conflicts_are_told_without_reading_clauses_again(spark):
    own = spark.createDataFrame([("x", 1, 0, "f(a,X)=g(b)"), ("x", 2, 1, "p(f(a,b),X)|f(b,a)"), ("y", 1, 0, "~p(a)")], "batch string, key long, ord long, formula string")
    clauses, _, conflicts = symbols.canonical_batch(own, own)
    assert [tuple(r) for r in conflicts.collect()] == [("x", ["f/2"])]
    assert "Python" not in _plan(conflicts) and "InArrow" not in _plan(conflicts)
    canonical = spark.createDataFrame([("x", "F1(C1,V0)=F2(C2)"), ("y", "P1(C1)"), ("z", "F3(V0,C4)!=C5"), ("n", None)], "batch string, canonical string")
    targets = symbols.conjecture_targets(canonical)
    assert {r[0]: tuple(r)[1:] for r in targets.collect()} == {"x": (["F1/2", "F2/1"], ["C1", "C2"], ["C1", "C2"]), "y": ([], [], []), "z": (["F3/2"], [], ["C4"]), "n": ([], [], [])}
    assert "Exchange" not in _plan(targets)


def test_clauses_with_tags_are_those_of_tree_tags(spark):
    rows = [("x", 1, 0, "conjecture", "f(a,X)=f(Y,b)"), ("x", 2, 1, "context", "~p(X)|f(a,b)"), ("x", 3, 2, "candidate", None), ("x", 4, 3, "context", "f(b,a)=f(X,Y)"), ("y", 1, 0, "context", "q")]
    own = spark.createDataFrame(rows, "batch string, key long, ord long, role string, formula string")
    scope = own.where("key <> 4 and ord >= 0").select("batch", "key", "ord", "formula")
    clauses, numbers, conflicts = symbols.canonical_batch(scope, own, ("role",))
    clauses = clauses.cache()
    assert {(r.batch, r.key): (r.role, r.canonical, r.lit_count) for r in clauses.collect()} == {
        ("x", 1): ("conjecture", "F1(C1,V0)=P1(V1,C2)", 1), ("x", 2): ("context", "~P2(V0)|P1(C1,C2)", 2), ("x", 3): ("candidate", "", 1),
        ("x", 4): ("context", "F1(C2,C1)=P1(V0,V1)", 1), ("y", 1): ("context", "C1", 1),
    }
    targets = symbols.conjecture_targets(clauses.where("role = 'conjecture'").select("batch", "canonical"))
    tags = symbols.tree_tags(clauses.where("role <> 'conjecture'").select("batch", "key", "canonical"), targets)
    joined = symbols.batch_documents(clauses, numbers, conflicts, targets, tags)
    told = symbols.batch_documents(symbols.tagged_clauses(clauses, targets), numbers, conflicts, targets)
    as_json = lambda d: sorted(r[0] for r in d.select(F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"})).collect())
    assert as_json(told) == as_json(joined)


def test_uses_of_symbols():
    assert trees.uses("f(a)=f(X)|p(f(a),1)&b") == [("f", 1, None, 2, 0, True, False), ("a", 0, 1, None, None, False, False), ("p", 2, None, 4, None, False, True), ("1", 0, 7, None, None, False, False), ("b", 0, 8, None, None, False, False)]
    assert trees.uses("") == [] and trees.own_symbols(trees.scan("f(a)=f(a)")) == [("f", 1, 2), ("a", 0, 0), ("f", 1, 1)]
    assert trees.rewritten(trees.scan("f(a,X)=f(Y,X)."), ["F1", None, "P1"]) == ("F1(,V0)=P1(V1,V0).", ["X", "Y"])
