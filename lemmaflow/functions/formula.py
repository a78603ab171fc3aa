"""Formulas as trees and tokens: scanners of one text, and the tables and columns that Spark makes with them."""

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of tokens in raw and in canonical formulas.
RAW_NAME, CANONICAL_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_:$]*"), re.compile(r"[A-Za-z][A-Za-z0-9_]*")
QUANTIFIERS = {"![": "forall", "?[": "exists"}
NODES = {"node": pa.int32(), "parent": pa.int32(), "pos": pa.int32(), "kind": pa.string(), "symbol": pa.string(), "arity": pa.int32(), "in_term": pa.bool_(), "negated": pa.bool_(), "vars": pa.list_(pa.string())}
TOKENS = {"tok": pa.int32(), "gap": pa.string(), "name": pa.string(), "variable": pa.bool_(), "constant": pa.bool_(), "arity": pa.int32(), "equated": pa.bool_()}
#: What ``canonical_nodes`` tells of a node.
TOLD = {"node": T.IntegerType(), "parent": T.IntegerType(), "pos": T.IntegerType(), "kind": T.StringType(), "symbol": T.StringType(), "arity": T.IntegerType(), "negated": T.BooleanType()}
#: What ``formula_uses`` tells of a symbol, and ``formula_symbols``; a form is a place in FORMS.
FORMS = ["constant", "called", "equated"]
USES = {"name": T.StringType(), "arity": T.IntegerType(), **{f: T.IntegerType() for f in FORMS}, "in_term": T.BooleanType(), "outside": T.BooleanType()}
OWN = {"name": T.StringType(), "arity": T.IntegerType(), "form": T.IntegerType()}
_pieces = re.compile(r"\w[\w$:]*|[(),]")
_equated = re.compile(r"\s*!?=").match
_called = re.compile(r"\s*\(").match
_wrapper = re.compile(r"\s*tcf\s*\(").match
_marks = re.compile(r"[(),]").finditer


class _Text:
    """A text with the depth of parentheses after each character; spans are relative to the depth before them."""

    def __init__(self, text: str):
        self.text = text
        self.depth = list(accumulate((c == "(") - (c == ")") for c in text))

    def base(self, a: int) -> int:
        return self.depth[a - 1] if a else 0

    def trimmed(self, a: int, b: int) -> tuple[int, int]:
        own = self.text[a:b]
        return a + len(own) - len(own.lstrip()), max(a + len(own) - len(own.lstrip()), a + len(own.rstrip()))

    def bare(self, a: int, b: int) -> tuple[int, int]:
        """Without spaces and enclosing parentheses; ones that never close count as enclosing, too."""
        a, b = self.trimmed(a, b)
        while b - a > 1 and self.text[a] == "(" and self.text[b - 1] == ")" and min(self.depth[a : b - 1]) > self.base(a):
            a, b = self.trimmed(a + 1, b - 1)
        return a, b

    def places(self, mark: str, a: int, b: int, level: int) -> Iterator[int]:
        """Where a mark stands at a depth."""
        at = self.text.find(mark, a, b)
        while at >= 0:
            if self.depth[at] == level:
                yield at
            at = self.text.find(mark, at + 1, b)


def parse(text: str, name: re.Pattern = RAW_NAME) -> list[tuple]:
    """Nodes in pre-order, as NODES: quantifier, op (or, and, neq, =, not), atom or leaf; in_term says where terms stand.

    Quantifiers bind weakest, then |, &, !=, =, ~; a quantifier takes all that follows.
    """
    t, out = _Text(text), []
    todo: list[tuple] = [(0, len(text), None, 0, False, False)]
    while todo:
        a, b, parent, pos, in_term, negated = todo.pop()
        a, b = t.trimmed(a, b)
        quantifier = QUANTIFIERS.get(text[a : min(b, a + 2)])
        end = text.find("]:", a, b) if quantifier else -1
        names, below = [], False
        if end >= 0:
            kind, symbol, spans = "quantifier", quantifier, [(end + 2, b)]
            names = [v.strip() for v in text[a + 2 : end].split(",") if v.strip()]
        else:
            a, b = t.bare(a, b)
            kind, symbol, spans, below = _split(t, a, b, name)
        node = len(out)
        out.append((node, parent, pos, kind, symbol, len(spans), in_term, negated, names))
        under = negated or symbol == "not" and kind == "op"
        todo += [(x, y, node, k, below, under) for k, (x, y) in reversed(list(enumerate(spans)))]
    return out


def _split(t: _Text, a: int, b: int, name: re.Pattern) -> tuple[str, str, list[tuple[int, int]], bool]:
    """kind, symbol, the spans below, and whether these are terms."""
    level = t.base(a)
    for mark, symbol in (("|", "or"), ("&", "and")):
        if cuts := list(t.places(mark, a, b, level)):
            return "op", symbol, list(zip([a, *[c + 1 for c in cuts]], [*cuts, b], strict=True)), False
    for mark, symbol in (("!=", "neq"), ("=", "=")):
        if (at := next(t.places(mark, a, b, level), -1)) >= 0:
            return "op", symbol, [(a, at), (at + len(mark), b)], True
    if t.text.startswith("~", a, b):
        return "op", "not", [(a + 1, b)], False
    if not (m := name.match(t.text, a, b)):
        return "leaf", t.text[a:b], [], False
    symbol, call = m[0].split(":")[0], _called(t.text, m.end(), b)
    if not call:
        return "leaf", symbol, [], False
    inner = t.depth[call.end() - 1]
    close = next((i for i in t.places(")", call.end(), b, inner - 1)), -1)
    cuts = list(t.places(",", call.end(), close if close >= 0 else b, inner))
    ends = [*cuts, close] if close >= 0 else cuts
    return "atom", symbol, list(zip([call.end(), *[c + 1 for c in cuts]], ends, strict=False)), True


def scan(text: str) -> list[tuple]:
    """Tokens in order, as TOKENS, each with the text before it; the last row has no name and the rest of the text.

    Names that begin in upper case are variables; symbols that no parenthesis follows are constants; arity counts the
    commas of a call; equated says that = or != follows it.
    """
    rows: list[list] = []
    open_calls: list[list | None] = []
    done, calls = 0, None
    for m in _pieces.finditer(text):
        piece = m[0]
        if piece == "(":
            owner = calls if calls is not None and not text[done : m.start()].strip() else None
            open_calls.append(owner)
            if owner:
                owner[5] = 1
            calls = None
        elif piece == ")":
            owner = open_calls.pop() if open_calls else None
            if owner:
                owner[6] = _equated(text, m.end()) is not None
        elif piece == ",":
            if open_calls and open_calls[-1]:
                open_calls[-1][5] += 1
        else:
            name = piece.split(":")[0]
            variable = name[:1].isupper()
            constant = not variable and not _called(text, m.end())
            row = [len(rows), text[done : m.start()], name, variable, constant, 0, False]
            rows.append(row)
            calls, done = (None if variable or constant else row), m.end()
    return [*map(tuple, rows), (len(rows), text[done:], None, False, False, 0, False)]


def _form(constant: bool, equated: bool) -> int:
    return 0 if constant else 1 + equated


def uses(text: str) -> list[tuple]:
    """Symbols by name and arity, as USES: the first token of each form, and whether calls stand in terms or outside.

    Leaves of the tree tell nothing, as a name that isn't called is a constant.
    """
    found: dict[tuple, list] = {}
    for tok, _, name, variable, constant, arity, equated in scan(text):
        if name is not None and not variable:
            own, form = found.setdefault((name, arity), [None, None, None, False, False]), _form(constant, equated)
            own[form] = tok if own[form] is None else own[form]
    for _, _, _, kind, symbol, arity, in_term, _, _ in parse(text):
        if kind == "atom" and arity:
            found.setdefault((symbol, arity), [None, None, None, False, False])[3 if in_term else 4] = True
    return [(*k, *v) for k, v in found.items()]


def own_symbols(tokens: list[tuple]) -> list[tuple]:
    """Distinct symbols of a formula in order, as OWN."""
    return list(dict.fromkeys((name, arity, _form(constant, equated)) for _, _, name, variable, constant, arity, equated in tokens if name is not None and not variable))


def rewritten(tokens: list[tuple], canons: list[str | None]) -> tuple[str, list[str]]:
    """The formula with ``canons`` for its symbols (in order of ``own_symbols``) and V<n> for its variables, and these in order."""
    names: dict[str, str] = {}
    canon = dict(zip(own_symbols(tokens), canons, strict=True))
    parts = []
    for _, gap, name, variable, constant, arity, equated in tokens:
        parts.append(gap)
        if variable:
            parts.append(names.setdefault(name, f"V{len(names)}"))
        elif name is not None:
            parts.append(canon[name, arity, _form(constant, equated)] or "")
    return "".join(parts), list(names)


def token_table(rows: DataFrame, formula: str, columns: dict, of) -> DataFrame:
    """``rows`` without ``formula``, once for each tuple of a formula. A null formula is an empty one.

    A formula that repeats in an Arrow batch is read once, and its tuples are copied.
    """
    kept = [c for c in rows.columns if c != formula]
    kinds = {"int32": "int", "string": "string", "bool": "boolean", "list<item: string>": "array<string>"}
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{n} {kinds[str(t)]}" for n, t in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch[formula], "").dictionary_encode()
            made = [of(f) for f in texts.dictionary.to_pylist()]
            flat = list(zip(*[row for x in made for row in x], strict=True)) or [[] for _ in columns]
            sizes = np.array([len(x) for x in made], np.int64)
            each = texts.indices.to_numpy()
            n = sizes[each]
            at = np.repeat(np.arange(len(each)), n)
            place = np.arange(len(at)) + np.repeat((np.cumsum(sizes) - sizes)[each] - (np.cumsum(n) - n), n)
            arrays = [batch[c].take(pa.array(at)) for c in kept] + [pa.array(v, t).take(pa.array(place)) for v, t in zip(flat, columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *columns])

    return rows.select(*kept, formula).mapInArrow(run, schema)


def formula_nodes(rows: DataFrame, formula: str = "formula", canonical: bool = False) -> DataFrame:
    name = CANONICAL_NAME if canonical else RAW_NAME
    return token_table(rows, formula, NODES, lambda f: parse(f, name))


def formula_tokens(rows: DataFrame, formula: str = "formula") -> DataFrame:
    return token_table(rows, formula, TOKENS, scan)


def _third(text: str) -> int:
    """Where the third field of a ``tcf(`` wrapper begins, or -1."""
    if not (m := _wrapper(text)):
        return -1
    depth, cuts = 0, 0
    for p in _marks(text, m.end()):
        if p[0] == "(":
            depth += 1
        elif p[0] == ")":
            depth -= 1
        elif depth == 0:
            cuts += 1
            if cuts == 2:
                return p.end()
    return -1


def _field(text: str) -> str:
    """Without enclosing parentheses and one final stop."""
    t = _Text(text)
    a, b = t.bare(0, len(text))
    return text[a:b].removesuffix(".").rstrip() if text[a:b].endswith(".") else text[a:b]


def unwrap(text: str) -> str:
    """What the third field of a ``tcf(`` wrapper holds, without enclosing parentheses and one final stop."""
    at = _third(text)
    return text if at < 0 else _field(text[at:])


def count_literals(text: str) -> int:
    """One more than the bars outside all parentheses."""
    t = _Text(text)
    return 1 + sum(1 for _ in t.places("|", 0, len(text), 0))


@F.arrow_udf(T.StringType())
def _unwrapped(texts: pa.Array) -> pa.Array:
    made: dict[str, str] = {}  # wrappers differ, as they name their clause; fields that repeat are read once
    out = []
    for text in texts.to_pylist():
        at = -1 if text is None else _third(text)
        if at < 0:
            out.append(text)
            continue
        field = text[at:]
        if field not in made:
            made[field] = _field(field)
        out.append(made[field])
    return pa.array(out, pa.string())


def _rows(columns: dict) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in columns.items()]))


def _lists(texts: pa.Array, columns: dict, told: dict, of) -> pa.Array:
    """The tuples (of ``columns``) of each formula as one list of what ``told`` names. Formulas that repeat are read once."""
    each = pc.fill_null(texts, "").dictionary_encode()
    made = [of(x) for x in each.dictionary.to_pylist()]
    flat = list(zip(*[row for x in made for row in x], strict=True)) or [[] for _ in columns]
    types = {T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}
    own = {n: pa.array(v, types[told[n]]) for n, v in zip(columns, flat, strict=True) if n in told}
    ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(own.values()), names=list(own))).take(each.indices)


@F.arrow_udf(_rows(TOLD))
def _canonical_nodes(texts: pa.Array) -> pa.Array:
    return _lists(texts, NODES, TOLD, lambda x: parse(x, CANONICAL_NAME))


@F.arrow_udf(_rows(USES))
def _uses(texts: pa.Array) -> pa.Array:
    return _lists(texts, USES, USES, uses)


@F.arrow_udf(_rows(OWN))
def _own(texts: pa.Array) -> pa.Array:
    return _lists(texts, OWN, OWN, lambda x: own_symbols(scan(x)))


@F.arrow_udf(T.StructType([T.StructField("canonical", T.StringType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("lit_count", T.IntegerType())]))
def _rewritten(texts: pa.Array, canons: pa.Array) -> pa.Array:
    tokens: dict[str, list] = {}
    made: dict[tuple, tuple] = {}  # formulas that repeat with their symbols are read once
    out = []
    for text, own in zip(texts.to_pylist(), canons.to_pylist(), strict=True):
        key = (text, *own)
        if key not in made:
            if text not in tokens:
                tokens[text] = scan(text)
            canonical, names = rewritten(tokens[text], own)
            made[key] = (canonical, names, count_literals(canonical))
        out.append(made[key])
    canonical, names, counts = zip(*out, strict=True) if out else ([], [], [])
    return pa.StructArray.from_arrays([pa.array(canonical, pa.string()), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.int32())], names=["canonical", "names", "lit_count"])


@F.arrow_udf(T.IntegerType())
def _literals(texts: pa.Array) -> pa.Array:
    each = texts.dictionary_encode()  # texts that repeat are read once
    return pa.array([count_literals(x) for x in each.dictionary.to_pylist()], pa.int32()).take(each.indices)


def wrapped_formula(text: Column) -> Column:
    return _unwrapped(text)


def canonical_nodes(formula: Column) -> Column:
    """The nodes of a canonical formula as one array, for what is told of each formula by itself."""
    return _canonical_nodes(formula)


def formula_uses(formula: Column) -> Column:
    """The symbols of a formula and how it uses them, as one array of USES."""
    return _uses(formula)


def formula_symbols(formula: Column) -> Column:
    """The distinct symbols of a formula in order, as one array of OWN."""
    return _own(formula)


def canonical_form(formula: Column, canons: Column) -> Column:
    """canonical, names (variables in order) and lit_count of a formula; ``canons``: in order of ``formula_symbols``."""
    return _rewritten(formula, canons)


def literal_count(formula: Column) -> Column:
    return _literals(formula)
