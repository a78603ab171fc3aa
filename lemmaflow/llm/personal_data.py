"""Personal data by weak supervision.

Candidates are spans of the base patterns and of wider ones. Three labelers vote on each (yes, no or abstain):
structure (checks of form: digits, check sums, ranges), gazetteer (known endings, country codes, issuers) and
context (the nearest telling word before the span: one that announces the kind, or one that announces another
number, as of an order or a version). Counts of vote patterns by kind over all documents go to expectation-
maximisation, which gives each labeler's reliability on each kind, drawn to its reliability on all kinds where a
kind is rare, and each pattern's probability. These train the final span classifier, a logistic regression on the
kind, the votes, the form of a span and the hashed words before it, on at most ``max_spans`` spans. Base spans
always stay; wider ones are added where the classifier gives at least one half.

Defined cases: a null text is empty; every row gives a row, repeated ids too; spans are in code points, end
exclusive; other columns are ignored; an empty table gives no rows.
"""

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import bounded_batches, materialize

#: Kinds in the order of ties, their patterns and words. Those of mail begin after the LOCAL part, and the
#: address begins where the run of its characters before them does; so long runs are read once.
KINDS = ["email", "ip", "card", "phone", "masked_email", "iban", "local_phone"]
BASE = KINDS[:4]
PATTERNS = {
    "email": re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    "masked_email": re.compile(r" ?[\[(]at[\])] ?[A-Za-z0-9-]+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]+)+"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "local_phone": re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
}
ENDINGS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "co"}
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "90", "91")
COUNTRIES = {"AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"}
CONTEXT = {
    "email": re.compile(r"mail|contact|write|reach|address", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|from|login", re.I),
    "card": re.compile(r"card|visa|credit|pay|account", re.I),
    "phone": re.compile(r"call|phone|tel|mobile|fax|contact|number", re.I),
    "iban": re.compile(r"iban|account|bank|transfer", re.I),
}
#: Words that announce another number.
AGAINST = {
    "ip": re.compile(r"\bv(?=\W*$)|version|release|build|section|chapter|revision", re.I),
    "card": re.compile(r"order|invoice|tracking|serial|isbn|parcel|ticket|part", re.I),
    "phone": re.compile(r"order|invoice|tracking|serial|isbn|parcel|ticket|part|balance", re.I),
    "iban": re.compile(r"serial|part|model|licen[cs]e|key|code", re.I),
    "email": re.compile(r"@(?=\W*$)|\bgit\b|import|decorator", re.I),
}
#: Buckets of the words before a span, and how much text before it counts.
WORDS = 64
BEFORE = 40
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
YES, NO, ABSTAIN = 1, 0, -1
SPAN = "start int, rank int, kind string, end int, structure int, gazetteer int, context int, digits int, length int, words array<int>"


def passes_luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def holds(kind: str, value: str) -> bool:
    """The form that a base kind asks for, and check sums of wider ones."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and passes_luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "iban":
        packed = value.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1
    if kind == "local_phone":
        return digits[0] not in "01" and digits[3] not in "01"
    return True


def _gazetteer(kind: str, value: str) -> int:
    if kind in ("email", "masked_email"):
        return YES if re.split(r"[^A-Za-z0-9]+", value.rstrip("])"))[-1].lower() in ENDINGS else ABSTAIN
    if kind == "phone":
        return YES if re.sub("[^0-9]", "", value).startswith(CALLING) else NO
    if kind == "card":
        return YES if value[0] in "3456" else NO
    if kind == "iban":
        return YES if value[:2] in COUNTRIES else NO
    if kind == "ip":
        return NO if value.startswith(("0.", "127.")) else ABSTAIN
    return ABSTAIN


def _context(kind: str, before: str) -> int:
    of = {"masked_email": "email", "local_phone": "phone"}.get(kind, kind)
    last = lambda words: max((m.end() for m in words.finditer(before)), default=-1)
    told, against = last(CONTEXT[of]), last(AGAINST[of])
    return ABSTAIN if told == against == -1 else YES if told > against else NO


def _words(before: str) -> list[int]:
    """Buckets of the last three words."""
    return sorted({zlib.crc32(w.lower().encode()) % WORDS for w in re.findall(r"[^\W\d_]+", before)[-3:]})


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """start, end of all leftmost matches, none overlapping."""
    if "email" not in kind:
        yield from (m.span() for m in PATTERNS[kind].finditer(text))
        return
    done = seen = 0
    for m in PATTERNS[kind].finditer(text):
        if kind == "email":  # a run doesn't go on beyond another mark
            seen = text.rfind("@", seen, m.start()) + 1 or seen
        run = text[max(done, seen) : m.start()]
        if size := len(run) - len(run.rstrip(LOCAL)):
            yield m.start() - size, m.end()
            done = m.end()
        seen = m.start() + 1


def candidates(text: str | None) -> list[tuple]:
    """Spans in order: base ones that hold, and wider ones that no base span overlaps."""
    if not text:
        return []
    at, digit = "@" in text, re.search("[0-9]", text) is not None
    wanted = {"email": at, "ip": digit, "card": digit, "phone": digit and "+" in text, "masked_email": "at]" in text or "at)" in text, "iban": digit, "local_phone": digit}
    found: list[tuple] = []
    starts: list[int] = []
    ends: list[int] = []
    for rank, kind in enumerate(KINDS):
        if rank == len(BASE):
            base = sorted((s[0], s[3]) for s in found)
            starts, ends = [s for s, _ in base], list(accumulate((e for _, e in base), max))
        if not wanted[kind]:
            continue
        for start, end in _matches(kind, text):
            value = text[start:end]
            if kind == "card" and len(value) < 14:
                continue
            fits = holds(kind, value)
            before = bisect_left(starts, end)
            if kind in BASE and not fits or before and ends[before - 1] > start:
                continue
            near = text[max(0, start - BEFORE) : start]
            votes = YES if fits else NO, _gazetteer(kind, value), _context(kind, near)
            found.append((start, rank, kind, end, *votes, len(re.findall("[0-9]", value)), len(value), _words(near)))
    return sorted(found)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SPAN.split(", ")]
    kinds = {"kind": pa.string(), "words": pa.list_(pa.int32())}
    kind = pa.list_(pa.struct([(n, kinds.get(n, pa.int32())) for n in names]))
    for batch in batches:
        spans = [[dict(zip(names, s, strict=True)) for s in candidates(t)] for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(spans, kind)], names=["id", "spans"])


def reliabilities(kinds: list[str], votes: np.ndarray, n: np.ndarray, rounds: int = 50, weight: float = 20.0) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For each distinct vote pattern of a kind (rows of yes, no, abstain) with its count: P(true); and each labeler's accuracy by kind.

    A kind's accuracies are averaged with those of all kinds, which count as ``weight`` votes.
    """
    own = [np.array([k == x for k in kinds], bool) for x in KINDS]
    of = np.array([KINDS.index(k) for k in kinds], int)
    accuracy, prior, p = np.full((len(KINDS), votes.shape[1]), 0.8), np.full(len(KINDS), 0.5), np.full(len(votes), 0.5)
    for _ in range(rounds):
        sure, wrong = np.log(accuracy[of]), np.log(1 - accuracy[of])
        yes = np.log(prior[of]) + (np.where(votes == YES, sure, 0) + np.where(votes == NO, wrong, 0)).sum(axis=1)
        no = np.log(1 - prior[of]) + (np.where(votes == YES, wrong, 0) + np.where(votes == NO, sure, 0)).sum(axis=1)
        p = 1 / (1 + np.exp(np.clip(no - yes, -30, 30)))
        right = (np.where(votes == YES, p[:, None], 0) + np.where(votes == NO, 1 - p[:, None], 0)) * n[:, None]
        said = (votes != ABSTAIN) * n[:, None]
        overall = (right.sum(axis=0) + 8) / (said.sum(axis=0) + 10)
        share = (p * n).sum() / max(n.sum(), 1)
        for k, rows in enumerate(own):
            accuracy[k] = np.clip((right[rows].sum(axis=0) + weight * overall) / (said[rows].sum(axis=0) + weight), 0.55, 0.99)
            prior[k] = np.clip(((p * n)[rows].sum() + weight * share) / (n[rows].sum() + weight), 0.05, 0.95)
    return p, dict(zip(KINDS, accuracy, strict=True))


def _design(kind: list[str], votes: np.ndarray, digits: np.ndarray, length: np.ndarray, words: list) -> np.ndarray:
    onehot = np.array([[k == x for x in KINDS] for k in kind], float).reshape(-1, len(KINDS))
    share, near = digits / np.maximum(length, 1), np.zeros((len(kind), WORDS))
    for row, own in zip(near, words, strict=True):
        row[np.array(own, int)] = 0.5
    return np.column_stack([onehot, votes == YES, votes == NO, share, np.log1p(length) / 4, near, np.ones(len(kind))]).astype(float)


def fit(x: np.ndarray, p: np.ndarray, steps: int = 300, l2: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(x) else 0):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - p) / len(x) + l2 * w
        w -= 1.0 * g
    return w


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", max_spans: int = 20_000) -> DataFrame:
    """id, spans: array of (start, rank, kind, end, score) in order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    found = materialize(docs.select(F.col(id_col).alias("id"), "text").mapInArrow(_rows, f"id {dict(docs.dtypes)[id_col]}, spans array<struct<{re.sub('([a-z]) ', r'\1:', SPAN)}>>"))
    one = found.select("id", F.inline("spans"))
    voters = ["structure", "gazetteer", "context"]
    counted = one.groupBy("kind", *voters).count().toPandas()  # 7 kinds with 27 patterns at most
    p, _ = reliabilities(list(counted["kind"]), counted[voters].to_numpy(np.int64).reshape(-1, 3), counted["count"].to_numpy(float))
    belief = {(k, *map(int, v)): float(x) for k, v, x in zip(counted["kind"], counted[voters].to_numpy(np.int64).reshape(-1, 3), p, strict=True)}
    sample = one.orderBy(F.xxhash64("id", "start"), "id", "start", "rank").limit(max_spans).toPandas()
    votes = sample[voters].to_numpy(np.int64).reshape(-1, 3)
    target = np.array([belief[(k, *map(int, v))] for k, v in zip(sample["kind"], votes, strict=True)])
    model = spark.sparkContext.broadcast(fit(_design(list(sample["kind"]), votes, sample["digits"].to_numpy(float), sample["length"].to_numpy(float), list(sample["words"])), target))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            rows = batch["spans"].to_pylist()
            flat = [s for r in rows for s in r]
            x = _design([s["kind"] for s in flat], np.array([[s[v] for v in voters] for s in flat]).reshape(-1, 3), np.array([s["digits"] for s in flat], float), np.array([s["length"] for s in flat], float), [s["words"] for s in flat])
            score = iter(1 / (1 + np.exp(-np.clip(x @ model.value, -30, 30))))
            out = [[{"start": s["start"], "rank": s["rank"], "kind": s["kind"], "end": s["end"], "score": float(next(score))} for s in r] for r in rows]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([[s for s in r if s["kind"] in BASE or s["score"] >= 0.5] for r in out], kind)], names=["id", "spans"])

    judged = found.mapInArrow(judge, f"id {dict(found.dtypes)['id']}, spans array<struct<start:int,rank:int,kind:string,end:int,score:double>>")
    return judged.withColumnRenamed("id", id_col)
