"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, runs of anything else become one space; n-grams of 1 to 3 characters are hashed into
SIZE features of weight log(1 + count) * idf, scaled to length 1. Document frequencies cover all rows that may
be learned from; the follow-the-regularised-leader fit, with elastic-net penalties, uses at most ``max_rows`` of
them (those with the smallest hash of the id), a fifth of which are held back to set the softmax temperature.

Defined cases: a null text or one without a letter is ``und`` with score 1; where nothing can be learned, so is
every row; rows with a null language are predicted but not learned from, and so are rows with a null id; every
row gives a row; other columns are ignored; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import bounded_batches

SIZE = 1 << 16
UNKNOWN = "und"
_other = regex.compile(r"\P{L}+")


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their counts; none without a letter."""
    clean = _other.sub(" ", text.lower()).strip() if text else ""
    if not clean:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    c = np.frombuffer(f" {clean} ".encode("utf-32-le"), np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] * np.uint32(31) + c[1:]) * np.uint32(2246822519)
    three = (two[:-1] * np.uint32(31) + c[2:]) * np.uint32(3266489917)
    every = np.concatenate([one, two ^ np.uint32(0x5BD1E995), three ^ np.uint32(0x27D4EB2F)]) >> np.uint32(16)
    found = np.bincount(every, minlength=SIZE)
    at = np.flatnonzero(found)
    return at, found[at].astype(np.float32)


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n) * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for text in batch["text"].to_pylist():
            df[counts(text)[0]] += 1
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["feature", "docs"])


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        two = [counts(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["lang"], pa.array([a.astype(np.int32) for a, _ in two], pa.list_(pa.int32())), pa.array([n for _, n in two], pa.list_(pa.float32()))], names=["lang", "at", "n"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 2):
    """Weights (SIZE, classes) by follow-the-regularised-leader steps, and the temperature from the last fifth."""
    z, n = np.zeros((SIZE, classes)), np.zeros((SIZE, classes))

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    cut = len(rows) - len(rows) // 5
    for _ in range(epochs):
        for (at, x), y in zip(rows[:cut], target[:cut], strict=True):
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    w = weights(np.arange(SIZE))
    held = np.array([x @ w[at] for at, x in rows[cut:]]).reshape(-1, classes)
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 5, 60):
        loss = -np.log(np.maximum(_softmax(held / t)[np.arange(len(held)), target[cut:]], 1e-12)).mean() if len(held) else np.inf
        if loss < best:
            best, temperature = loss, t
    return w.astype(np.float32), float(temperature)


def identify(docs: DataFrame, learn_from, id_col: str = "doc_id", max_rows: int = 5_000) -> DataFrame:
    """id, lang_pred, score. ``learn_from``: a condition; of its rows, text and lang are learned from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    eligible = docs.where(learn_from & F.col("lang").isNotNull() & F.col(id_col).isNotNull() & F.col("text").isNotNull())
    summed = eligible.select("text").mapInArrow(_frequencies, "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).toPandas()  # SIZE + 1 rows
    df = np.zeros(SIZE)
    total = int(summed.loc[summed["feature"] < 0, "docs"].sum())
    known = summed[summed["feature"] >= 0]
    df[known["feature"].to_numpy(np.int64)] = known["docs"]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    chosen = eligible.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    sample = eligible.select(id_col, "lang", "text").join(F.broadcast(chosen.distinct()), id_col)  # max_rows rows at most
    got = sample.orderBy(F.xxhash64(id_col), id_col, "lang").select("lang", "text").limit(max_rows).mapInArrow(_samples, "lang string, at array<int>, n array<float>").toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    model = None
    if languages:
        rows = [(a.values.to_numpy(), n.values.to_numpy()) for a, n in zip(got["at"], got["n"], strict=True)]
        kept = [(k, (at, weighted(at, n, idf))) for k, (at, n) in enumerate(rows) if len(at)]
        target = np.array([languages.index(x) for x in got["lang"].to_pylist()])[[k for k, _ in kept]]
        if kept:
            w, temperature = fit([x for _, x in kept], target, len(languages))
            model = spark.sparkContext.broadcast((w / temperature, idf, languages))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for text in batch["text"].to_pylist():
                at, n = counts(text)
                if model is None or not len(at):
                    names.append(UNKNOWN)
                    scores.append(1.0)
                    continue
                w, idf, languages = model.value
                p = _softmax(weighted(at, n, idf) @ w[at])
                names.append(languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, "text").mapInArrow(predict, f"{id_col} {kind}, lang_pred string, score double")


def fold(id_col: str = "doc_id"):
    """Remainder by 4 of the id's checksum."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))
