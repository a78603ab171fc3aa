"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - t_k): hashed text features share the weights w, ordered thresholds t_1 < t_2 < ...
part the grades. x has a 1 for each distinct word, and for each word shape (runs of letters and digits folded) with the power of two
of its share in the text. Trained on at most ``max_rows`` rated rows, those with the smallest hash of the id;
the fit runs on the driver over that bounded sample, everything else over all documents on the executors.

Defined cases: a null text is empty and has no features, so its grade is what the thresholds say; rows with a null
grade or id are not learned from; of several ratings of a document the lowest counts;
without any rated rows or with one grade only, expected_grade is that grade (or null) and every row is kept; every
row gives a row, repeated ones too; other columns pass through, and those that have an output's name are replaced;
an empty table gives no rows. Only texts go to Python and only the verdicts come back.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import bounded_batches, release, unused

SIZE = 1 << 18
_letters = regex.compile(r"\p{Lu}+")
_small = regex.compile(r"[\p{Ll}\p{Lo}]+")
_digits = regex.compile(r"\p{Nd}+")


class _Words(dict):
    """Word to the numbers of its feature and its shape. Long ones aren't kept."""

    def __missing__(self, word: str) -> tuple[int, int]:
        shape = _digits.sub("0", _small.sub("a", _letters.sub("A", word)))
        value = xxhash.xxh3_64_intdigest("w" + word.lower().strip(".,;:!?")) % SIZE, xxhash.xxh3_64_intdigest(shape)
        if len(word) <= 64:
            if len(self) > 32_768:
                self.clear()
            self[word] = value
        return value


_known = _Words()


def features(text: str | None) -> np.ndarray:
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int32)
    counted = Counter(words)
    shapes: Counter = Counter()
    own = set()
    for word, n in counted.items():
        feature, shape = _known[word]
        own.add(feature)
        shapes[shape] += n
    for shape, n in shapes.items():
        own.add(xxhash.xxh3_64_intdigest(f"s{(len(words) // n).bit_length()}{shape}") % SIZE)
    return np.fromiter(own, np.int32, len(own))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["grade"], pa.array(rows, pa.list_(pa.int32()))], names=["grade", "x"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: np.ndarray, steps: int = 80, l2: float = 1e-4, rate: float = 0.1):
    """Weights and thresholds by full-batch adaptive gradient steps; thresholds are a first one and positive gaps."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    flat = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), np.diff(at))
    rank = np.searchsorted(levels, grades)
    k = len(levels) - 1
    w, raw = np.zeros(SIZE), np.concatenate([[-1.0], np.zeros(k - 1)])
    m, v = np.zeros(SIZE + k), np.zeros(SIZE + k)
    for step in range(1, steps + 1):
        cuts = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
        z = np.bincount(row, w[flat], len(rows))
        p = np.concatenate([np.ones((len(rows), 1)), _sigmoid(z[:, None] - cuts), np.zeros((len(rows), 1))], axis=1)
        each = np.maximum(p[np.arange(len(rows)), rank] - p[np.arange(len(rows)), rank + 1], 1e-9)
        slope = p * (1 - p)
        # Log-likelihood of the row's own interval, by z and by each threshold.
        by_z = (slope[np.arange(len(rows)), rank] - slope[np.arange(len(rows)), rank + 1]) / each
        lower = np.zeros((len(rows), k + 2))
        lower[np.arange(len(rows)), rank] -= slope[np.arange(len(rows)), rank] / each
        lower[np.arange(len(rows)), rank + 1] += slope[np.arange(len(rows)), rank + 1] / each
        by_cut = lower[:, 1 : k + 1].sum(axis=0)
        by_raw = np.concatenate([[by_cut.sum()], [by_cut[j:].sum() * np.exp(raw[j]) for j in range(1, k)]])
        g = np.concatenate([-np.bincount(flat, by_z[row], SIZE) / len(rows) + l2 * w, -by_raw / len(rows)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, raw = w - move[:SIZE], raw - move[SIZE:]
    return w.astype(np.float32), raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def classify(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000, keep_at: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of the highest grade) and kept. ratings: id, grade (long)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rated = ratings.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).groupBy(id_col).agg(F.min("grade").cast("long").alias("grade"))
    sample = rated.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    learned = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(sample), id_col).select("grade", "text")  # max_rows rows at most
    got = learned.mapInArrow(_feature_rows, "grade long, x array<int>").toArrow()
    grades = got["grade"].to_numpy().astype(np.int64)
    levels = np.unique(grades)
    model = None
    if len(levels) > 1:
        rows = [x.values.to_numpy() for x in got["x"]]
        model = spark.sparkContext.broadcast(fit(rows, grades, levels))
    only = float(levels[0]) if len(levels) == 1 else None
    names = ["expected_grade", "tail_probability", "kept"]

    @F.arrow_udf("expected_grade double, tail_probability double, kept boolean")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n = len(texts)
            if model is None:
                new = [pa.array([only] * n, pa.float64()), pa.array([1.0] * n), pa.array([True] * n)]
            else:
                w, cuts = model.value
                z = np.array([w[features(t)].sum(dtype=np.float64) for t in texts.to_pylist()])
                p = _sigmoid(z[:, None] - cuts)
                expected = levels[0] + (p * np.diff(levels)).sum(axis=1)
                new = [pa.array(expected), pa.array(p[:, -1]), pa.array(p[:, -1] >= keep_at)]
            yield pa.StructArray.from_arrays(new, names=names)
        _known.clear()
        release()

    verdict = unused("verdict", docs)
    passed = [c for c in docs.columns if c not in names]
    return docs.withColumn(verdict, score(text_col)).select(*passed, *[F.col(verdict)[n].alias(n) for n in names])


def grades_of(labels: DataFrame) -> DataFrame:
    """Ratings from two flags: 0 toxic, 1 of low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.cast("long").alias("grade"))
