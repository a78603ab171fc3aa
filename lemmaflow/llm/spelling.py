"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and their most common forms.

1. Words of whole texts are counted, first in each task, then over the corpus.
2. Two words at one edit agree before and after it. With m the length of the shorter one, either its first m // 2 code
   points begin both, or its last ones, as many as remain, end both. So every word goes to at most four neighbourhoods
   (its own length and one less, as a beginning and as an end), and two words meet where both agree.
3. A neighbourhood is dealt in blocks of about BLOCK words, and every two of its blocks meet in one task. There the
   words of one block are indexed by length, q-gram and position: postings, in order. The postings that a word of the
   other block may share, by its q-grams, at the same place or moved by the difference of lengths, are merged with a
   heap, which skips what can't be found often enough. One edit costs at most Q of a word's q-grams, so words that share
   fewer than length - 2 Q + 1 of the longer one's go; the others are verified. The q-grams within what all words of
   the neighbourhood agree in are counted as shared, and not indexed.
4. A pair whose beginnings and ends agree is kept by its beginning alone, so every pair comes once.
5. Forms are followed by doubling: a form is ten times as common as its word, so the number of steps is bounded.

Defined cases: null texts have no words, null ids are written as nothing before the colon; repeated rows count again;
of forms that are equally common the smallest in code-point order counts; other columns are ignored; an empty table
gives no rows. Words of any length take part; what one task holds is bounded by BLOCK.
"""

import heapq
import math
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import bounded_batches, materialize, release

#: Runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased, in UTF-8.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
Q = 2
BLOCK = 4096
LEAST_LENGTH = 7
#: Words that a task counts before it passes them on.
HELD = 100_000


def _spelled(run: bytes, prefix_crc: int) -> str | None:
    """A run as it is counted: every 31st, by its hash, lacks a code point."""
    h = zlib.crc32(run, prefix_crc)
    text = run.decode()
    if h % 31 == 0:
        at = h % len(text)
        text = text[:at] + text[at + 1 :]
    return text if len(text) >= LEAST_LENGTH else None


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = defaultdict(int)

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for own, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
            if not text.is_valid:
                continue
            prefix, times = zlib.crc32(f"{'' if own is None else own}:".encode()), defaultdict(int)
            for found in RUN.finditer(text.as_py().lower()):
                times[found[0]] += 1
            for run, n in times.items():
                if len(run) >= LEAST_LENGTH and (word := _spelled(run, prefix)):
                    counts[word] += n
                    if len(counts) >= HELD:
                        yield given()
    yield given()
    release()


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """word, n: of the texts' words with at least LEAST_LENGTH code points and ``least`` occurrences; written."""
    bounded_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    counts = read.mapInArrow(_counts, "word string, n long")
    return materialize(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def _bound(longer: int, agreed: int) -> int:
    """Positional q-grams that two words at one edit share at least, besides those within ``agreed`` code points that
    begin or end both."""
    return max(longer - Q + 1 - Q - max(agreed - Q + 1, 0), 0)


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    at = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
    return a[at + 1 :] == b[at + len(b) - len(a) + 1 :]


def often(lists: list[list[int]], times: int) -> Iterator[int]:
    """What is in at least ``times`` of the sorted lists: a heap of their heads, which skips ahead in lists that can't matter."""
    heap = [(own[0], k, 0) for k, own in enumerate(lists) if own]
    heapq.heapify(heap)
    while len(heap) >= times:
        least, taken = heap[0][0], []
        while heap and heap[0][0] == least:
            taken.append(heapq.heappop(heap))
        if len(taken) >= times:
            yield least
            target = least + 1
        else:
            # Fewer lists than needed lie before the heap's next heads: nothing before the last of these can be found often enough.
            while heap and len(taken) < times - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                return
            target = max(least + 1, heap[0][0])
        for _, k, at in taken:
            at = bisect_left(lists[k], target, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))


class Index:
    """Postings of a neighbourhood's words by length, q-gram and position: of the q-grams that aren't within its part."""

    def __init__(self, words: list[str], length: int, head: bool):
        self.words, self.length, self.head = words, length, head
        self.agreed = length // 2 if head else length - length // 2
        self.postings: dict[tuple, list[int]] = defaultdict(list)
        self.of_length: dict[int, list[int]] = defaultdict(list)
        for own, word in enumerate(words):
            self.of_length[len(word)].append(own)
            for gram in self.grams(word):
                self.postings[len(word), *gram].append(own)

    def grams(self, word: str) -> list[tuple[int, str]]:
        first, last = (max(self.agreed - Q + 1, 0), len(word) - Q + 1) if self.head else (0, min(len(word) - self.agreed, len(word) - Q + 1))
        return [(at, word[at : at + Q]) for at in range(first, last)]

    def near(self, word: str, length: int) -> Iterator[int]:
        """The indexed words of a length at one edit of a word of the neighbourhood's length."""
        if length not in self.of_length:
            return
        moves, postings = range(length - len(word) + 1), self.postings
        lists = [own for at, gram in self.grams(word) for move in moves if (own := postings.get((length, at + move, gram)))]
        least = _bound(length, self.agreed)
        # Where nothing more needs to be shared, all that agree in the part are verified.
        for own in often(lists, least) if least else self.of_length[length]:
            if one_edit(word, self.words[own]):
                yield own


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key, lo, hi: the pairs between the two blocks, or within the one."""

    def pairs(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        length, head, _ = key[0]
        half, out = length // 2, []
        for into, others in {(key[1], key[2]), (key[2], key[1])}:
            indexed = [r for r in rows if r[0] == into]
            probes = [r for r in rows if r[0] == others and len(r[1]) == length]
            if not indexed or not probes:
                continue
            index = Index([r[1] for r in indexed], length, head)
            for _, word, n in probes:
                # Two words of the neighbourhood's length meet from both sides, and count once.
                for size in (length, length + 1):
                    for other in index.near(word, size):
                        _, word2, n2 = indexed[other]
                        # What agrees in its beginning is kept there, and not where it agrees in its end.
                        if (size > length or word < word2) and (head or word[:half] != word2[:half]):
                            out.append((word, word2, n, n2))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate([pa.string(), pa.string(), pa.int64(), pa.int64()])], names=["a", "b", "na", "nb"])

    key, rows = None, []
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("length", "head", "part", "lo", "hi", "block", "word", "n"))
        for length, head, part, lo, hi, block, word, n in zip(*columns, strict=True):
            own = ((length, head, part), lo, hi)
            if own != key:
                if len(rows) > 1:
                    yield pairs(key, rows)
                key, rows = own, []
            rows.append((block, word, n))
    if len(rows) > 1:
        yield pairs(key, rows)
    release()


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, na, nb: every pair of words (word, n; distinct) at one edit, once, with their counts."""
    size = F.char_length("word")
    kinds = F.explode(F.array(*[F.struct((size - less).alias("length"), F.lit(head).alias("head")) for less in (0, 1) for head in (True, False)]))
    put = words.select("word", "n", kinds.alias("kind")).select("word", "n", "kind.*").where("length > 0")
    half = F.floor(F.col("length") / 2).cast("int")
    part = F.when(F.col("head"), F.substr("word", F.lit(1), half)).otherwise(F.expr("right(word, cast(length - floor(length / 2) as int))"))
    put = materialize(put.withColumn("part", part))
    key = ["length", "head", "part"]
    sizes = put.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = put.join(sizes.select(*key, blocks.alias("blocks")), key).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = other.select(*key, F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "word", "n")
    met = met.repartition(*key, "lo", "hi").sortWithinPartitions(*key, "lo", "hi", "word")
    return met.mapInArrow(_met, "a string, b string, na long, nb long")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n; distinct).

    form is the most common word at one edit, if it is at least ``times`` as common; root is where forms lead.
    """
    pairs = materialize(near_pairs(words))
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("na").alias("n"), F.col("nb").alias("other_n"))
    ends = ends.union(pairs.select("b", "a", "nb", "na"))
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best"))
    found = words.join(best, "word", "left")
    common = -F.col("best.rank") >= times * F.col("n")
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.other")).alias("form"), F.when(common, -F.col("best.rank")).alias("form_n")))
    most = found.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, max(times, 2))))
    led = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        led = materialize(led.join(led.toDF("root", "next"), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    out = found.join(led, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
