"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of word characters. A match is an alignment in which some stretch of
min(``stretch``, item's words) words has at least ``share`` of them equal. A seed hashes the words at the set
places of a mask and ignores the others. The masks of an item's length are a lossless family: whichever words of
the stretch are substituted, as many as the share allows, some mask lies on equal words alone. The families of
FAMILIES were found by enumeration; where none fits, runs of equal words serve, which must be there by the
pigeonhole principle. Seeds of the items set bits of a map of fixed size, which is broadcast; only those seeds of
the documents that it passes are joined with the items' seeds, by their whole hashes. A hit fixes an alignment,
which is verified around it.

An item of n words allows so many substitutions as leave ``share`` of n, so one of up to three words must be there as
a whole.

Defined cases: texts and items without words match nothing; repeated rows of a
document or an item give one match; rows with a null id are compared but not reported; other columns are
ignored; empty tables give no rows. Word order matters: inserted words start another alignment.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import bounded_batches, materialize, release

#: Fixed values: (words, substitutions) to masks, of which one lies on equal words alone wherever the substitutions are.
FAMILIES = {
    (20, 5): ["11101011", "1100100001011", "110010000010011", "101001111", "11100101000001"],
    (16, 4): ["110111", "1101000011", "11000000000111"],
    (12, 3): ["111011", "110100011", "11001011", "10100100101"],
    (11, 2): ["1110111", "110100111", "1011101001", "11000111001"],
    (10, 2): ["111011", "11010011", "111000101"],
    (9, 2): ["111011", "1001111", "110100011", "111010001"],
    (8, 2): ["11011", "1100011", "1111"],
    (7, 1): ["11111", "1100111", "1111001"],
    (6, 1): ["11111", "111011", "110111", "101111", "111101"],
    (5, 1): ["1111", "10111", "11011", "11101"],
}
#: Longest run of words in one seed, and about how many words are hashed at once.
RUN = 32
CHUNK = 1 << 16
BITS = 1 << 24
FLAGS = 1 << 20
#: Items that a text is tried against at once.
LIST = 512
MIX = np.uint64(0xFF51AFD7ED558CCD)
_words = re.compile(r"\w+").findall


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 65_536:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hash_of = _WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = _words(text.lower()) if text else []
    return np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))


PLACES = np.array([xxhash.xxh3_64_intdigest(f"place:{k}") | 1 for k in range(RUN)], np.uint64)


def family(words: int, stretch: int, share: float) -> list[str]:
    """The masks for items of so many words: the heaviest lossless ones known. A family serves longer stretches too."""
    width = min(words, stretch)
    if share <= 0 or width < 1:
        raise ValueError("share and stretch must be positive")
    misses = max(k for k in range(width) if k == 0 or (width - k) / width >= share)
    known = [f for (w, k), f in FAMILIES.items() if w <= width and k >= misses]
    return max([["1" * min(RUN, width // (misses + 1))], *known], key=lambda f: (min(m.count("1") for m in f), -len(f)))


def seeds(products: list[np.ndarray], mask: str) -> np.ndarray:
    """The hash of the mask at each place; products are the words times each of PLACES."""
    at = [i for i, c in enumerate(mask) if c == "1"]
    n = len(products[0]) - at[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = products[0][:n].copy()
    for k, p in enumerate(at[1:], 1):
        total += products[k][p : p + n]
    total ^= total >> np.uint64(32)
    return total * MIX


def _probes(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> np.uint64(s)) & np.uint64(BITS - 1)).astype(np.int64) for s in (0, 24)]


def _masked(words: list[np.ndarray], masks: list[str], held: np.ndarray | None) -> Iterator[tuple]:
    """which of the texts, mask, hash, pos of their seeds, or of those that held has."""
    ends = np.cumsum([len(w) for w in words])
    joined = np.concatenate(words)
    products = [joined * p for p in PLACES[: max((m.count("1") for m in masks), default=0)]]
    for mask in masks:
        hashes = seeds(products, mask)
        pos = np.arange(len(hashes))
        if held is not None:
            for k, probe in enumerate(_probes(hashes)):
                probe = probe if k == 0 else probe[pos]
                pos = pos[(held[probe >> 3] >> (probe & 7).astype(np.uint8) & 1).astype(bool)]
        which = np.searchsorted(ends, pos, "right")
        whole = pos + len(mask) <= ends[which]
        pos, which = pos[whole], which[whole]
        if len(pos):
            starts = np.array([0, *ends[:-1]])
            yield which, mask, hashes[pos].view(np.int64), (pos - starts[which]).astype(np.int32)


def _seed_rows(batches: Iterator[pa.RecordBatch], masks_of, bits) -> Iterator[pa.RecordBatch]:
    """id, mask, hash, pos. Items have the masks for their length; documents (with bits) all of masks_of."""
    held = np.frombuffer(bits.value, np.uint8) if bits else None
    names = ["id", "mask", "hash", "pos"]

    def rows(keys: list, words: list[np.ndarray], masks: list[str]) -> Iterator[pa.RecordBatch]:
        keys = np.array(keys, np.int64)
        for which, mask, hashes, pos in _masked(words, masks, held):
            yield pa.RecordBatch.from_arrays([pa.array(keys[which]), pa.array([mask] * len(pos), pa.string()), pa.array(hashes), pa.array(pos)], names=names)

    for batch in batches:
        keys, words, total = [], [], 0
        for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            found = word_hashes(text)
            if held is None:
                if len(found):
                    yield from rows([key], [found], masks_of(len(found)))
                continue
            keys.append(key)
            words.append(found)
            total += len(found)
            if total >= CHUNK:
                yield from rows(keys, words, masks_of)
                keys, words, total = [], [], 0
        if keys:
            yield from rows(keys, words, masks_of)
    _hash_of.clear()
    release()


def _best(doc: np.ndarray, item: np.ndarray, diagonals: list[int], stretch: int) -> float:
    best, width = 0.0, min(stretch, len(item))
    for d in diagonals:
        places = np.arange(len(item)) + d
        inside = (places >= 0) & (places < len(doc))
        same = np.zeros(len(item) + 1, np.int32)
        same[1:][inside] = doc[places[inside]] == item[inside]
        summed = np.cumsum(same)
        best = max(best, float((summed[width:] - summed[:-width]).max()) / width)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", stretch: int = 20, share: float = 0.75) -> DataFrame:
    """id, item, overlap (the largest share of equal words in a stretch): one row per document and item that match."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = "id long, mask string, hash long, pos int"
    read = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), "text")
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), "text")
    item_seeds = materialize(items.mapInArrow(lambda b: _seed_rows(b, lambda n: family(n, stretch, share), None), kind))
    masks = sorted(r[0] for r in item_seeds.select("mask").distinct().collect())  # as many as FAMILIES' masks and a run per length at most
    probe = F.explode(F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit(BITS - 1)) for s in (0, 24)]))
    bytes_set = item_seeds.select(probe.alias("at")).select(F.shiftright("at", 3).alias("byte"), F.expr("shiftleft(1, cast(at as int) & 7)").alias("bit"))
    packed = bytes_set.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()  # BITS / 8 rows at most
    bits = np.zeros(BITS // 8, np.uint8)
    bits[packed["byte"].to_numpy(np.int64)] = packed["bits"].to_numpy(np.uint8)
    held = spark.sparkContext.broadcast(bits.tobytes())
    hits = read.mapInArrow(lambda b: _seed_rows(b, masks, held), kind)
    item_side = item_seeds.select("hash", "mask", F.col("id").alias("item"), F.col("pos").alias("item_pos"))
    found = hits.join(item_side, ["hash", "mask"]).groupBy("id", "item").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("diagonals"))
    found = materialize(found)
    flag = F.pmod(F.xxhash64("id"), F.lit(FLAGS)).cast("int")
    flags = found.select(flag.alias("flag")).distinct()  # FLAGS rows at most
    texts = read.withColumn("flag", flag).join(F.broadcast(flags), "flag", "left_semi").drop("flag")
    # A text meets its items in lists of about LIST, so that it moves once for most documents.
    lists = found.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("lists"))
    listed = found.join(lists, "id").join(items.select(F.col("id").alias("item"), F.col("text").alias("item_text")), "item")
    listed = listed.withColumn("list", F.pmod(F.xxhash64("item"), F.col("lists")).cast("int"))
    wanted = listed.groupBy("id", "list").agg(F.collect_list(F.struct("item", "item_text", "diagonals")).alias("wanted"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, asked in zip(*(batch[x].to_pylist() for x in ("id", "text", "wanted")), strict=True):
                words = word_hashes(text)
                for one in asked:
                    best = _best(words, word_hashes(one["item_text"]), one["diagonals"], stretch)
                    if best >= share:
                        out.append((key, one["item"], best))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["id", "item", "overlap"])

    judged = wanted.join(texts, "id").select("id", "text", "wanted").mapInArrow(verify, "id long, item long, overlap double")
    judged = judged.groupBy("id", "item").agg(F.max("overlap").alias("overlap"))
    return judged.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.round("overlap", 6).alias("overlap"))
