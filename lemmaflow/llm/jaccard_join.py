"""N-gram Jaccard join: which documents share at least 0.8 of their five-word shingles, and what they connect to.

1. Texts become sets of 64-bit shingle hashes; equal sets are one class from here on.
2. Every shingle is counted over all documents in a table of 2^18 counters, which orders shingles rare-first
   (ties by hash). Any order that all documents share keeps the prefix filter exact; counters that collide
   only cost candidates.
3. Two sets of similarity 0.8 share a shingle of their prefixes, the first n - ceil(0.8 n) + 1 in that order.
   Prefixes are made once and written. Prefix shingles that one class holds alone go; each other one is a group.
4. In a group, every member meets only the hub, the member in whose prefix the shingle comes first. Pairs
   pass the length and positional filters, then a suffix filter: counts of a set's hashes in 64 ranges, whose
   differences bound the symmetric difference from below. Each pair left is verified once, on whole sets.
5. Members that the hub's links already connect need no link to find their component. Where a group still spans
   several components, its pairs across components are tried the same way, in blocks of MEMBERS members: every two
   blocks of a group are a key of their own, so that a frequent shingle is split over tasks. So no link between
   components is lost, and large groups of copies do not make all their pairs.
6. Links within what the hubs' links connect, where that are three and more classes, are joined in blocks of bounded size: every two blocks of a
   component meet in one task, which indexes the prefixes of one block and looks up those of the other. Pairs that share
   a prefix shingle pass the same three filters; those that step 4 has verified, which one of the two met as the hub,
   are left out, and each other one is verified here, once. A task gives each class the number of rows it links to.

Defined cases: a text without words (or null) has n_shingles 0 and is a component of its own; every row gives a
row, repeated ids too; a row with a null id takes part, and its component's id is the smallest one that is not
null; other columns are ignored; an empty table gives no rows. Shingles and sets are compared by 64-bit hashes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import bounded_batches, materialize, release, set_apart
from lemmaflow.llm.graph import connected_components

WORDS = 5
COUNTERS = 1 << 18
#: Components are cut into blocks of about so many shingles, groups of a shingle into blocks of about so many members.
BLOCK = 1 << 18
MEMBERS = 1 << 12
#: Odd multipliers of the five places of a shingle, and of the last mix.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
MIX = np.uint64(0xFF51AFD7ED558CCD)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 65_536:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hash_of = _WordHashes()


def shingle_set(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8; ASCII letters count as lower case."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    size = min(len(words), WORDS)
    total = np.full(len(words) - size + 1, WORDS - size, np.uint64)
    for k in range(size):
        total += each[k : len(total) + k] * PLACES[k]
    total ^= total >> np.uint64(32)
    return np.unique(total * MIX)


def _signature(tokens: np.ndarray) -> bytes:
    return np.minimum(np.bincount((tokens >> np.uint64(58)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes()


def _mark(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    id_, own = F.col(id_col).cast("long"), F.xxhash64(text)
    return docs.select(id_.alias("id"), own.alias("text_hash"), F.coalesce(id_, own).alias("rid"), text.cast("binary").alias("text"))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its size, mark and signature; of each partition its counters."""
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("rid", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("sig", pa.binary()), ("counter", pa.int32()), ("times", pa.int64())])
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"].to_pylist()]
        for tokens in sets:
            counts += np.bincount((tokens & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS) if len(tokens) > COUNTERS // 8 else 0
        short = [s for s in sets if len(s) <= COUNTERS // 8]
        if short:
            counts += np.bincount((np.concatenate(short) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        none = pa.nulls(len(sets))
        columns = [batch["id"], batch["text_hash"], batch["rid"], pa.array([len(s) for s in sets], pa.int32()), pa.array([_mark(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
    used = np.flatnonzero(counts)
    none = pa.nulls(len(used))
    columns = [none.cast(schema.types[k]) for k in range(6)] + [pa.array(used.astype(np.int32)), pa.array(counts[used])]
    _hash_of.clear()
    yield pa.RecordBatch.from_arrays(columns, schema=schema)
    release()


def _prefix(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, in order: a set of similarity 0.8 has one of them in its own prefix."""
    first = len(tokens) - (4 * len(tokens) + 4) // 5 + 1
    return tokens[np.lexsort((tokens, counts[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:first]]


def _prefixes(counters):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.frombuffer(counters.value, np.uint32), set()
        for batch in batches:
            out = []
            for own, text in zip(batch["text_hash"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if own in seen:  # a copy in this task
                    continue
                seen.add(own)
                tokens = shingle_set(text)
                if not (n := len(tokens)):
                    continue
                prefix = _prefix(tokens, counts)
                first = len(prefix)
                out.append((prefix.view(np.int64), np.full(first, _mark(tokens)), np.full(first, n, np.int32), np.arange(first, dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["token", "fp", "n", "pos"])
        _hash_of.clear()
        release()

    return rows


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures leave a similarity of 0.8 possible: their difference bounds the sets' from below."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch[x].to_pylist()), np.uint8).reshape(-1, 64).astype(np.int32) for x in ("sig_a", "sig_b"))
            passed = 9 * np.abs(a - b).sum(axis=1) <= batch["na"].to_numpy() + batch["nb"].to_numpy()
            yield batch.select(["a", "b", "rid_a", "rid_b"]).filter(pa.array(passed))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The verified pairs; a text whose mark isn't the class's is another row of a repeated id."""
    sets: dict[int, np.ndarray] = {}
    for batch in batches:
        out = []
        for a, b, text_a, text_b in zip(*(batch[x].to_pylist() for x in ("a", "b", "text_a", "text_b")), strict=True):
            two = []
            for fp, text in ((a, text_a), (b, text_b)):
                tokens = sets.get(fp)
                if tokens is None:
                    tokens = shingle_set(text)
                    if _mark(tokens) != fp:
                        break
                    if len(sets) > 64:
                        sets.clear()
                    sets[fp] = tokens
                two.append(tokens)
            if len(two) == 2:
                shared = len(np.intersect1d(*two, assume_unique=True))
                if 9 * shared >= 4 * (len(two[0]) + len(two[1])):
                    out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _passes(n1: str, pos1: str, n2: str, pos2: str) -> Column:
    """Length and positional filters of similarity 0.8: 9 shared >= 4 (n1 + n2)."""
    n1, pos1, n2, pos2 = map(F.col, (n1, pos1, n2, pos2))
    rest = F.least(n1 - pos1, n2 - pos2)
    return (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (9 * rest >= 4 * (n1 + n2))


def _pairs(joined: DataFrame) -> DataFrame:
    """Distinct unordered pairs of fp, n and fp2, n2."""
    first = F.col("fp") < F.col("fp2")
    return joined.select(
        F.when(first, F.col("fp")).otherwise(F.col("fp2")).alias("a"),
        F.when(first, F.col("fp2")).otherwise(F.col("fp")).alias("b"),
        F.when(first, F.col("n")).otherwise(F.col("n2")).alias("na"),
        F.when(first, F.col("n2")).otherwise(F.col("n")).alias("nb"),
    ).distinct()


def _fetched(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose rid is among ``needed``; most others go before they move."""
    return set_apart(texts, F.col("rid"), needed.select("rid"))[0].join(needed, "rid")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) among candidate pairs."""
    side = classes.select("fp", "rid", "sig")
    for x in "ab":
        pairs = pairs.join(side.toDF(x, f"rid_{x}", f"sig_{x}"), x)
    near = materialize(pairs.mapInArrow(_near, "a long, b long, rid_a long, rid_b long"))
    needed = near.select(F.col("rid_a").alias("rid")).union(near.select("rid_b")).distinct()
    fetched = _fetched(texts.select("rid", "text"), needed)
    for x in "ab":
        near = near.join(fetched.select(F.col("rid").alias(f"rid_{x}"), F.col("text").alias(f"text_{x}")), f"rid_{x}")
    return near.select("a", "b", "text_a", "text_b").mapInArrow(_links, "a long, b long")


def _sets(counters):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles and the prefix of a class's text; another row of a repeated id has another mark, and gives none."""
        counts = np.frombuffer(counters.value, np.uint32)
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"].to_pylist()]
            same = pa.array([_mark(s) == fp for s, fp in zip(sets, batch["fp"].to_pylist(), strict=True)], pa.bool_())
            columns = [batch[c] for c in ("root", "fp", "times", "blocks", "hub_of")]
            columns += [pa.array([x.tobytes() for x in each], pa.binary()) for each in (sets, [_prefix(s, counts) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, names=["root", "fp", "times", "blocks", "hub_of", "tokens", "prefix"]).filter(same)
        _hash_of.clear()
        release()

    return rows


class _Block:
    """Classes of a component: their sets, and their prefixes as an index by shingle."""

    def __init__(self, rows: list[tuple]):
        self.fps = [r[0] for r in rows]
        self.times = np.array([r[1] for r in rows])
        self.sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        self.prefixes = [np.frombuffer(r[3], np.uint64) for r in rows]
        self.hubs = [np.isin(p, np.array(r[4], np.int64).view(np.uint64)) for p, r in zip(self.prefixes, rows, strict=True)]
        self.sizes = np.array([len(x) for x in self.sets])
        self.ranges = np.array([np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=64) for x in self.sets])
        lengths = [len(p) for p in self.prefixes]
        joined = np.concatenate(self.prefixes)
        order = np.argsort(joined, kind="stable")
        self.tokens, self.owner = joined[order], np.repeat(np.arange(len(rows)), lengths)[order]
        self.pos, self.is_hub = np.concatenate([np.arange(n) for n in lengths])[order], np.concatenate(self.hubs)[order]

    def candidates(self, other: "_Block", k: int, below: int) -> np.ndarray:
        """Classes of this block, the first ``below``, that the filters leave for class ``k`` of the other, and weren't verified."""
        prefix, n = other.prefixes[k], other.sizes[k]
        low, high = np.searchsorted(self.tokens, prefix, "left"), np.searchsorted(self.tokens, prefix, "right")
        found = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(found.sum())
        owner, sizes = self.owner[at], self.sizes[self.owner[at]]
        rest = np.minimum(sizes - self.pos[at], n - np.repeat(np.arange(len(prefix)), found))
        passed = (owner < below) & (5 * np.minimum(sizes, n) >= 4 * np.maximum(sizes, n)) & (9 * rest >= 4 * (sizes + n))
        met = passed & (self.is_hub[at] != np.repeat(other.hubs[k], found))
        left = np.zeros(len(self.fps), bool)
        left[owner[passed]] = True
        left[owner[met]] = False
        left = np.flatnonzero(left)
        apart = np.abs(self.ranges[left] - other.ranges[k]).sum(axis=1)
        return left[9 * apart <= self.sizes[left] + n]

    def linked(self, at: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Those of the classes ``at`` whose sets are similar to ``tokens``."""
        if not len(at):
            return at
        joined = np.concatenate([self.sets[k] for k in at])
        place = np.minimum(np.searchsorted(tokens, joined), len(tokens) - 1)
        shared = np.add.reduceat((tokens[place] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(self.sizes[at])[:-1]]))
        return at[9 * shared >= 4 * (self.sizes[at] + len(tokens))]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of root, lo, hi: how many rows each class of two blocks links to in the other one."""

    def count(key: tuple, members: list[tuple]) -> pa.RecordBatch:
        sides = [[m[1:] for m in members if m[0] == own] for own in (True, False)]
        fps, links = [], []
        if sides[0] and (key[1] == key[2] or sides[1]):
            one = _Block(sides[0])
            two = one if key[1] == key[2] else _Block(sides[1])
            of_one, of_two = np.zeros(len(one.fps), np.int64), np.zeros(len(two.fps), np.int64)
            for k in range(len(two.fps)):
                near = one.linked(one.candidates(two, k, k if one is two else len(one.fps)), two.sets[k])
                of_one[near] += two.times[k]
                of_two[k] += one.times[near].sum()
            fps, links = one.fps + two.fps, [*of_one.tolist(), *of_two.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(links, pa.int64())], names=["fp", "links"])

    key, group = None, []
    for batch in batches:
        for root, lo, hi, *row in zip(*(batch[c].to_pylist() for c in ("root", "lo", "hi", "own", "fp", "times", "tokens", "prefix", "hub_of")), strict=True):
            if (root, lo, hi) != key:
                if group:
                    yield count(key, group)
                key, group = (root, lo, hi), []
            group.append(row)
    if group:
        yield count(key, group)
    release()


def _links_of(rooted: DataFrame, links: DataFrame, hubs: DataFrame, texts: DataFrame, counters) -> DataFrame:
    """fp, links: with how many rows of other classes a class links. rooted: fp, n, rid, times (its rows), root.

    ``links`` are the verified ones; classes of different roots have no others.
    """
    ends = links.union(links.select("b", "a")).toDF("fp", "other")
    verified = ends.join(rooted.select(F.col("fp").alias("other"), F.col("times").alias("links")), "other").select("fp", "links")

    size = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    more = rooted.join(size.where("members > 2").select("root", blocks.alias("blocks")), "root").select("root", "fp", "times", "blocks", "rid")
    hub_of = hubs.groupBy("fp").agg(F.collect_list("token").alias("hub_of"))  # of its own prefix at most
    more = more.join(hub_of, "fp", "left").withColumn("hub_of", F.coalesce("hub_of", F.array().cast("array<bigint>")))
    sets = _fetched(texts.select("rid", "text"), more.select("rid", "root", "fp", "times", "blocks", "hub_of"))
    sets = sets.mapInArrow(_sets(counters), "root long, fp long, times long, blocks int, hub_of array<bigint>, tokens binary, prefix binary")
    sets = sets.dropDuplicates(["fp"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("root", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), (F.col("block") <= F.col("with")).alias("own"), "fp", "times", "tokens", "prefix", "hub_of")
    met = met.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    return verified.union(met.mapInArrow(_counted, "fp long, links long")).groupBy("fp").agg(F.sum("links").alias("links"))


def _across(others: DataFrame) -> DataFrame:
    """Pairs of a group's members (token, fp, n, pos, root) in different components that pass the filters.

    Groups are dealt in blocks; every two blocks are joined under a key of their own.
    """
    blocks = others.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    dealt = others.join(blocks, "token").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")})
    one = met.where("block = lo").select("token", "lo", "hi", "fp", "n", "pos", "root")
    two = met.where("block = hi").select("token", "lo", "hi", F.col("fp").alias("fp2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("root").alias("root2"))
    once = (F.col("lo") < F.col("hi")) | (F.col("fp") < F.col("fp2"))
    return one.join(two, ["token", "lo", "hi"]).where(once & (F.col("root") != F.col("root2")) & _passes("n", "pos", "n2", "pos2"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, n_links (rows that the row links to), text_hash, component of every row.

    component is the number of the row's group, null without words; text_hash (xxhash64 of the text) and the id name a
    row up to its copies.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = _read(docs, id_col, text_col)
    found = materialize(texts.mapInArrow(_profiles, "id long, text_hash long, rid long, n int, fp long, sig binary, counter int, times long"))
    per_doc = found.where("counter is null").select("id", "text_hash", "rid", "n", "fp", "sig")
    summed = found.where("counter is not null").groupBy("counter").agg(F.sum("times").alias("times")).toPandas()  # COUNTERS rows at most
    counts = np.zeros(COUNTERS, np.uint32)
    counts[summed["counter"].to_numpy(np.int64)] = np.minimum(summed["times"].to_numpy(np.int64), 2**32 - 1)
    counters = spark.sparkContext.broadcast(counts.tobytes())
    rows = materialize(texts.select("text_hash", "text").mapInArrow(_prefixes(counters), "token long, fp long, n int, pos int"))
    key = F.shiftleft(F.least("pos", F.lit(32767)).cast("long"), 48).bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << 48) - 1)))
    # Counting and joining need the same columns, so both read one shuffle.
    dealt = rows.repartition("token")
    shared = dealt.groupBy("token").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max("n").alias("longest")).where("first <> last and longest > 0")
    members = materialize(dealt.join(shared.select("token", "first"), "token").withColumn("hub", F.col("first") == key).drop("first").distinct())

    classes = materialize(per_doc.where("n > 0").groupBy("fp").agg(F.min("id").alias("id"), F.min("rid").alias("rid"), F.first("sig").alias("sig"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times")))
    hubs = members.where("hub").select("token", F.col("fp").alias("fp2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    met = members.where("not hub").join(hubs, "token").where(_passes("n", "pos", "n2", "pos2"))
    links = materialize(_verified(_pairs(met), classes, texts))
    roots = materialize(connected_components(links))

    others = members.where("not hub").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = others.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    others = materialize(others.join(mixed, "token", "left_semi").select("token", "fp", "n", "pos", "root"))
    more = materialize(_verified(_pairs(_across(others)), classes, texts))
    hubbed = roots.toDF("fp", "base")  # components by the hubs' links alone
    if not more.isEmpty():
        roots = materialize(connected_components(roots.toDF("a", "b").union(more)))

    rooted = classes.select("fp", "id", "n", "rid", "times").join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(hubbed, "fp", "left")
    rooted = materialize(rooted.withColumns({"root": F.coalesce("root", "fp"), "base": F.coalesce("base", "fp")}))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    within = rooted.select("fp", "n", "rid", "times", F.col("base").alias("root"))
    linked = materialize(_links_of(within, links.union(more), hubs.select("token", F.col("fp2").alias("fp")), texts, counters))
    named = rooted.join(least, "root").join(linked, "fp", "left")
    named = named.select("fp", "component_id", F.col("root").alias("component"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = per_doc.where("n > 0").join(named, "fp", "left").select("id", "n", "component_id", "n_links", "text_hash", "component")
    out = out.union(per_doc.where("n = 0").select("id", "n", "id", F.lit(0).cast("long"), "text_hash", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links", "text_hash", "component")
