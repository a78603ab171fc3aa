"""Integer vectors in shards, and jobs that meet every block of queries with every shard.

Vectors are quantised to whole numbers and packed: a row of a packed table is a shard of at most SHARD vectors of one
length, ordered by id. Queries are packed alike, in blocks of BLOCK, and dealt in slots of SLOT. A task of the grid holds
one slot and one shard at a time and keeps the best of each query; lists of several tasks are merged in a tree. So
neither side is ever held whole, and the shards are copied as often as there are slots.

Scores are whole numbers of 64 bits; larger ones count as the largest or the smallest such number.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import materialize, release

SHARD = 4096
BLOCK = 1 << 14
SLOT = 1 << 16
#: A shard has at most so many components, whatever its vectors' length.
COMPONENTS = 1 << 20
#: Queries whose products with a shard are held at once.
TILE = 512
#: Shards that a task of a large grid reads one after another, and lists that are merged at once.
RUN = 16
FAN = 8
LOW = np.iinfo(np.int64).min
#: Components are held to this size either way.
MOST = 1 << 62
PACKED = "dim int, ids binary, unnamed binary, labels binary, width int, vectors binary, tree binary"
LISTS = "group long, part long, scores binary, ids binary, unnamed binary"
WIDTHS = {2: np.int16, 4: np.int32, 8: np.int64}


class Shard:
    """A packed row, unpacked."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.unnamed = np.frombuffer(row["unnamed"], np.bool_)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], WIDTHS[row["width"]]).reshape(len(self.ids), row["dim"])
        self.tree = row["tree"]


def _quantised(matrix: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(matrix * float(scale)), -MOST, MOST).astype(np.int64)


def _rows_of(batch: pa.RecordBatch, scale: int) -> Iterator[tuple]:
    """dim and, by row, id, unnamed, label, vector: of the rows whose vectors are whole and finite."""
    vectors, held = batch["vector"], np.flatnonzero(~np.asarray(batch["vector"].is_null().to_numpy(zero_copy_only=False), bool))
    ends = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    sizes = (ends[1:] - ends[:-1])[held]
    ids, labels = (batch[c].fill_null(0).to_numpy() for c in ("id", "label"))
    unnamed = batch["id"].is_null().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        rows = held[sizes == dim]
        matrix = values[ends[rows][:, None] + np.arange(dim)]
        whole = np.isfinite(matrix).all(axis=1)
        rows = rows[whole]
        if len(rows):
            yield int(dim), ids[rows], unnamed[rows], labels[rows], _quantised(matrix[whole], scale)


def _packer(scale: int, shard: int, plant: Callable | None):
    def pack(dim: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, unnamed, labels, vectors = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order, tree = plant(ids, unnamed, vectors, labels) if plant else (np.lexsort((ids, unnamed)), b"")
        ids, unnamed, labels, vectors = ids[order], unnamed[order], labels[order], vectors[order]
        top = int(np.abs(vectors).max(initial=0))
        width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
        values = [dim, ids.tobytes(), unnamed.tobytes(), labels.tobytes(), width, vectors.astype(WIDTHS[width]).tobytes(), tree]
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}
        for batch in batches:
            for dim, *columns in _rows_of(batch, scale):
                most = max(1, min(shard, COMPONENTS // max(dim, 1)))
                at = 0
                while at < len(columns[0]):
                    own = waiting.setdefault(dim, [])
                    room = most - sum(len(p[0]) for p in own)
                    own.append(tuple(c[at : at + room] for c in columns))
                    at += room
                    if sum(len(p[0]) for p in own) == most:
                        yield pack(dim, waiting.pop(dim))
        for dim, parts in waiting.items():
            yield pack(dim, parts)
        release()

    return packed


def packed(rows: DataFrame, scale: int, plant: Callable | None = None, shard: int | None = None) -> DataFrame:
    """The rows (id: long, label: long, vector: array of doubles) in shards; written. ``plant``: order and index of a shard."""
    return materialize(rows.select("id", "label", "vector").mapInArrow(_packer(scale, shard or SHARD, plant), PACKED))


def blocks_of_queries(rows: DataFrame, scale: int) -> DataFrame:
    """Packed blocks of distinct queries, with a number for each (group), in slots numbered from 0; written."""
    queries = rows.select("id", "label", "vector").dropDuplicates()
    n = max(1, -(-queries.count() // SLOT))
    dealt = queries.repartition(n).mapInArrow(_packer(scale, BLOCK, None), PACKED)
    return materialize(dealt.select("*", F.monotonically_increasing_id().alias("group"), F.spark_partition_id().alias("slot")))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two whole-number matrices, held to 64 bits."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 1 << 53:  # every sum is exact in doubles
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), LOW + 1, -(LOW + 1)).astype(np.int64)


class Best:
    """Of each query its k highest scores, ties to smaller ids, rows without an id last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids, self.unnamed = np.full((n, k), LOW), np.zeros((n, k), np.int64), np.zeros((n, k), np.bool_)

    @property
    def least(self) -> np.ndarray:
        """The score that a query's row must reach to count."""
        return self.scores[:, -1]

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        """Rows (ordered by id) for the queries ``at``; LOW where a row is no candidate."""
        some = scores.max(axis=1, initial=LOW) >= np.maximum(self.least[at], LOW + 1)
        at, scores = at[some], scores[some]
        if not len(at):
            return
        if scores.shape[1] > self.k:
            # Partial selection: all above the k-th score, and of those equal to it the first ones.
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k, None]
            above, equal = scores > kth, scores == kth
            picked = above | (equal & (np.cumsum(equal, axis=1) <= self.k - above.sum(axis=1)[:, None]))
            columns = np.nonzero(picked)[1].reshape(len(at), self.k)
        else:
            columns = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        self.merge(at, np.take_along_axis(scores, columns, axis=1), ids[columns], unnamed[columns])

    def merge(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        scores, ids, unnamed = (np.concatenate([own[at], new], axis=1) for own, new in ((self.scores, scores), (self.ids, ids), (self.unnamed, unnamed)))
        order = np.lexsort((ids, unnamed, ~scores), axis=-1)[:, : self.k]  # ~ turns the order round
        self.scores[at], self.ids[at], self.unnamed[at] = (np.take_along_axis(x, order, axis=1) for x in (scores, ids, unnamed))

    def row(self, group: int, part: int) -> list:
        return [group, part, self.scores.tobytes(), self.ids.tobytes(), self.unnamed.tobytes()]


def best_of(row: dict, k: int) -> Best:
    out = Best(0, k)
    for name, kind in (("scores", np.int64), ("ids", np.int64), ("unnamed", np.bool_)):
        setattr(out, name, np.frombuffer(row[name], kind).reshape(-1, k).copy())
    return out


def _written(rows: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in LISTS.split(", ")])


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def grid(blocks: DataFrame, shards: DataFrame, search: Callable, k: int) -> DataFrame:
    """LISTS: of each block (group) the k best of every list, by ``search(block row) -> (Best, meet)``, ``meet(Shard)``.

    A block has as many lists a query as its search likes. Shards are copied once for each slot of blocks, blocks once
    for each part of the shards; parts are runs of shards on a large grid and single shards on a small one.
    """
    slots = (blocks.agg(F.max("slot")).first()[0] or 0) + 1
    n_shards, parallel = max(1, shards.count()), blocks.sparkSession.sparkContext.defaultParallelism
    parts = min(n_shards, max(-(-n_shards // RUN), -(-4 * parallel // slots)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = [c.split()[0] for c in PACKED.split(", ")]
    extra = [c for c in blocks.columns if c not in ("group", "slot", *names)]
    left = blocks.select("slot", every(parts).alias("part"), F.lit(0).alias("side"), "group", *names, *extra)
    none = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in extra]
    part = F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part")
    right = shards.select(every(slots).alias("slot"), part, F.lit(1).alias("side"), F.lit(0).cast("long").alias("group"), *names, *none)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for row in _one_by_one(batches):
            if (row["slot"], row["part"]) != key:
                yield from (_written([best.row(*at)]) for at, best, _ in held)
                key, held = (row["slot"], row["part"]), []
            if row["side"]:
                shard = Shard(row)
                for _, _, meet in held:
                    meet(shard)
            else:
                held.append(((row["group"], row["part"]), *search(row)))
        yield from (_written([best.row(*at)]) for at, best, _ in held)
        release()

    both = left.union(right).repartition(slots * parts, "slot", "part").sortWithinPartitions("slot", "part", "side")
    return merged(materialize(both.mapInArrow(met, LISTS)), parts, k)


def merged(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """One row of LISTS for each group: FAN lists meet at a time, level by level."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, None
        for row in _one_by_one(batches):
            own = best_of(row, k)
            if (row["group"], row["part"]) != key:
                if best is not None:
                    yield _written([best.row(*key)])
                key, best = (row["group"], row["part"]), own
            else:
                best.merge(np.arange(len(own.scores)), own.scores, own.ids, own.unnamed)
        if best is not None:
            yield _written([best.row(*key)])
        release()

    while parts > 1:
        parts = -(-parts // FAN)
        up = lists.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        lists = up.repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(meet, LISTS)
    return lists


def is_every(id_col: str, step: int) -> Column:
    """Rows whose id is divisible by ``step``."""
    return F.coalesce(F.col(id_col) % step == 0, F.lit(False))
