"""Hard negatives by branch and bound over ball trees: rows of another label that score nearly as high as a positive.

1. Rows are quantised and dealt into shards; each shard gets a ball tree: halves of halves along the line between two
   far points, down to LEAF rows. A node keeps its centre, its radius and which labels it has. Trees are written once.
2. Inner products of a query q with all rows of a node lie within q.centre +- |q| radius. For positives (the best of
   the same label) a node goes whose bound lies strictly beneath the query's current k-th, or which lacks the label.
3. For negatives every positive of an anchor opens a window of scores. A node goes where it lies above or below the
   window, or strictly beneath the window's current k-th, for all the anchor's windows, or has no other label.
4. Both searches meet blocks of anchors with trees, one at a time, and merge their lists in a tree (vectors.py).

Defined cases: rows with a null label or vector, or a component that is null or not finite, take no part; an anchor's
id is never its positive, in any of its rows; vectors of other lengths never meet; equal scores go by smaller id, rows
without an id last, and they are no anchors; repeated anchors that are alike in all count once, repeated candidates
each; a negative positive score has an empty window; other columns are ignored, whatever their names; an empty table
gives no rows. Scores are held to 64 bits as in vectors.py.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm import vectors
from lemmaflow.llm.common import materialize, release

LEAF = 128
#: Bounds are widened by this share, far more than doubles round.
SLACK = 1e-9


def _far_axis(points: np.ndarray) -> np.ndarray:
    """The line between the point farthest from the centre and the one farthest from that."""
    first = points[np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1))]
    return points[np.argmax(((points - first) ** 2).sum(axis=1))] - first


def plant(ids: np.ndarray, unnamed: np.ndarray, vectors_: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The order of a shard's rows by leaves (in a leaf by id) and its tree, in pre-order.

    A node: start, end, next (where the node after its subtree is), centre, radius, least and greatest label, and a
    bit for every label modulo 64.
    """
    points, order = vectors_.astype(np.float64), np.arange(len(ids))
    places, numbers, masks, own_labels = [], [], [], []

    def grow(start: int, end: int) -> None:
        node, here = len(places), order[start:end]
        centre = points[here].mean(axis=0)
        radius = np.sqrt(((points[here] - centre) ** 2).sum(axis=1).max())
        places.append([start, end, 0])
        numbers.append(np.append(centre, radius * (1 + SLACK)))
        masks.append(np.bitwise_or.reduce(np.uint64(1) << (labels[here] & 63).astype(np.uint64)))
        own_labels.append([labels[here].min(), labels[here].max()])
        if end - start > LEAF:
            half = (end - start) // 2
            along = np.argpartition(points[here] @ _far_axis(points[here]), half)
            order[start:end] = here[along]
            grow(start, start + half)
            grow(start + half, end)
        else:
            order[start:end] = here[np.lexsort((ids[here], unnamed[here]))]
        places[node][2] = len(places)

    grow(0, len(ids))
    return order, b"".join([np.array(places, np.int32).tobytes(), np.array(own_labels, np.int64).tobytes(), np.array(masks, np.uint64).tobytes(), np.array(numbers).tobytes()])


class Tree:
    """A planted shard."""

    def __init__(self, shard: vectors.Shard):
        dim = shard.vectors.shape[1]
        n = len(shard.tree) // (12 + 16 + 8 + 8 * (dim + 1))
        cuts = np.cumsum([0, 12 * n, 16 * n, 8 * n, 8 * n * (dim + 1)])
        parts = [shard.tree[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.places = np.frombuffer(parts[0], np.int32).reshape(n, 3)
        self.labels = np.frombuffer(parts[1], np.int64).reshape(n, 2)
        self.masks = np.frombuffer(parts[2], np.uint64)
        numbers = np.frombuffer(parts[3]).reshape(n, dim + 1)
        self.centres, self.radii = numbers[:, :-1], numbers[:, -1]

    def children(self, node: int) -> tuple[int, int] | None:
        start, end, after = self.places[node]
        return None if after == node + 1 else (node + 1, self.places[node + 1][2])

    def walk(self, queries: np.ndarray, alive, leaf) -> None:
        """Visits nodes, the nearer child first. ``alive(node, at, low, high)``: which of the queries go on, by the bounds of
        their scores; ``leaf(start, end, at)`` at the leaves."""
        lengths = np.sqrt((queries**2).sum(axis=1))
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, at = todo.pop()
            middle = queries[at] @ self.centres[node]
            spread = lengths[at] * self.radii[node]
            spread += SLACK * (np.abs(middle) + lengths[at] * np.linalg.norm(self.centres[node]) + spread) + 1e-6
            edge = float(1 << 63)
            at = at[alive(node, at, np.clip(middle - spread, -edge, edge), np.clip(middle + spread, -edge, edge))]
            if not len(at):
                continue
            if two := self.children(node):
                nearer = queries[at].mean(axis=0) @ (self.centres[two[0]] - self.centres[two[1]]) > 0
                todo += [(c, at) for c in (two[::-1] if nearer else two)]
            else:
                leaf(self.places[node][0], self.places[node][1], at)


def _tiles(block: vectors.Shard) -> Iterator[np.ndarray]:
    for start in range(0, len(block.ids), vectors.TILE):
        yield np.arange(start, min(start + vectors.TILE, len(block.ids)))


def _positives(k: int):
    """Of each anchor the k best other rows of its label."""

    def search(row: dict):
        block = vectors.Shard(row)
        best = vectors.Best(len(block.ids), k)
        bits = np.uint64(1) << (block.labels & 63).astype(np.uint64)

        def meet(shard: vectors.Shard) -> None:
            if shard.vectors.shape[1] != block.vectors.shape[1]:
                return
            tree = Tree(shard)
            for tile in _tiles(block):

                def alive(node, at, low, high, tile=tile):
                    own = tile[at]
                    has = (tree.masks[node] & bits[own] != 0) & (tree.labels[node][0] <= block.labels[own]) & (block.labels[own] <= tree.labels[node][1])
                    return has & (high >= best.least[own])

                def leaf(start, end, at, tile=tile):
                    own, rows = tile[at], slice(start, end)
                    scores = vectors.products(block.vectors[own], shard.vectors[rows])
                    barred = (block.labels[own][:, None] != shard.labels[rows]) | ((block.ids[own][:, None] == shard.ids[rows]) & ~shard.unnamed[rows])
                    scores[barred] = vectors.LOW
                    best.offer(own, scores, shard.ids[rows], shard.unnamed[rows])

                tree.walk(block.vectors[tile].astype(np.float64), alive, leaf)

        return best, meet

    return search


def _window(scores: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score: ``share`` percent of the positive's, and all of it; none where that is LOW."""
    low = np.array([-(-share * int(s) // 100) for s in scores.ravel()], np.int64).reshape(scores.shape)
    return np.where(scores > vectors.LOW, low, 0), np.where(scores > vectors.LOW, scores, -1)


def _negatives(k: int, n_positives: int, share: int):
    """Of each anchor's positives the k best rows of another label in its window; lists by anchor, then positive."""

    def search(row: dict):
        block = vectors.Shard(row)
        lows, highs = _window(np.frombuffer(row["positive_scores"], np.int64).reshape(-1, n_positives), share)
        best = vectors.Best(len(block.ids) * n_positives, k)
        windows = range(n_positives)

        def meet(shard: vectors.Shard) -> None:
            if shard.vectors.shape[1] != block.vectors.shape[1]:
                return
            tree = Tree(shard)
            for tile in _tiles(block):

                def alive(node, at, low, high, tile=tile):
                    own = tile[at]
                    other = (tree.labels[node][0] != tree.labels[node][1]) | (block.labels[own] != tree.labels[node][0])
                    least = np.maximum(lows[own], best.least.reshape(-1, n_positives)[own])
                    return other & ((high[:, None] >= least) & (low[:, None] <= highs[own]) & (lows[own] <= highs[own])).any(axis=1)

                def leaf(start, end, at, tile=tile):
                    own, rows = tile[at], slice(start, end)
                    scores = vectors.products(block.vectors[own], shard.vectors[rows])
                    scores[block.labels[own][:, None] == shard.labels[rows]] = vectors.LOW
                    for w in windows:
                        inside = np.where((scores >= lows[own, w][:, None]) & (scores <= highs[own, w][:, None]), scores, vectors.LOW)
                        best.offer(own * n_positives + w, inside, shard.ids[rows], shard.unnamed[rows])

                tree.walk(block.vectors[tile].astype(np.float64), alive, leaf)

        return best, meet

    return search


def _rows(k: int, n_positives: int):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                best, anchors = vectors.best_of(row, k), np.frombuffer(row["anchors"], np.int64)
                positives = [np.frombuffer(row[f"positive_{c}"], t) for c, t in (("ids", np.int64), ("unnamed", np.bool_), ("scores", np.int64))]
                pair, place = np.nonzero(best.scores > vectors.LOW)
                ids, unnamed, scores = (p[pair] for p in positives)
                columns = [anchors[pair // n_positives], pa.array(ids, mask=unnamed), (place + 1).astype(np.int32), pa.array(best.ids[pair, place], mask=best.unnamed[pair, place]), scores, best.scores[pair, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
        release()

    return rows


def hard_negatives(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, share: int = 80, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score; ``anchors`` has the columns of ``rows``.

    Negatives score at least ``share`` percent of the positive and at most as much as it.
    """

    def read(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
        return own.where("label is not null")

    trees = vectors.packed(read(rows), scale, plant)
    blocks = vectors.blocks_of_queries(read(anchors).where("id is not null"), scale)
    found = vectors.grid(blocks, trees, _positives(n_positives), n_positives)
    found = found.select("group", *[F.col(c).alias(f"positive_{c}") for c in ("ids", "unnamed", "scores")])
    known = materialize(blocks.join(found, "group"))
    mined = vectors.grid(known.drop("positive_ids", "positive_unnamed"), trees, _negatives(n_negatives, n_positives, share), n_negatives)
    both = mined.join(known.select("group", F.col("ids").alias("anchors"), "positive_ids", "positive_unnamed", "positive_scores"), "group")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return materialize(both.mapInArrow(_rows(n_negatives, n_positives), out))
