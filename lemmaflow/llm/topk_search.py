"""Exact top-k search: the rows of highest inner product for each query, by tiled matrix products.

Vectors are quantised and packed into shards, queries into blocks (vectors.py). A task multiplies a block with one
shard after another, TILE queries at a time; of each tile only the k best of each query are kept (partial selection),
and per-query lists of several tasks are merged in a tree.

Defined cases: rows whose vector is null or holds a null or a value that isn't finite take no part; a query's id is no
candidate of it, in any of its rows; vectors of other lengths are no candidates; equal scores go by smaller id, rows
without an id come last and are no queries; repeated queries that are alike in id and vector count once, repeated
candidates each; other columns are ignored, whatever their names; an empty table gives no rows. Components beyond 2^62
count as 2^62, scores beyond 64 bits as the largest or smallest such number.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm import vectors
from lemmaflow.llm.common import materialize, release


def _search(k: int):
    def search(row: dict):
        block = vectors.Shard(row)
        best = vectors.Best(len(block.ids), k)

        def meet(shard: vectors.Shard) -> None:
            if shard.vectors.shape[1] != block.vectors.shape[1]:
                return
            for start in range(0, len(block.ids), vectors.TILE):
                at = np.arange(start, min(start + vectors.TILE, len(block.ids)))
                scores = vectors.products(block.vectors[at], shard.vectors)
                scores[(block.ids[at][:, None] == shard.ids) & ~shard.unnamed] = vectors.LOW
                best.offer(at, scores, shard.ids, shard.unnamed)

        return best, meet

    return search


def _rows(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                best, ids = vectors.best_of(row, k), np.frombuffer(row["queries"], np.int64)
                query, place = np.nonzero(best.scores > vectors.LOW)
                columns = [pa.array(ids[query]), pa.array((place + 1).astype(np.int32)), pa.array(best.ids[query, place], mask=best.unnamed[query, place]), pa.array(best.scores[query, place])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "rank", "vec_id", "score"])
        release()

    return rows


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of ``rows`` for each row of ``queries`` (the same columns)."""
    read = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    blocks = vectors.blocks_of_queries(read(queries).where("id is not null"), scale)
    lists = vectors.grid(blocks, vectors.packed(read(rows), scale), _search(k), k)
    found = lists.join(blocks.select("group", F.col("ids").alias("queries")), "group")
    return materialize(found.mapInArrow(_rows(k), "query_id long, rank int, vec_id long, score long"))
