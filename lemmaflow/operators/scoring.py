"""Selection, prefilter, shortlists, fusion and score requests."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions import scores, text


def select_batch(clauses: DataFrame, requested: DataFrame, n_context: int = 128, n_candidates: int = 128) -> DataFrame:
    """problem, clause_id, role (conjecture, context, candidate), rank. requested: problem, clause_id, pos.

    The conjecture is the first registered clause of distance 0; a limit of 0 still gives one row.
    """
    first = F.row_number().over(Window.partitionBy("problem").orderBy("ord"))
    conjecture = clauses.where("conj_dist = 0").withColumn("rank", first).where("rank = 1").select("problem", "clause_id", F.lit("conjecture").alias("role"), "rank")
    wanted = requested.groupBy("problem", "clause_id").agg(F.min("pos").alias("pos"))
    rest = clauses.join(conjecture.select("problem", "clause_id"), ["problem", "clause_id"], "left_anti")
    context = rest.join(wanted, ["problem", "clause_id"], "left_anti").withColumn("rank", first).where(F.col("rank") <= max(n_context, 1))
    by_request = F.row_number().over(Window.partitionBy("problem").orderBy("pos"))
    candidates = rest.join(wanted, ["problem", "clause_id"]).withColumn("rank", by_request).where(F.col("rank") <= max(n_candidates, 1))
    names = ["problem", "clause_id"]
    return conjecture.union(context.select(*names, F.lit("context"), "rank")).union(candidates.select(*names, F.lit("candidate"), "rank"))


def with_roles(clauses: DataFrame, n_context: int = 128, n_candidates: int = 128) -> DataFrame:
    """``clauses`` with the role and rank of ``select_batch``, null for those that aren't taken; all in one shuffle by problem.

    clauses: problem and clause_id, a row for each, ord, conj_dist, asked (whether a request names the clause) and pos, its
    place there. A clause without id is no conjecture, and what has no problem or id is to be left out of what is taken.
    """
    best = F.min(F.when((F.col("conj_dist") == 0) & F.col("clause_id").isNotNull(), F.struct("ord", "clause_id"))).over(Window.partitionBy("problem"))
    own = clauses.withColumn("role", F.when(F.col("clause_id") == best["clause_id"], "conjecture").when(F.col("asked"), "candidate").otherwise("context"))
    rank = F.row_number().over(Window.partitionBy("problem", "role").orderBy(F.when(F.col("role") == "candidate", F.col("pos")).otherwise(F.col("ord"))))
    most = F.when(F.col("role") == "conjecture", 1).when(F.col("role") == "context", max(n_context, 1)).otherwise(max(n_candidates, 1))
    taken = F.col("rank") <= most
    return own.withColumn("rank", rank).withColumns({"role": F.when(taken, F.col("role")), "rank": F.when(taken, F.col("rank"))})


def kept_by_arguments(n: Column, drop: float | None, least: int | None, most: int | None) -> Column:
    k = F.bround(n * (1.0 - min(1.0, max(0.0, drop)))).cast("int") if drop is not None else n
    k = F.greatest(k, F.lit(least)) if least is not None else k
    k = F.least(k, F.lit(most)) if most is not None else k
    return F.greatest(F.lit(0), F.least(n, k))


def reasoning_tags(clauses: DataFrame, target_functor: Column, first_const: Column, goal_consts: Column, formula: str = "formula") -> DataFrame:
    """``clauses`` with touches, first_arg, shared (array) against a conjecture's targets; for flat canonical literals."""
    f = F.col(formula)
    return clauses.withColumns(
        {
            "touches": F.contains(f, F.concat(target_functor, F.lit("("))),
            "first_arg": F.contains(f, F.concat(target_functor, F.lit("("), first_const)) & ~F.contains(f, F.concat(F.lit("~"), target_functor, F.lit("("), first_const)),
            "shared": F.array_sort(F.array_intersect(text.constants(f), goal_consts)),
        }
    )


def prefilter(candidates: DataFrame, by: str = "problem", drop: float | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """The best of each group by prio, then larger id. Needs equation, touches, first_arg, n_shared, formula, clause_id."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    own = drop is not None or least is not None or most is not None
    k = kept_by_arguments(n, drop, least, most) if own else scores.budget(n)[1]
    unit = ~F.contains("formula", F.lit("|"))
    prio = scores.priority(F.col("equation"), F.col("touches"), F.col("first_arg"), F.col("n_shared"), unit, text.token_weight(F.col("formula")))
    ranked = candidates.withColumn("prio", prio).withColumn("k", k)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("prio"), F.desc("clause_id")))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= F.col("k"))


def answer_requests(requests: DataFrame, scored: DataFrame, default: float = 0.0) -> DataFrame:
    """requests: request_id, clause_ids (array). One row per request with scores in its order and n_missing."""
    ids = requests.select("request_id", F.posexplode("clause_ids").alias("pos", "clause_id"))
    joined = ids.join(scored.select("clause_id", "score"), "clause_id", "left")
    return joined.groupBy("request_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("score", F.lit(default)).alias("s")))), lambda x: x["s"]).alias("scores"),
        F.count_if(F.col("score").isNull()).alias("n_missing"),
    )


def floor_overlay(ids: DataFrame, selected: DataFrame, floor: float = 0.02) -> DataFrame:
    return ids.join(selected.select("clause_id", "score"), "clause_id", "left").withColumn("score", F.coalesce("score", F.lit(floor)))


def fuse(ids: DataFrame, sources: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum of sources (source, id, score); weights (source, weight) are scaled to sum 1, missing scores are 0."""
    share = weights.crossJoin(weights.agg(F.sum("weight").alias("total"))).select("source", (F.col("weight") / F.col("total")).alias("share"))
    summed = sources.join(share, "source").groupBy("id").agg(F.sum(F.col("share") * F.col("score")).alias("score"))
    return ids.join(summed, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def shortlist(scored: DataFrame, k: int, by: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "pos"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


class _Vectors:
    """An Arrow column of vectors: sizes (-1 where it is null or holds a null), and all components of one size as columns."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.list_(pa.float64()))
        self.sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy().astype(np.int64)
        if column.flatten().null_count:
            holes = np.unique(pc.list_parent_indices(column).to_numpy()[np.asarray(column.flatten().is_null())])
            self.sizes[holes] = -1
        self.at = {int(n): np.flatnonzero(self.sizes == n) for n in np.unique(self.sizes) if n >= 0}
        flat = lambda at: (column if len(at) == len(column) else column.take(pa.array(at))).flatten()
        self.columns = {n: np.asarray(flat(at)).reshape(len(at), n).T.copy() for n, at in self.at.items()}


def _products(queries: _Vectors, rows: _Vectors) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries and of rows, and their products. Sums go component by component, so that none depends on the block."""
    for n, at in queries.at.items():
        met = rows.at.get(n, np.zeros(0, np.int64))
        for i in range(0, len(at), TILE[0]):
            for j in range(0, len(met), TILE[1]):
                q, v = queries.columns[n][:, i : i + TILE[0]], rows.columns[n][:, j : j + TILE[1]]
                total = np.zeros((q.shape[1], v.shape[1]))
                term = np.empty_like(total)
                for x, y in zip(q, v, strict=True):
                    total += np.multiply(x[:, None], y[None, :], out=term)
                yield at[i : i + TILE[0]], met[j : j + TILE[1]], total
        odd = np.flatnonzero(rows.sizes != n)
        if len(odd):
            yield from ((at[i : i + 1], odd, np.full((1, len(odd)), np.nan)) for i in range(len(at)))
    nameless = np.flatnonzero(queries.sizes < 0)
    yield from ((nameless[i : i + 1], np.arange(len(rows.sizes)), np.full((1, len(rows.sizes)), np.nan)) for i in range(len(nameless)))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds doubles; what is too large for that stays."""
    with np.errstate(all="ignore"):
        scaled = x * 10.0**digits
        whole, known = np.trunc(scaled), np.isfinite(scaled)
        scaled -= whole
        whole += np.trunc(2.0 * scaled)
        whole /= 10.0**digits
    return (whole if known.all() else np.where(known, whole, x)) + 0.0


#: Queries and rows whose products are held at once.
TILE = (16, 4096)


def dot_pairs(queries: DataFrame, rows: DataFrame, query_vector: str, row_vector: str, digits: int | None = None, block: int = 4096, part: int = 65_536) -> DataFrame:
    """Every query with every row: the other columns of both, and score, the vectors' dot product; rounded, with ``digits``.

    Null where a vector or a component is null, or lengths differ. A task meets cells of about ``block`` queries, which it
    holds, with ``part`` rows, which pass; there are as many cells as keep all cores busy.
    """
    n_queries, n_rows = queries.count(), rows.count()
    blocks, cores = max(1, -(-n_queries // block)), queries.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n_rows // part), min(-(-8 * cores // blocks), -(-n_rows // 256)))
    own, met = ([c for c in df.columns if c != v] for df, v in ((queries, query_vector), (rows, row_vector)))
    deal = lambda names, n: F.pmod(F.xxhash64(*names), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(*own, F.col(query_vector).cast("array<double>").alias("_v"), deal(own, blocks).alias("_block"), every(parts).alias("_part"), F.lit(0).alias("_side"))
    right = rows.select(*met, F.col(row_vector).cast("array<double>").alias("_v"), deal(met, parts).alias("_part"), every(blocks).alias("_block"), F.lit(1).alias("_side"))
    cell = (F.col("_block") * parts + F.col("_part")).alias("_cell")
    both = left.unionByName(right, allowMissingColumns=True).select(*own, *met, "_v", "_side", cell)
    kinds = {**dict(queries.dtypes), **dict(rows.dtypes)}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (*own, *met)] + ["score double"] + ["rounded double"] * (digits is not None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            cells, sides = (batch[c].to_numpy() for c in ("_cell", "_side"))
            edges = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1), len(cells)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if cells[a] != now:
                    now, held = cells[a], []
                some = batch.slice(a, b - a)
                if not sides[a]:
                    held.append(([some[c] for c in own], _Vectors(some["_v"])))
                    continue
                vectors, columns = _Vectors(some["_v"]), [some[c] for c in met]
                for named, asked in held:
                    for i, j, scores in _products(asked, vectors):
                        at, to = pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i)))
                        unknown = np.repeat(asked.sizes[i], len(j)) != np.tile(vectors.sizes[j], len(i)) if np.isnan(scores).any() else None
                        if unknown is not None:
                            unknown |= np.repeat(asked.sizes[i] < 0, len(j))
                        flat = [scores.ravel()] + ([rounded(scores.ravel(), digits)] if digits is not None else [])
                        arrays = [*[c.take(at) for c in named], *[c.take(to) for c in columns], *[pa.array(x, pa.float64(), mask=unknown) for x in flat]]
                        yield pa.RecordBatch.from_arrays(arrays, names=[*own, *met, "score", "rounded"][: len(arrays)])

    return both.repartition(blocks * parts, "_cell").sortWithinPartitions("_cell", "_side").mapInArrow(run, schema)


#: One row for each query, part of the rows and hit: how many pairs, their ids and scores, and the best of these.
LISTS = "query_id bigint, part int, hit boolean, n int, ids array<bigint>, scores array<double>, best_ids array<bigint>, best_scores array<double>"


def _lists(named: np.ndarray, part: int, hit: bool, mask: np.ndarray, ids: np.ndarray, values: np.ndarray, unknown: np.ndarray, k: int) -> pa.RecordBatch:
    """LISTS of the pairs in ``mask`` (queries by rows), of queries that have any."""
    n = mask.sum(axis=1)
    q, r = np.nonzero(mask)
    score, null = values[q, r], unknown[q, r]
    # The least key is best: nulls are last, and what is no number comes first, as Spark and SQL sort.
    odd = np.where(null, 2, np.where(np.isnan(score), 0, 1)).astype(np.int8)
    key = np.where(odd == 1, -score, np.where(odd == 0, -np.inf, np.inf))
    near = np.ones(len(q), bool)
    if mask.shape[1] > k:
        wide = np.full(mask.shape, np.inf)
        wide[q, r] = key
        near = key <= np.partition(wide, k - 1, axis=1)[q, k - 1]
    at = np.flatnonzero(near)
    at = at[np.lexsort((ids[r[at]], odd[at], key[at], q[at]))]
    met = np.bincount(q[at], minlength=len(n))
    at = at[np.arange(len(at)) - np.repeat(np.cumsum(met) - met, met) < k]
    has = np.flatnonzero(n)
    cut = lambda sizes, column: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), column)
    lists = [cut(s[has], c) for s, i in ((n, slice(None)), (np.minimum(met, k), at)) for c in (pa.array(ids[r[i]]), pa.array(score[i], pa.float64(), mask=null[i]))]
    names = [f.split()[0] for f in LISTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(named[has]), pa.array(np.full(len(has), part, np.int32)), pa.array([hit] * len(has), pa.bool_()), pa.array(n[has].astype(np.int32)), *lists], names=names)


def dot_lists(queries: DataFrame, rows: DataFrame, kept: DataFrame, parts: int, k: int, digits: int, block: int = 256) -> DataFrame:
    """LISTS: the rounded dot product of every query (query_id, vector) and row (id, vector), and each list's ``k`` best.

    ``kept``: query_id, part, ids, scores of pairs that have a score, dealt to as many ``parts``; only where some query of
    a block has none, a row's products are computed. Null as in ``dot_pairs``. A task meets one cell of ``block`` queries
    and a part of the rows at a time.
    """
    blocks = max(1, -(-queries.count() // block))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("_block").cast("long") * parts + F.col("part")).alias("_cell")
    vector = F.col("vector").cast("array<double>").alias("vector")
    left = queries.select(F.col("query_id").cast("bigint").alias("id"), vector, deal("query_id", blocks).alias("_block"), every(parts).alias("part"), F.lit(0).alias("side"))
    right = rows.select(F.col("id").cast("bigint").alias("id"), vector, every(blocks).alias("_block"), deal("id", parts).alias("part"), F.lit(1).alias("side"))
    both = left.unionByName(right).select(cell, "id", "vector", "side", "part")
    known = kept.withColumn("_block", deal("query_id", blocks)).select(cell, "query_id", "ids", "scores")

    def run(given: pa.Table, had: pa.Table) -> pa.Table:
        given, had = given.combine_chunks(), had.combine_chunks()
        side = given["side"].to_numpy() if len(given) else np.zeros(0)
        asked, passed = (given.take(pa.array(np.flatnonzero(side == i))) for i in (0, 1))
        if not len(asked) or not len(passed):
            return pa.Table.from_batches([], schema=empty)
        named, ids, part = asked["id"].to_numpy(), passed["id"].to_numpy(), given["part"][0].as_py()
        hit, unknown, values = np.zeros((len(named), len(ids)), bool), np.zeros((len(named), len(ids)), bool), np.full((len(named), len(ids)), np.nan)
        if len(had):
            one, own = np.unique(named, return_inverse=True)
            each, place = np.unique(ids, return_inverse=True)
            lists, scores = had["ids"].combine_chunks(), had["scores"].combine_chunks().flatten()
            q, i = np.repeat(had["query_id"].to_numpy(), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            x, y = np.minimum(np.searchsorted(one, q), len(one) - 1), np.minimum(np.searchsorted(each, i), len(each) - 1)
            met = (one[x] == q) & (each[y] == i)
            x, y = x[met], y[met]
            known_at, score_at, null_at = np.zeros((len(one), len(each)), bool), np.full((len(one), len(each)), np.nan), np.zeros((len(one), len(each)), bool)
            known_at[x, y], score_at[x, y], null_at[x, y] = True, scores.to_numpy(zero_copy_only=False)[met], np.asarray(scores.is_null())[met]
            hit, values, unknown = (m[np.ix_(own, place)] for m in (known_at, score_at, null_at))
        new = np.flatnonzero(~hit.all(axis=0))
        if len(new):
            vectors, others = _Vectors(asked["vector"].combine_chunks()), _Vectors(passed["vector"].combine_chunks().take(pa.array(new)))
            for i, j, total in _products(vectors, others):
                at = np.ix_(i, new[j])
                none = (vectors.sizes[i][:, None] != others.sizes[j][None, :]) | (vectors.sizes[i] < 0)[:, None]
                fresh = ~hit[at]
                values[at] = np.where(fresh, rounded(total, digits), values[at])
                unknown[at] = np.where(fresh, none, unknown[at])
        return pa.Table.from_batches([_lists(named, part, h, mask, ids, values, unknown, k) for h, mask in ((True, hit), (False, ~hit)) if mask.any()], schema=empty)

    listed = pa.list_(pa.int64()), pa.list_(pa.float64())
    empty = pa.schema(list(zip([f.split()[0] for f in LISTS.split(", ")], [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), *listed, *listed], strict=True)))
    tasks = min(blocks * parts, 4 * queries.sparkSession.sparkContext.defaultParallelism)
    pairs = both.repartition(tasks, "_cell").groupBy("_cell").cogroup(known.repartition(tasks, "_cell").groupBy("_cell"))
    return pairs.applyInArrow(run, LISTS)


#: Pairs whose products a task of ``dot_blocks`` holds, rows that reach it at once, and pairs that leave it at once.
HELD, CHUNK, SENT = 1 << 24, 4096, 1 << 16


@dataclass
class Pairs:
    """All pairs of the queries of one id, a query after the other: ``own`` has the queries' places.

    ``order`` has the pairs by the row's id, ``place`` a pair's place there.
    """

    own: np.ndarray
    exact: np.ndarray
    score: np.ndarray
    unknown: np.ndarray
    order: np.ndarray
    place: np.ndarray
    digits: int

    def best(self, some: np.ndarray | slice = slice(None), k: int | None = None) -> np.ndarray:
        """Of ``some`` pairs the ``k`` of highest score, or all, by score and row: NaN is first and null last, as Spark and SQL sort."""
        score, unknown, place = self.score[some], self.unknown[some], self.place[some]
        bits = len(self.place).bit_length()
        with np.errstate(all="ignore"):
            whole = np.rint(score * 10.0**self.digits)
        if unknown.any() or not np.abs(whole).max(initial=0) < 2.0 ** min(50, 62 - bits):
            odd = np.where(unknown, 2, np.where(np.isnan(score), 0, 1))
            return self.order[place[np.lexsort((place, -score, odd))[:k]]]
        key = (whole.astype(np.int64) * -(1 << bits)) + place  # score and place in one number
        if k is not None and k < len(key):
            key = np.partition(key, k - 1)[:k] if k else key[:0]
        key.sort()
        return self.order[key & ((1 << bits) - 1)]


class Block:
    """Some queries that meet all rows, a chunk at a time; columns but the vectors as tables."""

    def __init__(self, queries: pa.Table):
        self.queries, self.asked = queries.drop_columns("_v").combine_chunks(), _Vectors(queries["_v"].combine_chunks())
        self.chunks, self.sizes, self.products = [], [], []

    def meet(self, rows: pa.Table) -> None:
        vectors = _Vectors(rows["_v"].combine_chunks())
        products = np.full((len(self.asked.sizes), len(rows)), np.nan)
        for i, j, total in _products(self.asked, vectors):
            products[np.ix_(i, j)] = total
        self.products.append(products)
        self.sizes.append(vectors.sizes)
        self.chunks.append(rows.drop_columns("_v").take(pa.array(np.arange(len(rows)))))  # copied, as chunks go

    def end(self) -> None:
        self.rows, self.sizes = pa.concat_tables(self.chunks).combine_chunks(), np.concatenate(self.sizes)

    def pairs(self, query_id: str, row_id: str, digits: int) -> Iterator[Pairs]:
        """By query's id; rows without id come last, as SQL sorts."""
        by_id = pc.array_sort_indices(self.rows[row_id].combine_chunks(), null_placement="at_end").to_numpy().astype(np.int64)
        named = pc.dictionary_encode(self.queries[query_id].combine_chunks(), null_encoding="encode").indices.to_numpy()
        for n in range(named.max(initial=-1) + 1):
            own = np.flatnonzero(named == n)
            parts = [products[i] for i in own for products in self.products]
            size = self.asked.sizes[own][:, None]
            unknown = ((self.sizes[None, :] != size) | (size < 0)).ravel()
            order = (by_id[:, None] + np.arange(len(own)) * len(by_id)).ravel()
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            yield Pairs(own, np.concatenate(parts), np.concatenate([rounded(x, digits) for x in parts]), unknown, order, place, digits)


def dot_blocks(queries: DataFrame, rows: DataFrame, query_id: str, query_vector: str, row_vector: str, run: Callable[[Block], Iterator[pa.RecordBatch]], schema: str, held: int = HELD, block: int = 64) -> DataFrame:
    """``run`` of each block of queries once it has met all rows, so what needs all pairs of a query needs no shuffle of pairs.

    Rows are shuffled once, in chunks, and each task reads all of them as they pass; queries are dealt by id, about ``block``
    to a task, or as few as have ``held`` pairs. Null as in ``dot_pairs``.
    """
    n_queries, n_rows = queries.count(), rows.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n_queries // block), -(-n_queries * n_rows // held), min(4 * cores, -(-n_queries // 8)))
    blocks = max(1, min(blocks, n_queries))

    def sided(df: DataFrame, name: str) -> DataFrame:
        vector = F.col(name) if dict(df.dtypes)[name] == "array<float>" else F.col(name).cast("array<double>")
        return df.select(*[c for c in df.columns if c != name], vector.alias("_v"))

    def packed(table: pa.Table) -> bytes:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        return out.getvalue().to_pybytes()

    def pack_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if len(b)]
        if some:
            table = pa.Table.from_batches(some)
            yield pa.RecordBatch.from_pydict({"_block": table["_block"].slice(0, 1).combine_chunks(), "_queries": [packed(table.drop_columns("_block"))]})

    def pack_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), CHUNK):
                yield pa.RecordBatch.from_pydict({"_rows": [packed(pa.Table.from_batches([batch.slice(i, CHUNK)]))]})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda packed: pa.ipc.open_stream(packed.as_buffer()).read_all()
        open_blocks = {}
        for batch in batches:
            for n, own, some in zip(batch["_block"].to_pylist(), batch["_queries"], batch["_rows"], strict=True):
                if n not in open_blocks:
                    open_blocks[n] = Block(read(own))
                open_blocks[n].meet(read(some))
        while open_blocks:
            _, whole = open_blocks.popitem()
            whole.end()
            yield from run(whole)

    deal = F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int").alias("_block")
    asked = sided(queries, query_vector).select("*", deal).repartitionById(blocks, F.col("_block")).mapInArrow(pack_block, "_block int, _queries binary")
    chunks = sided(rows, row_vector).mapInArrow(pack_chunks, "_rows binary").repartition(1)
    # Of a nested loop over both, the left side passes and the right one, a block, is held.
    return chunks.hint("shuffle_replicate_nl").crossJoin(asked).mapInArrow(meet, schema)


def dot_ranks(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, query_vector: str, row_vector: str, digits: int, k: int, **sizes: int) -> DataFrame:
    """Every query with every row: the other columns of both, score, the rounded dot product, and rank by it, then by row; exact for the ``k`` best."""
    own, met = ([c for c in df.columns if c != v] for df, v in ((queries, query_vector), (rows, row_vector)))
    kinds = {**dict(queries.dtypes), **dict(rows.dtypes)}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (*own, *met)] + ["score double", "exact double", "rank bigint"])

    def run(block: Block) -> Iterator[pa.RecordBatch]:
        n = len(block.rows)
        for pairs in block.pairs(query_id, row_id, digits):
            rank = np.empty_like(pairs.place)
            rank[pairs.best()] = np.arange(len(rank)) + 1
            for j, query in enumerate(pairs.own.tolist()):
                named = [block.queries[c][query] for c in own]
                for i in range(0, n, SENT):
                    some, at = block.rows.slice(i, SENT), slice(j * n + i, j * n + min(n, i + SENT))
                    unknown, ranks = pairs.unknown[at], rank[at]
                    values = [pa.array(pairs.score[at], mask=unknown), pa.array(pairs.exact[at], mask=unknown | (ranks > k)), pa.array(ranks)]
                    arrays = [*[pa.repeat(c, len(some)) for c in named], *[some[c].combine_chunks() for c in met], *values]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*own, *met, "score", "exact", "rank"])

    return dot_blocks(queries, rows, query_id, query_vector, row_vector, run, schema, **sizes)


def dot_rounds(queries: DataFrame, rows: DataFrame, rounds: list[str], k: int, digits: int, **sizes: int) -> DataFrame:
    """Rounds of requests, each of every query (query_id, vector) with the rows (id, vector) whose column named as the round is true.

    A pair is scored once for all rounds: score is the rounded dot product, and best_<round> tells whether it is one of the
    query's ``k`` best in a round. dot, the product itself, is given for those. Rows are to be in some round.
    """
    met = [c for c in rows.columns if c != "vector"]
    kinds = {**dict(queries.dtypes), **dict(rows.dtypes)}
    bests = [f"best_{r}" for r in rounds]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("query_id", *met)] + ["score double", "dot double"] + [f"`{b}` boolean" for b in bests])

    def run(block: Block) -> Iterator[pa.RecordBatch]:
        n = len(block.rows)
        asked = [pc.fill_null(block.rows[r], False).to_numpy() for r in rounds]
        for pairs in block.pairs("query_id", "id", digits):
            best = np.zeros((len(rounds), len(pairs.score)), bool)
            for own, some in zip(best, asked, strict=True):
                own[pairs.best(np.tile(some, len(pairs.own)), k)] = True
            named = block.queries["query_id"][int(pairs.own[0])]
            for j in range(len(pairs.own)):
                for i in range(0, n, SENT):
                    some, at = block.rows.slice(i, SENT), slice(j * n + i, j * n + min(n, i + SENT))
                    unknown = pairs.unknown[at]
                    values = [pa.array(pairs.score[at], mask=unknown), pa.array(pairs.exact[at], mask=unknown | ~best[:, at].any(axis=0)), *map(pa.array, best[:, at])]
                    arrays = [pa.repeat(named, len(some)), *[some[c].combine_chunks() for c in met], *values]
                    yield pa.RecordBatch.from_arrays(arrays, names=["query_id", *met, "score", "dot", *bests])

    return dot_blocks(queries, rows, "query_id", "vector", "vector", run, schema, **sizes)


def round_hits(queries: DataFrame, rows: DataFrame, rounds: list[str], k: int, digits: int, **sizes: int) -> DataFrame:
    """Of ``dot_rounds``, counts of each query and round (its place from 0): candidates, and hits, those of an earlier round; best and best_hits likewise.

    A query without candidates in a round has no row.
    """

    def run(block: Block) -> Iterator[pa.RecordBatch]:
        ids = pc.dictionary_encode(block.rows["id"].combine_chunks(), null_encoding="encode")
        code, nameless = ids.indices.to_numpy(), np.asarray(ids.dictionary.is_null())
        asked = [np.flatnonzero(pc.fill_null(block.rows[r], False).to_numpy()) for r in rounds]

        def hits(each: list[np.ndarray]) -> list[int]:
            """How many of each round's places have an id of an earlier round; a null is no id."""
            seen, told = np.zeros(len(nameless), bool), []
            for at in each:
                told.append(int(seen[code[at]].sum()))
                seen[code[at]] = True
                seen[nameless] = False
            return told

        kept, counts = hits(asked), []
        for pairs in block.pairs("query_id", "id", digits):
            m = len(pairs.own)
            best = [pairs.best((at + np.arange(m)[:, None] * len(code)).ravel(), k) % len(code) for at in asked]
            counts += [(n, len(at) * m, hit * m, len(top), top_hit) for n, (at, hit, top, top_hit) in enumerate(zip(asked, kept, best, hits(best), strict=True)) if len(at)]
        names = ["place", "candidates", "hits", "best", "best_hits"]
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in counts], pa.int64()) for i in range(len(names))], names=names)

    schema = "place bigint, candidates bigint, hits bigint, best bigint, best_hits bigint"
    return dot_blocks(queries, rows, "query_id", "vector", "vector", run, schema, **sizes)


def dot_gains(queries: DataFrame, rows: DataFrame, k: int, digits: int, **sizes: int) -> DataFrame:
    """Labels of each query's pairs as ``evaluation.metrics_of`` needs them: of the ``k`` best with their rank, and of all with how many have one.

    queries: query_id, vector, label; rows: id, vector, label, gain. A pair's label is the row's gain where both labels are
    equal, and 0 elsewhere; pairs without score or label take no part.
    """

    def run(block: Block) -> Iterator[pa.RecordBatch]:
        kinds = pc.dictionary_encode(pa.concat_arrays([side["label"].combine_chunks() for side in (block.queries, block.rows)])).indices
        wanted, own = np.split(pc.fill_null(kinds, -1).to_numpy().astype(np.int64), [len(block.queries)])
        gain = pc.cast(block.rows["gain"].combine_chunks(), pa.float64())
        labelled = np.asarray(gain.is_valid())
        labels, code = np.unique(np.append(pc.fill_null(gain, 0.0).to_numpy(), 0.0), return_inverse=True)
        zero, code = code[-1], code[:-1]
        for pairs in block.pairs("query_id", "id", digits):
            same = ((wanted[pairs.own][:, None] == own) & (own >= 0)).ravel()
            each = np.where(same, np.tile(code, len(pairs.own)), zero)
            part = ~pairs.unknown & ~(same & ~np.tile(labelled, len(pairs.own)))
            top = each[pairs.best(slice(None) if part.all() else part, k)]
            n = np.bincount(each[part], minlength=len(labels))
            some = np.flatnonzero(n)
            label, rank = labels[np.concatenate([top, some])], np.concatenate([np.arange(len(top)) + 1, np.zeros(len(some), int)])
            count = np.concatenate([np.zeros(len(top), int), n[some]])
            named = pa.repeat(block.queries["query_id"][int(pairs.own[0])], len(label))
            values = [pa.array(label), pa.array(rank.astype(np.int32), mask=rank == 0), pa.array(count, mask=count == 0)]
            yield pa.RecordBatch.from_arrays([named, *values], names=["group_id", "label", "r", "n"])

    schema = f"group_id {dict(queries.dtypes)['query_id']}, label double, r int, n bigint"
    return dot_blocks(queries, rows, "query_id", "vector", "vector", run, schema, **sizes)


def rerank(ranked: DataFrame, second: Column, k: int) -> DataFrame:
    """Scores of the best ``k`` are replaced by ``second``; the others keep theirs."""
    return ranked.withColumn("final", F.when(F.col("rank") <= k, second).otherwise(F.col("score")))


def pool_chunks(chunks: DataFrame, by: list[str], how: str = "mean", size: int = 64) -> DataFrame:
    """Element-wise mean or max of vectors; other names mean mean."""
    f = F.max if how == "max" else F.avg
    return chunks.groupBy(*by).agg(F.array(*[f(F.col("vector")[i].cast("double")) for i in range(size)]).alias("vector"))


def attend_chunks(chunks: DataFrame, by: list[str], query: Column, size: int = 64) -> DataFrame:
    """Means of vectors weighted by the softmax of their dot products with ``query``, an array or a column of chunks."""
    weight = scores.dot(F.col("vector"), query)
    most = chunks.withColumn("_w", weight).withColumn("_top", F.max("_w").over(Window.partitionBy(*by)))
    e = F.exp(F.col("_w") - F.col("_top"))
    return most.withColumn("_e", e).groupBy(*by).agg(F.array(*[F.sum(F.col("_e") * F.col("vector")[i].cast("double")) / F.sum("_e") for i in range(size)]).alias("vector"))
