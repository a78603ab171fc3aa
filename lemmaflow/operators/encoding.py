"""Vocabularies and token ids: reading, static encoding, truncation of pairs to a length, padding."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.functions import text
from lemmaflow.operators import ordering
from lemmaflow.session import written_once

PAD, UNKNOWN = "<pad>", "<unk>"


def vocabulary(lines: DataFrame) -> DataFrame:
    """token, id. lines: pos, value (``token<TAB>score``, or words of which the first counts). A token's first line counts.

    Where they are missing, the padding token gets id 0 before all others and the unknown token the last id.
    """
    line = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    token = F.when(F.contains(line, F.lit("\t")), F.substring_index(line, "\t", 1)).otherwise(F.regexp_extract(line, r"(?U)^(\S+)", 1))
    first = lines.where(line != "").select(token.alias("token"), "pos").groupBy("token").agg(F.min("pos").alias("pos"))
    put = ordering.positions(first, [F.col("pos")], "id")
    held = put.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("token") == t).alias(n) for t, n in ((PAD, "pads"), (UNKNOWN, "unknowns"))])
    shift = F.when(F.col("pads") == 0, 1).otherwise(0)
    own = put.crossJoin(F.broadcast(held)).select("token", (F.col("id") + shift).cast("int").alias("id"))  # one row of counts
    pad = held.where("pads = 0").select(F.lit(PAD).alias("token"), F.lit(0).alias("id"))
    unknown = held.where("unknowns = 0").select(F.lit(UNKNOWN).alias("token"), (F.col("n") + shift).cast("int").alias("id"))
    return own.union(pad).union(unknown)


def spaced_tokens(rows: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, i, token of what stands between ASCII spaces."""
    words = F.split(F.btrim(column, F.lit(" \t\n\x0b\x0c\r")), r"[ \t\n\x0b\f\r]+")
    return rows.select(key, F.posexplode(words).alias("i", "token"))


def dynamic_vocabulary(tokens: DataFrame) -> DataFrame:
    """token, n, id: ids from 2 in order of arrival, by key (the first column) and i."""
    first = tokens.groupBy("token").agg(F.min(F.struct(tokens.columns[0], "i")).alias("first"), F.count(F.lit(1)).alias("n"))
    return ordering.positions(first, [F.col("first")], "id").select("token", "n", (F.col("id") + 2).alias("id"))


def encode_dynamic(rows: DataFrame, key: str, column: str = "text", share: int = 50_000) -> DataFrame:
    """key, ids: of each text's tokens in order, with ids by arrival over all texts in order of key.

    Tokens that make up more than one ``share``-th of all get their ids where they stand. There are less than ``share`` of
    them, so they are known to all tasks; only the others move to their ids.
    """
    tokens = spaced_tokens(rows, key, column)
    words = written_once(dynamic_vocabulary(tokens))
    total = words.agg(F.sum("n").alias("total"))
    dealt = words.crossJoin(F.broadcast(total)).select("token", "id", (F.col("n") * share > F.col("total")).alias("often"))  # one row
    frequent = F.broadcast(dealt.where("often").select("token", "id"))  # less than share rows
    near = tokens.join(frequent, "token").select(key, "i", "id")
    far = tokens.join(frequent, "token", "left_anti").join(dealt.where("not often").select("token", "id"), "token").select(key, "i", "id")
    return near.union(far).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("ids"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "value"))
    return vocabulary(rows)


def encode_static(rows: DataFrame, words: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, ids: the ids of a text's static tokens in order, of unknown ones that of the unknown token; an empty text has none."""
    tokens = F.when(F.col(column) == "", F.array().cast("array<string>")).otherwise(text.static_tokens(F.col(column)))
    one = rows.select(key, F.posexplode_outer(tokens).alias("pos", "token")).join(words, "token", "left")
    unknown = words.where(F.col("token") == UNKNOWN).select(F.col("id").alias("unknown"))
    met = one.crossJoin(F.broadcast(unknown))  # one row
    found = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", "unknown").alias("id")))
    return met.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(found)), lambda x: x["id"]).alias("ids"))


def head(ids: Column, n: Column) -> Column:
    return F.slice(ids, F.lit(1), F.greatest(n, F.lit(0)))


def tail(ids: Column, n: Column) -> Column:
    kept = F.least(F.greatest(n, F.lit(0)), F.size(ids))
    return F.slice(ids, F.size(ids) - kept + 1, kept)


def truncated_pair(whole: Column, query: Column, separator: Column, candidate: Column, most: Column) -> tuple[Column, Column]:
    """How a query and a candidate fit into ``most`` ids (full_fit, truncated, extreme_truncated), and the ids.

    Space goes by the share of lengths; of pairs over three times too long, only the outer quarters compete. Lengths are
    settled first, so that each sequence is cut once: into a beginning and, for outer quarters, an end.
    """
    none = F.lit(0)
    clamp = lambda n, most: F.greatest(none, F.least(n, most))
    share = lambda a, n: F.when(n > 0, a / n).otherwise(0.5)
    room, nq, nc = most - F.size(separator), F.size(query), F.size(candidate)
    total = nq + nc
    usual = F.least(F.greatest(F.lit(1), (room * share(nq, total)).cast("int")), nq, room - 1)
    long = total > 3 * most

    def outer(n: Column) -> tuple[Column, Column]:
        """Lengths of the beginning and the end that outer quarters leave."""
        quarter = F.greatest(F.lit(1), F.floor(n / 4).cast("int"))
        return F.when(n > 2 * quarter, quarter).otherwise(n), F.when(n > 2 * quarter, quarter).otherwise(none)

    (q1, q2), (c1, c2) = outer(nq), outer(nc)
    both = q1 + q2 + c1 + c2
    part = F.when(both > room, (room * share(q1 + q2, both)).cast("int")).otherwise(q1 + q2)
    rest = F.when(both > room, room - part).otherwise(c1 + c2)

    def cut(ids: Column, n: Column, first: Column, last: Column, wanted: Column, plain: Column) -> tuple[Column, Column]:
        begin = F.when(long, clamp(wanted, first)).otherwise(clamp(plain, n))
        end = F.when(long, clamp(wanted - first, last)).otherwise(none)
        return F.slice(ids, F.lit(1), begin), F.slice(ids, F.greatest(F.lit(1), n - last + 1), end)

    fits, tight = F.size(whole) <= most, room <= 2
    kind = F.when(fits, "full_fit").when(tight, "extreme_truncated").otherwise("truncated")
    pieces = F.concat(*cut(query, nq, q1, q2, part, usual), separator, *cut(candidate, nc, c1, c2, rest, room - usual))
    return kind, F.slice(F.when(fits | tight, whole).otherwise(pieces), F.lit(1), F.greatest(most, none))


def truncation_counts(kinds: DataFrame, by: list[str]) -> DataFrame:
    return kinds.groupBy(*by).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("full_fit", "truncated", "extreme_truncated")])


def safe_ids(ids: Column, size: Column, unknown: Column) -> Column:
    return F.transform(ids, lambda i: F.when((i < 0) | (i >= size), unknown).otherwise(i))


def padded(ids: Column, to: Column, pad: int = 0) -> tuple[Column, Column]:
    """The ids filled up to a length, and the mask of the real ones."""
    gap = F.greatest(to - F.size(ids), F.lit(0))
    filled = F.concat(ids, F.array_repeat(F.lit(pad), gap))
    return filled, F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap))


def effective_length(override: Column, model: Column) -> Column:
    return F.coalesce(F.least(override, model), F.lit(256))


def masked_mean(vectors: Column, mask: Column, width: int) -> Column:
    """The mean of the vectors whose mask is 1; zeros where none is."""
    zero = F.array(*[F.lit(0.0)] * width)
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m))
    summed = F.aggregate(weighted, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    n = F.greatest(F.lit(1), F.aggregate(mask, F.lit(0), lambda a, m: a + m))
    return F.transform(summed, lambda x: x / n)
