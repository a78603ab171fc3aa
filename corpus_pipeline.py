"""The corpus pipeline: each stage works on all that the one before it kept.

Quality classifier (rejected documents go), n-gram Jaccard join (the smallest id of each group stays), benchmark
decontamination (documents that hold an item go), secret scan (live secrets are replaced in the text), byte-level
BPE (ids of the text, and whether they decode to it). Decisions are on rows, by id and text: where an id repeats with
other texts, each of its rows has its own verdict; rows alike in both are copies. A null id counts as the largest.
Texts without words are no copies of each other; an empty table gives no rows.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.llm import byte_bpe, decontaminate, jaccard_join, quality_classifier, secret_scan
from lemmaflow.llm.common import materialize, set_apart, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ratings = quality_classifier.grades_of(table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, ratings).where("kept").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    id_, text_hash = F.col("doc_id"), F.xxhash64("text")
    grouped = jaccard_join.jaccard_components(docs).where("component is not null").select("component", "doc_id", "text_hash")
    grouped = materialize(grouped)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    groups = grouped.groupBy("component").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    named = grouped.join(groups, "component").withColumn("stays", own == F.col("first"))
    named = materialize(named.groupBy("doc_id", "text_hash", "stays").agg(F.count(F.lit(1)).alias("same")))

    def row_of(keys: DataFrame):
        return id_.eqNullSafe(keys["_id"]) & (text_hash == keys["_hash"])

    keys = named.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stays", "same")
    gone, repeated = keys.where("not stays or same > 1"), keys.where("stays and same > 1")
    maybe, rest = set_apart(docs, text_hash, gone.select("_hash"))
    again = maybe.join(repeated, row_of(repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.union(maybe.join(gone, row_of(gone), "left_anti").select(docs.columns)).union(again.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.xxhash64("doc_id", "text")
    found = decontaminate.contaminated(docs.select(row.alias("row"), "text"), table(spark, sf_dir, "benchmark"), id_col="row")
    found = materialize(found.select(F.col("row").alias("_row")).distinct())
    maybe, rest = set_apart(docs, row, found)
    return rest.union(maybe.join(found, row == F.col("_row"), "left_anti").select(docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = secret_scan.redact_secrets(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("decodes_to_text"))


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", drop_copies),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
