"""The registered queries: each applies its operator to a whole table and derives the contract's columns."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    hard_negatives,
    jaccard_join,
    language_id,
    personal_data,
    quality_classifier,
    quality_rules,
    secret_scan,
    spelling,
    topk_search,
    vectors,
    warc,
)
from lemmaflow.llm.common import scratch, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("text_hash", "component")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = quality_classifier.grades_of(table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, ratings).drop("text")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(secret_scan.BASE))

    def count(field: str, value: str):
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")

    return scanned.select(
        "doc_id",
        *[count("kind", k).alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "example").alias("n_example"),
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat_format.read_back(chat_format.format_examples(said.unionByName(own)))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(personal_data.BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in personal_data.BASE],
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs, F.coalesce(language_id.fold() != 2, F.lit(False)))
    held_out = F.coalesce(language_id.fold() == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), out)
    return warc.read_archives(spark, out).drop("url")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return hard_negatives.hard_negatives(rows, rows.where(vectors.is_every("vec_id", 100)))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted_words(table(spark, sf_dir, "documents")))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(rows, rows.where(vectors.is_every("vec_id", 100)))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_byte_bpe": op3_byte_bpe,
    "op10_decontamination": op10_decontamination,
    "op4_secret_scans": op4_secret_scans,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_personal_data": op6_personal_data,
    "op7_language_id": op7_language_id,
    "op9_warc": op9_warc,
    "op8_quality_rules": op8_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_topk_search": op13_topk_search,
}
#: Vectors of finite components, as whole numbers of so many parts.
_WHOLE = """SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
_DOT = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT"
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
        t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))),
        reach AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT b, root FROM reach JOIN links ON a = doc_id AND root < b)
        SELECT s.doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(root) FROM reach WHERE reach.doc_id = s.doc_id) AS component_id,
          (SELECT count(*) FROM links WHERE a = s.doc_id) AS n_links FROM s""",
    "op5_chat_formatting": """
        WITH own AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
          SELECT *, 14 + sum(length(role) + length(text)
              + length(regexp_replace(role || text, '[^\\\\<\\[\\]]', '', 'g'))) OVER w
              + 14 * (row_number() OVER w - 1) AS prefix_chars,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
          FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          (sum(prefix_chars) FILTER (role = 'assistant' OR from_end = 1))::BIGINT AS formatted_chars,
          count(*) FILTER (role = 'assistant') AS n_examples
        FROM sized GROUP BY conv_id""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
            CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM d""",
    "op11_hard_negatives": f"""
        WITH w AS ({_WHOLE.format(scale=256, label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")} AND label IS NOT NULL),
        scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {_DOT} AS score
          FROM w a JOIN w b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
        FROM pos p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 5""",
    "op12_spelling_variants": """
        WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i,
            list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) r(i))),
        r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        g AS (SELECT d, run, count(*) AS c FROM r WHERE length(run) >= 7 GROUP BY ALL),
        h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(d || ':' || run, ''),
            lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, (unicode(ch) - 64)::BIGINT] END))),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM g, tab),
        w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
            sum(c)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(c) >= 2),
        cut AS (SELECT word, n, i, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
        near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT w.word, c.word, c.n FROM w JOIN cut c ON c.rest = w.word
          UNION SELECT c.word, w.word, w.n FROM w JOIN cut c ON c.rest = w.word),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
          FROM w LEFT JOIN best ON best.word = w.word),
        led AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL
          UNION SELECT led.word, f.form FROM led JOIN f ON f.word = led.root WHERE f.form IS NOT NULL)
        SELECT f.word, form, coalesce((SELECT led.root FROM led JOIN f AS g ON g.word = led.root WHERE led.word = f.word AND g.form IS NULL), f.word) AS root, n, n_near, form_n FROM f""",
    "op13_topk_search": f"""
        WITH w AS ({_WHOLE.format(scale=1024, label="0")}),
        scored AS (SELECT a.vec_id AS query_id, b.vec_id, {_DOT} AS score FROM w a JOIN w b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, (row_number() OVER o)::INTEGER AS rank, vec_id, score FROM scored
        WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 10""",
}
