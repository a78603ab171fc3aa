"""Clashing column names, very long texts and ties: the same results as without them, on every operator of documents."""

import hashlib
import random
from pathlib import Path
from statistics import NormalDist

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_llm import DATA, DOCS, ODD

from lemmaflow.llm import byte_bpe, chat_format, decontaminate, jaccard_join, language_id, personal_data, quality_classifier, quality_rules, queries, secret_scan, spelling, warc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that the operators use themselves, for values that must not matter.
CLASHING = ["id", "rid", "fp", "sig", "n", "pos", "token", "root", "component", "component_id", "text_hash", "spans", "row_key", "value_hash", "verdict", "s", "owner", "repo", "_owner"]
CLASHING += ["words", "windows", "lines", "g", "v1", "d2", "kept", "start", "n_words", "grade", "score", "ids", "decoded", "hash", "mask", "item", "flag", "overlap", "lang_pred", "held_out", "word", "block", "kind"]


def rows_of(df, columns):
    return sorted((repr(tuple(r[c] for c in columns)) for r in df.select(columns).collect()))


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op7", "op8", "op10", "op12", "redact"])
def test_clashing_columns_do_not_matter(spark, name):
    r = random.Random(5)
    more = [(100 + k, " ".join(r.choice(["alpha", "beta", "gamma", "delta7", "mountains", "password: hunter22"]) for _ in range(40)), r.choice(["en", "fr"]), "s", 1, 0) for k in range(40)]
    plain = spark.createDataFrame([*ODD, *more], DOCS)
    wide = plain.withColumns({c: F.lit(k).cast("string") if k % 2 else F.lit(None).cast("double") for k, c in enumerate(CLASHING)})
    labels = spark.createDataFrame([(100 + k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, more[0][1], 5), (2, None, 6)], "item_id long, text string, id int")
    run = {
        "op1": lambda d: jaccard_join.jaccard_components(d),
        "op2": lambda d: quality_classifier.classify(d, quality_classifier.grades_of(labels)).select("doc_id", "text", "kept"),
        "op3": lambda d: byte_bpe.round_trip(d.drop("ids", "decoded"), PATH, public_tokenizers.PATTERN).select("doc_id", "ids", "decoded"),
        "op4": lambda d: secret_scan.scan_secrets(d).select("doc_id", "spans"),
        "op6": lambda d: personal_data.find_personal_data(d).select("doc_id", "spans"),
        "op7": lambda d: language_id.identify(d, F.col("doc_id") % 3 != 0).select("doc_id", "lang_pred"),
        "op8": lambda d: quality_rules.quality_rules(d).select("doc_id", "n_words", "base_failed", "kept"),
        "op10": lambda d: decontaminate.contaminated(d, bench),
        "op12": lambda d: spelling.variants(spelling.counted_words(d)),
        "redact": lambda d: secret_scan.redact_secrets(d).select("doc_id", "text"),
    }[name]
    got, want = run(wide), run(plain)
    assert got.columns == want.columns and rows_of(got, got.columns) == rows_of(want, want.columns)


def test_clashing_columns_of_pages_and_conversations(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k}", "x" * 150 if k % 2 else None) for k in range(6)], "page_id long, url string, html string")
    said = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    read = []
    for k, extra in enumerate(([], ["shard", "payload", "digest", "record", "id", "size", "refers_to", "payload_digest", "file"])):
        warc.write_archives(pages.withColumns({c: F.lit("q") for c in extra}), str(tmp_path / str(k)))
        got = warc.read_archives(spark, str(tmp_path / str(k)))
        read.append(rows_of(got, got.columns))
    assert read[0] == read[1]
    told = [chat_format.read_back(chat_format.format_examples(said.withColumns({c: F.lit("q") for c in extra}))) for extra in ([], ["turns", "prefix", "loss", "example", "formatted", "n", "body"])]
    assert rows_of(told[0], told[0].columns) == rows_of(told[1], told[1].columns)


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(8)
    return " ".join(r.choice(["alpha", "béta", "gamma", "delta", "x1@y.org", "ein", "the", "und"]) + str(r.randrange(50)) for _ in range(300_000))


def test_very_long_texts(spark, tmp_path, long_text):
    docs = spark.createDataFrame([(1, long_text, "en", "s"), (2, "a short one", "de", "s"), (3, long_text + " more", "en", "t")], "doc_id long, text string, lang string, source string")
    both = {r["doc_id"]: r for r in byte_bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()}
    known = tiktoken.Encoding("k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(Path(PATH).read_bytes()), special_tokens={})
    assert both[1]["decoded"] == long_text and both[1]["ids"] == known.encode_ordinary(long_text)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 1}
    ratings = quality_classifier.grades_of(spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    assert quality_classifier.classify(docs, ratings).count() == 3
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, F.col("doc_id") < 3).collect()} == {1: "en", 2: "de", 3: "en"}
    item = " ".join(long_text.split()[-30:])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r["doc_id"], r["overlap"]) for r in decontaminate.contaminated(docs, bench).orderBy("doc_id").collect()] == [(1, 1.0), (3, 1.0)]
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    warc.write_archives(pages.union(pages.withColumn("page_id", F.col("page_id") + 10)), str(tmp_path / "w"))
    digest = hashlib.sha256(long_text.encode()).hexdigest()
    got = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got[1]["payload_digest"] == got[11]["payload_digest"] == digest and got[11]["refers_to"] == 1 and got[12]["record_type"] == "response"
    said = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long_text)], "conv_id long, turn long, role string, text string")
    told = chat_format.read_back(chat_format.format_examples(said)).first()
    assert told["loss_chars"] == len(long_text) and told["loss_sha256"] == brute.sha(long_text)


def test_ties_of_languages_are_settled(spark):
    rows = [(k, "same words here", lang) for k, lang in enumerate(["fr", "en"] * 10)]
    docs = spark.createDataFrame([*rows, (99, "same words here", None)], "doc_id long, text string, lang string")
    got = [language_id.identify(docs.repartition(n), F.col("doc_id") >= 0).where("doc_id = 99").first() for n in (1, 5)]
    assert got[0]["lang_pred"] == got[1]["lang_pred"] and abs(got[0]["score"] - 0.5) < 0.1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_of_whole_tables(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(queries.ORACLES[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, str(DATA)).toArrow()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert sorted(map(repr, got.select(columns).to_pylist())) == sorted(map(repr, want.select(columns).to_pylist()))


def lower(values, q):
    """The smallest value that at least a share ``q`` of the values doesn't exceed."""
    values = np.sort(values)
    return values[max(int(np.ceil(q * len(values))) - 1, 0)]


def verdicts(groups: dict, support=0.75, prior=10.0, probability=1e-3):
    """Rows of each group (arrays of four statistics) to whether they stay: the stated method, with plain arrays."""
    floors = np.array(quality_rules.FLOORS)

    def factor(c):
        low = np.zeros((4, 4))
        for i in range(4):
            for j in range(i + 1):
                rest = c[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(rest, floors[i] / 10)) if i == j else rest / low[j, j]
        return low

    def distances(x, m, c):
        return (np.linalg.solve(factor(c), (x - m).T) ** 2).sum(axis=0)

    def log_det(c):
        return 2 * np.log(np.diag(factor(c))).sum()

    def step(x, m, c):
        d2 = distances(x, m, c)
        kept = x[d2 <= lower(d2, support)]
        return kept.mean(axis=0), np.cov(kept.T, bias=True) + np.diag(floors), len(kept)

    found = {}
    for g, x in groups.items():
        middle = np.array([lower(v, 0.5) for v in x.T])
        scale = np.sqrt((np.array([lower(v, 0.5) for v in np.abs(x - middle).T]) * 1.4826) ** 2 + floors)
        z = (x - middle) / scale
        alike, norm = np.cov(np.tanh(z).T, bias=True), (z**2).sum(axis=1)
        spread = np.sqrt(np.outer(np.diag(alike), np.diag(alike)))
        alike = np.where(np.eye(4) > 0, 1.0, alike / np.maximum(spread, 1e-9))
        signs = np.array([np.outer(a, a) / n if n > 0 else np.zeros((4, 4)) for a, n in zip(z, norm, strict=True)]).mean(axis=0)
        starts = []
        for k, c in enumerate((np.eye(4), alike, signs * 4 + 0.1 * np.eye(4))):
            m, c, n = middle, c * np.outer(scale, scale), 0
            for _ in range(2):
                m, c, n = step(x, m, c)
            starts.append((log_det(c), k, (m, c, n)))
        best = min(starts, key=lambda s: s[:2])[2]
        while log_det(best[1]) - log_det((after := step(x, *best[:2]))[1]) >= 0.01:
            best = after
        found[g] = best
    total = sum(n for _, _, n in found.values())
    centre = sum(n * m for m, _, n in found.values()) / total
    whole = sum(n * (c + np.outer(m - centre, m - centre)) for m, c, n in found.values()) / total
    d2 = {}
    for g, (m, c, n) in found.items():
        share = n / (n + prior)
        d2[g] = np.log(np.maximum(distances(groups[g], share * m + (1 - share) * centre, share * c + (1 - share) * whole), 1e-6))
    everyone = np.concatenate(list(d2.values()))
    out = {}
    for g, own in d2.items():
        share = len(own) / (len(own) + prior)
        q = [share * lower(own, p) + (1 - share) * lower(everyone, p) for p in (0.25, 0.5, 0.75)]
        out[g] = own <= q[1] + NormalDist().inv_cdf(1 - probability) * (q[2] - q[0]) / (2 * quality_rules.QUARTILE)
    return out


def test_verdicts_equal_the_plain_method(spark):
    r = random.Random(11)
    word = lambda mean: "abcdefghij"[r.randrange(10)] * max(1, round(r.gauss(mean, 2)))
    rows = []
    for g, n, mean in (("a", 260, 6), ("b", 90, 4), ("c", 14, 5), (None, 3, 5)):
        for _ in range(n):
            odd = r.random() < 0.08
            text = " ".join(word(15 if odd else mean) + (" #" * r.randrange(3) if odd else "") for _ in range(r.randint(12, 300)))
            rows.append((len(rows), text.replace(" ", "\n", r.randrange(4)), "en", g))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x for x in quality_rules.quality_rules(docs).collect()}
    groups, ids = {}, {}
    for i, text, _, g in rows:
        n, chars, symbols, dup, _, failed = brute.quality(text)
        assert got[i]["base_failed"] == failed
        if not failed:
            lines = max(sum(1 for x in text.split("\n") if x.split()), 1)
            groups.setdefault(g, []).append([np.log1p(n), chars / n, np.log1p(100 * symbols / n), np.log1p(10 * dup / lines)])
            ids.setdefault(g, []).append(i)
    want = {i: bool(k) for g, kept in verdicts({g: np.array(x) for g, x in groups.items()}).items() for i, k in zip(ids[g], kept, strict=True)}
    assert {i: x["kept"] for i, x in got.items() if not x["base_failed"]} == want
    assert 3 < sum(not k for k in want.values()) < 60
