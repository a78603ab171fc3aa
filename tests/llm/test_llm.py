"""The operators against plain Python, exact round trips and held-out accuracy, on small tables and odd rows."""

import base64
import itertools
import random
import sys
import time
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lemmaflow.llm import (  # noqa: E402
    byte_bpe,
    chat_format,
    decontaminate,
    jaccard_join,
    language_id,
    personal_data,
    quality_classifier,
    quality_rules,
    queries,
    secret_scan,
    warc,
)

DATA = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"
ODD = [
    (1, None, None, None, None, 1),
    (2, "", "en", "s", 0, 2),
    (3, " \n\t ", "en", "s", 4, 3),
    (4, "one two three", "en", "s", 13, 4),
    (4, "one two three", "en", "s", 13, 4),
    (5, "ONE two\x0bthree", "en", None, 13, 5),
    (6, "word " * 30_000, "en", "s", 1, 6),
    (7, "é🙂 password: hunter22 🙂 AKIA" + "B" * 16 + " " + "0a" * 12 + " token=secret:abcdefgh", "fr", "t", 1, 7),
    (8, "mail a.b@ex-a.com.de or +1 (555) 010-9999, 4111 1111 1111 1111, 10.0.0.255 300.1.1.1", "en", "t", 1, 8),
    (None, "a row without an id but with some words in it", "en", "t", 1, 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(str(DATA / "documents.parquet")).cache()


def near_copies(seed: int = 3, n: int = 240) -> list[tuple[int, str]]:
    """Groups of edited copies, some of copies of copies, so that links chain."""
    r = random.Random(seed)
    out: list[str] = []
    for _ in range(n):
        if out and r.random() < 0.75:
            w = r.choice(out[-12:]).split()
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randint(0, 2)] = [r.choice("abcdefghij") * r.randint(1, 3)] * r.randint(0, 2)
        else:
            w = [r.choice("abcdefghij") * r.randint(1, 4) for _ in range(r.randint(1, 120))]
        out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "block"), [(3, 1 << 17), (4, 400)])
def test_jaccard_components(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "MEMBERS", max(2, block >> 7))
    rows = near_copies(seed)
    rows += [(1000 + i, t) for i, t in rows[::7]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(rows)


def test_jaccard_odd_rows(odd):
    got = jaccard_join.jaccard_components(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by[1] == (0, 1) and by[4] == by[5] == (1, 4) and by[6] == (1, 6)
    assert {r["n_links"] for r in got if r["doc_id"] in (4, 5)} == {2} and {r["n_links"] for r in got if r["doc_id"] not in (4, 5)} == {0}


def test_secrets(docs, odd):
    for df in (docs, odd):
        got = sorted((r["doc_id"] or -1, secret_text(r["spans"])) for r in secret_scan.scan_secrets(df).collect())
        want = sorted((r["doc_id"] or -1, brute.secrets(r["text"])[3]) for r in df.collect())
        assert got == want


def secret_text(spans):
    return brute.sha(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in secret_scan.BASE))


def test_redaction(spark):
    two = [(2, "secret: shared99 z", "a"), (3, "secret: shared99 y", "b"), (4, None, "b")]
    wide = [(10 + k, f"token=example99 {k}", f"o{k}") for k in range(secret_scan.OWNERS)]
    forks = [(20 + k, "token=forked99 x", f"o{k}") for k in range(9)]
    rows = spark.createDataFrame([(1, "x password=abcdef12 y", "a"), *two, *wide, *forks], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact_secrets(rows).collect()}
    # A few owners leave a value live, and so do copies of one text, at however many owners; many of both make an example.
    assert got == {1: "x <secret> y", 2: "<secret> z", 3: "<secret> y", 4: None} | {k: x for k, x, _ in wide} | {k: "<secret> x" for k, _, _ in forks}


def test_ownership(spark):
    r = random.Random(4)
    spans = [(f"v{r.randrange(9)}", r.choice([None, "a", "b", "c"]), r.randrange(6)) for _ in range(150)]
    got = {x["value_hash"]: (x["n_owners"], x["n_repositories"]) for x in secret_scan.ownership(spark.createDataFrame(spans, "value_hash string, owner string, repository long"), "owner", "repository").collect()}
    assert got == {v: tuple(len({s[k] for s in spans if s[0] == v}) for k in (1, 2)) for v in {s[0] for s in spans}}


def test_copies_of_one_owner_stay_live(spark):
    text, kinds = "x password=abcdef12 y ghp_" + "a1B" * 12 + " z", ["assign", "issued"]
    rows = spark.createDataFrame([(i, text, "a") for i in range(40)], "doc_id long, text string, source string")
    for r in secret_scan.scan_secrets(rows).collect():
        live = [s["kind"] for s in r["spans"] if s["verdict"] == "live"]
        assert set(kinds) <= set(live) and len(live) == len(r["spans"])
    assert {r["text"] for r in secret_scan.redact_secrets(rows).collect()} == {"x <secret> y <secret> z"}


def test_quality_statistics(docs, odd):
    for df in (docs, odd):
        got = sorted((r["doc_id"] or -1, *r[1:6]) for r in quality_rules.text_statistics(df, ["doc_id"]).collect())
        assert got == sorted((r["doc_id"] or -1, *brute.quality(r["text"])[:5]) for r in df.collect())
    judged = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    assert judged[6]["base_failed"] and not judged[1]["kept"]


def test_outliers_go(spark):
    r = random.Random(1)
    rows = [(i, " ".join("abcdefg"[r.randrange(7)] * r.randint(2, 8) + (" ###" if i < 5 else "") for _ in range(r.randint(80, 120)))) for i in range(400)]
    df = spark.createDataFrame([(*x, "en", "s") for x in rows], "doc_id long, text string, lang string, source string")
    got = {x["doc_id"] for x in quality_rules.quality_rules(df).collect() if not x["kept"]}
    assert got == set(range(5))


def test_chat(spark):
    rows = [(1, 0, "user", "</s>[INST] \\b \\\\ <s>[role=x]"), (1, 1, "assistant", "a\\"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, None, "x"), (3, 1, "assistant", "é🙂"), (3, 1, "assistant", "é🙂"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*x, 9) for x in rows], "conv_id long, turn long, role string, text string, extra int")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.read_back(chat_format.format_examples(df)).collect()}
    assert got == brute.chat(rows)
    assert chat_format.read_back(chat_format.format_examples(df.limit(0))).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return path, ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_pieces(tokenizer):
    _, ranks, known = tokenizer
    machine, r = byte_bpe.Transducer(ranks), random.Random(5)
    for _ in range(3000):
        piece = "".join(r.choice(["a", "e", "n", "th", "ing", " ", "é", "日", "🙂", "=", "-", "\n", "0"]) for _ in range(r.randint(1, 24)))
        assert machine.encode(piece.encode()) == known._core_bpe.encode_single_piece(piece.encode())


def test_bpe_round_trip(docs, odd, tokenizer):
    path, _, known = tokenizer
    for df in (docs, odd):
        both = byte_bpe.decode(byte_bpe.encode(df, path, public_tokenizers.PATTERN), path, step=7).collect()
        assert all(r["ids"] == known.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "") for r in both)
        assert len(both) == df.count()


def test_personal_data(docs, odd):
    for df in (docs, odd):
        got = sorted((r["doc_id"] or -1, brute.sha(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] in personal_data.BASE))) for r in personal_data.find_personal_data(df).collect())
        assert got == sorted((r["doc_id"] or -1, brute.pii(r["text"])[4]) for r in df.collect())


def test_wider_personal_data(spark):
    rows = [(i, f"please write mail to ann{i} [at] mail [dot] com or call 212 555 0{i:03d}") for i in range(40)]
    got = personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("masked_email" in [s["kind"] for s in r["spans"]] for r in got)


def test_long_runs_of_digits():
    found = personal_data.candidates("1.2.3." + "9" * 5000 + " " + "0" * 5000 + "9.2.3.255 +" + "1" * 5000)
    assert [(s[2], s[3] - s[0]) for s in found] == [("ip", 5000 + len("9.2.3.255"))]


def test_languages(spark, odd):
    got = queries.op7_language_id(spark, str(DATA))
    truth = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "lang")
    held = got.join(truth, "doc_id").where("held_out").selectExpr("avg(int(lang = lang_pred)) AS a").first()["a"]
    assert held > 0.9
    by = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, odd["doc_id"] > 3).collect()}
    assert by[1] == by[2] == by[3] == "und" and by[4] != "und"


def test_classifier(spark, docs):
    labels = spark.read.parquet(str(DATA / "labels.parquet"))
    got = quality_classifier.classify(docs, quality_classifier.grades_of(labels)).join(labels, "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] and not r["toxic"]]
    assert len(good) and sum(good) / len(good) > 0.95
    assert not any(r["kept"] for r in got if r["toxic"])
    none = quality_classifier.classify(docs, quality_classifier.grades_of(labels.limit(0)))
    assert none.where("kept and expected_grade is null").count() == docs.count()


def test_thresholds_are_ordered():
    import numpy as np

    rows = [np.array([1 + i % 3, 50 + i % 7], np.int32) for i in range(60)]
    w, cuts = quality_classifier.fit(rows, np.array([i % 3 for i in range(60)]), np.arange(3))
    assert cuts[0] < cuts[1] and w[1] < w[2] < w[3]


def test_decontamination(spark):
    r = random.Random(2)
    item = [f"w{r.randrange(10**6)}" for _ in range(30)]
    edited = [x if i % 6 else "other" for i, x in enumerate(item)]
    noise = lambda n: [f"n{r.randrange(10**6)}" for _ in range(n)]
    rows = [(1, " ".join(noise(40) + item + noise(5))), (2, " ".join(noise(9) + edited)), (3, " ".join(noise(80))), (4, " ".join(item[:6] + noise(50))), (5, None), (6, "x " + " ".join(item[:7]) + " y"), (None, " ".join(item))]
    bench = spark.createDataFrame([(10, " ".join(item).upper()), (11, " ".join(item[:7])), (12, None), (13, "a b")], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 10), (1, 11), (2, 10), (4, 11), (6, 11)}


def allowed(width: int) -> int:
    return width - -(-3 * width // 4)


@pytest.mark.parametrize("words", [*range(1, 24), 60])
def test_masks_are_lossless(words):
    width = min(words, 20)
    spots = [sum(1 << o + i for i, c in enumerate(m) if c == "1") for m in decontaminate.family(words, 20, 0.75) for o in range(width - len(m) + 1)]
    missed = [p for p in itertools.combinations(range(width), allowed(width)) if all(s & sum(1 << i for i in p) for s in spots)]
    assert spots and not missed


def test_decontamination_against_all_alignments(spark):
    r = random.Random(6)
    items = {k: [f"w{r.randrange(50)}" for _ in range(n)] for k, n in enumerate([*range(1, 24), 40, 60])}
    docs = {}
    for k, item in items.items():
        for spare in (0, 1):
            part = item[:20] if k % 2 else item[-20:]
            edited = list(part)
            spots = range(0, len(part), 4) if spare == 0 and len(part) == 20 else r.sample(range(len(part)), min(len(part), allowed(len(part)) + spare))
            for i in spots:
                edited[i] = "other"
            docs[10 * k + spare] = [f"n{r.randrange(10**6)}" for _ in range(r.choice([0, 7]))] + edited + ["end"] * r.choice([0, 3])
    want = {(d, k) for d, words in docs.items() for k, item in items.items() if brute.aligned(words, item, 20) >= 0.75}
    assert len(want) > 15
    frames = [spark.createDataFrame([(k, " ".join(w)) for k, w in x.items()], f"{c} long, text string") for x, c in ((docs, "doc_id"), (items, "item_id"))]
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(*frames).collect()} == want


def test_warc(spark, tmp_path):
    same = "<p>" + "x" * 200
    rows = [(3, "u", same), (1, "u\r\n%41", same), (2, None, None), (4, "u", "short"), (5, "u", "short"), (None, "u", same)] + [(100 + i, "u", f"{i}" * 400) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    out = f"file://{tmp_path}/a"
    manifest = warc.write_archives(pages, out, shard_bytes=8_000, roll_bytes=600)
    again = warc.write_archives(pages.repartition(2), f"file://{tmp_path}/b", shard_bytes=8_000, roll_bytes=600)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, again.collect()))
    assert manifest.count() > 5 and not list((tmp_path / "a").glob(".*.tmp"))
    got = {r["page_id"]: r for r in warc.read_archives(spark, out).collect()}
    assert len(got) == len(rows)
    assert (got[3]["record_type"], got[3]["refers_to"], got[1]["record_type"], got[5]["record_type"]) == ("revisit", 1, "response", "response")
    assert got[1]["url"] == "u\r\n%41" and all(got[i]["payload_digest"] == brute.sha(h or "") and got[i]["payload_bytes"] == len(h or "") for i, _, h in rows)


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bench = spark.createDataFrame([], "item_id long, text string")
    for got in (
        jaccard_join.jaccard_components(none),
        secret_scan.scan_secrets(none),
        quality_rules.quality_rules(none),
        byte_bpe.decode(byte_bpe.encode(none, path, public_tokenizers.PATTERN), path),
        personal_data.find_personal_data(none),
        language_id.identify(none, none["doc_id"] > 0),
        decontaminate.contaminated(none, bench),
        decontaminate.contaminated(odd, bench),
    ):
        assert got.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    sets = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(DATA)).cache()
        sets[name] = {r[0] for r in docs.select("doc_id").collect()}
        assert sets[name] <= {r[0] for r in before.select("doc_id").collect()}
    graded = [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(DATA / "documents.parquet")).collect() if r["doc_id"] in sets["quality_classifier"]]
    assert sets["ngram_jaccard_join"] == {c for _, c, _ in brute.components(graded).values()}
    assert docs.where("not decodes_to_text").count() == 0


def test_warc_shards_with_a_far_id_and_a_much_copied_payload(spark, tmp_path):
    far = [(k if k else 10**15, "u", f"{k}" * 400) for k in range(400)]
    copied = [(10**6 + k, "u", "<p>" + "same" * 50) for k in range(10_000)]
    pages = spark.createDataFrame(far + copied, "page_id long, url string, html string").repartition(4)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/a", shard_bytes=100_000, roll_bytes=50_000)
    sizes = [r["records"] for r in manifest.groupBy("shard").agg(F.sum("records").alias("records")).collect()]
    assert len(sizes) > 30 and max(sizes) < 10_400 / 10
    got = warc.read_archives(spark, f"file://{tmp_path}/a").groupBy("record_type", "refers_to").count().collect()
    assert sorted(map(tuple, got), key=str) == [("response", None, 401), ("revisit", 10**6, 9999)]


def test_secrets_in_many_spans(spark):
    text = " ".join(f"{i:032x} key{i} secret=v{i:07d}" for i in range(50_000))
    df = spark.createDataFrame([(1, text, "a"), (2, "x " + text[:400], "b"), (3, None, "a")], "doc_id long, text string, source string")
    began = time.monotonic()
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(df).collect()}
    assert len(got[1]) == 100_000 and secret_text(got[1]) == brute.secrets(text)[3]
    redacted = {r["doc_id"]: r["text"] for r in secret_scan.redact_secrets(df).collect()}
    assert redacted[1] == brute.redacted(text, [(s["start"], s["end"]) for s in got[1] if s["verdict"] == "live"])
    assert redacted[1].count("<secret>") > 90_000 and time.monotonic() - began < 120


def test_redaction_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "x password=abcdef12 y", "a", 7, "k", "z")], "doc_id long, text string, source string, flag int, text_key string, spans string")
    assert [tuple(r) for r in secret_scan.redact_secrets(df).collect()] == [(1, "x <secret> y", "a", 7, "k", "z")]


@pytest.mark.parametrize("run", ["9" * 1_000_000, "a" * 1_000_000, "a." * 500_000, "1." * 500_000, "@" * 1_000_000, "a@" * 500_000, "+1 " * 300_000, "[at]" * 250_000, "A" * 1_000_000 + "[at]"])
def test_long_runs_take_linear_time(run):
    text = "x@y.z " + run + " a [at] b [dot] c @ 1.2.3.4 b@c.d@e.f @g.h@i.j"
    began = time.monotonic()
    got = [(s[2], s[0], s[3]) for s in personal_data.candidates(text) if s[2] in personal_data.BASE]
    assert time.monotonic() - began < 20
    short = run[:3000]
    text = "x@y.z " + short + " a [at] b [dot] c @ 1.2.3.4 b@c.d@e.f @g.h@i.j"
    got = ",".join(f"{s[2]}:{s[0]}:{s[3]}" for s in personal_data.candidates(text) if s[2] in personal_data.BASE)
    assert brute.sha(got) == brute.pii(text)[4]


@pytest.mark.parametrize("seed", range(3))
def test_personal_data_in_random_texts(seed):
    r = random.Random(seed)
    for _ in range(3000):
        text = "".join(r.choice(["a", "b-", ".", "@", "@x.y", "1", "25", "300", ".", " ", "+", "(", "4111 1111 1111 1111", "é", "_", "[at]"]) for _ in range(r.randint(1, 30)))
        got = ",".join(f"{s[2]}:{s[0]}:{s[3]}" for s in personal_data.candidates(text) if s[2] in personal_data.BASE)
        assert brute.sha(got) == brute.pii(text)[4], text


def test_warc_of_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string, shard int")
    assert warc.write_archives(none, f"file://{tmp_path}/a").count() == 0
    assert warc.read_archives(spark, f"file://{tmp_path}/a").count() == 0


def test_least_determinant_against_all_subsets(spark):
    """In small groups, the determinant reached is that of the best of all subsets, or close to it."""
    import numpy as np

    r = np.random.default_rng(5)
    groups = {g: np.vstack([r.normal(size=(11, 4)), r.normal(6, 1, size=(2, 4))]) for g in range(6)}
    rows = [(str(g), *map(float, v)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "g string, v1 double, v2 double, v3 double, v4 double")
    estimates = quality_rules._prepared(quality_rules._starts(df))
    for _ in range(6):
        estimates = quality_rules._concentrated(df, estimates, 0.75)
    got = {x["g"]: x["d"] for x in estimates.groupBy("g").agg(F.min("log_det").alias("d")).collect()}
    for g, x in groups.items():
        best = min(np.linalg.slogdet(np.cov(x[list(s)].T, bias=True) + np.diag(quality_rules.FLOORS))[1] for s in itertools.combinations(range(13), 10))
        assert best - 1e-6 <= got[str(g)] < best + 0.7


def test_moderate_outliers_go_and_small_groups_lean_on_others(spark):
    r = random.Random(4)
    word = lambda: "abcdefg"[r.randrange(7)] * r.randint(2, 8)
    usual = lambda: " ".join(word() for _ in range(r.randint(80, 120)))
    marked = lambda: " ".join(word() + " ##" * (r.random() < 0.5) for _ in range(100))
    rows = [(i, marked() if i < 6 else usual(), "en", "s") for i in range(300)]
    rows += [(1000 + i, usual(), "fr", f"small{i}") for i in range(5)] + [(2000, marked(), "fr", "small5"), (2001, marked(), None, None)]
    got = {x["doc_id"]: x["kept"] for x in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i] for i in (*range(6), 2000, 2001)) and all(got[1000 + i] for i in range(5))
    assert sum(not got[i] for i in range(6, 300)) <= 6


def test_pipeline_decides_on_rows(spark):
    import corpus_pipeline

    def words(seed: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice("abcdefghij") * 3 + str(k % 17) for k in range(60))

    rows = [(1, words(1)), (1, words(2)), (2, words(1) + " more"), (3, words(3)), (3, words(3)), (None, words(3)), (None, words(4)), (4, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7, 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, flag int, row int")
    got = corpus_pipeline.drop_copies(spark, docs, str(DATA))
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(1, words(1)), (1, words(2)), (3, words(3)), (None, words(4)), (4, None), (5, ""), (5, "")], key=str)
    item = spark.read.parquet(str(DATA / "benchmark.parquet")).first()["text"]
    held = spark.createDataFrame([(1, "x " + item), (1, words(1)), (None, item), (None, None)], "doc_id long, text string")
    assert sorted(corpus_pipeline.drop_contaminated(spark, held, str(DATA)).collect(), key=str) == sorted([(1, words(1)), (None, None)], key=str)


def test_pipeline_of_no_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(str(DATA / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(DATA))
    assert docs.count() == 0


def test_classifier_on_held_out_ratings_and_odd_rows(spark, odd):
    ratings = quality_classifier.grades_of(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(ratings.select("doc_id"), "doc_id", "left_semi")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    got = quality_classifier.classify(docs, ratings.where(part != 0)).join(ratings.where(part == 0), "doc_id")
    right = got.where("(grade = 2) = kept").count() / got.count()
    assert right > 0.9
    clashing = odd.withColumn("kept", F.lit("x")).withColumn("verdict", F.lit(1))
    rated = quality_classifier.classify(clashing, ratings)
    assert rated.count() == len(ODD) and rated.select("verdict").distinct().collect() == [(1,)] and dict(rated.dtypes)["kept"] == "boolean"
