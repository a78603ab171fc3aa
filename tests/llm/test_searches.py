"""Hard negatives, spelling variants and top-k search against plain Python, on odd rows; personal data among decoys."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemmaflow.llm import hard_negatives, personal_data, spelling, topk_search, vectors

ROWS = "vec_id long, embedding array<double>, label int, score string, rank int"


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floors(v, scale):
    return [math.floor(scale * x) for x in v]


def held(score):
    return max(min(score, 2**63 - 1), -(2**63) + 1)


def brute_top(rows, scale, k, step):
    good = [(i, floors(v, scale)) for i, v, _ in rows if whole(v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in good if i is not None and i % step == 0}:
        scored = sorted(((-held(sum(a * b for a, b in zip(v, w, strict=True))), i is None, i or 0) for i, w in good if len(w) == len(v) and i != q))
        out |= {(q, tuple(v), r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k])}
    return sorted(((q, r, i, s) for q, _, r, i, s in out), key=str)


def brute_hard(rows, step, n_pos, n_neg):
    good = [(i, floors(v, 256), lab) for i, v, lab in rows if whole(v) and lab is not None]
    out = []
    for q, v, lab in {(i, tuple(v), lab) for i, v, lab in good if i is not None and i % step == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0, x == lab) for i, w, x in good if len(w) == len(v) and i != q))
        own = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for i, w, x in good if len(w) == len(v) and x != lab))
        for p, none, pid in [s[:3] for s in scored if s[3]][:n_pos]:
            fit = [n for n in own if 80 * -p <= 100 * -n[0] <= 100 * -p][:n_neg]
            out += [(q, None if none else pid, r + 1, None if no else i, -p, -s) for r, (s, no, i) in enumerate(fit)]
    return sorted(out, key=str)


def some_rows(seed, n=700, dim=6):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(0, 1), 1) for _ in range(dim)], r.randrange(4)) for i in range(n)]
    rows += [(n + i, [0.5] * dim, i % 3) for i in range(300)]  # very many ties
    rows += [(10, None, 1), (20, [float("nan")] * dim, 1), (30, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (40, [float("inf")] * dim, 1), (50, [1.0] * dim, None)]
    rows += [(60, [0.1, 0.2], 1), (61, [0.3, 0.2], 1), (70, [], 2), (71, [], 1), (None, [0.5] * dim, 1), (None, [3.0] * dim, 2)]
    rows += [rows[0], rows[3]]  # repeated rows
    return r.sample(rows, len(rows))


@pytest.mark.parametrize(("seed", "shard"), [(1, 4096), (2, 64)])
def test_searches_equal_all_pairs(spark, monkeypatch, seed, shard):
    for name, size in (("SHARD", shard), ("BLOCK", shard // 4), ("SLOT", shard // 2), ("TILE", shard // 8)):
        monkeypatch.setattr(vectors, name, size)
    rows = some_rows(seed)
    df = spark.createDataFrame([(*x, "s", 1) for x in rows], ROWS).repartition(5)
    # Small shards and blocks make a grid of many tasks, whose lists are merged in a tree.
    read = lambda d: d.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))
    assert vectors.packed(read(df), 8).count() >= 1000 // shard
    got = topk_search.top_k(df, df.where(vectors.is_every("vec_id", 10)), 7, 8)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 8, 7, 10)
    got = hard_negatives.hard_negatives(df, df.where(vectors.is_every("vec_id", 10)), 4, 3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_hard(rows, 10, 4, 3)


def test_searches_of_large_components_and_of_nothing(spark):
    big = [(0, [1e300, 2.0], 1), (1, [-1e300, 1.0], 1), (2, [3e15, 7.0], 2), (3, [3e9, 1e9], 2), (4, [1e300, 1e300], 1)]
    df = spark.createDataFrame([(*x, "s", 1) for x in big], ROWS)
    cut = [(i, [max(min(x, 2.0**62 / 1024), -(2.0**62) / 1024) for x in v], lab) for i, v, lab in big]
    assert sorted(map(tuple, topk_search.top_k(df, df, 10).collect()), key=str) == brute_top(cut, 1024, 10, 1)
    none = df.limit(0)
    for rows, queries in ((none, none), (df, none), (none, df)):
        assert topk_search.top_k(rows, queries).isEmpty() and hard_negatives.hard_negatives(rows, queries).isEmpty()


def test_trees_prune_and_hold_all_rows():
    r = np.random.default_rng(5)
    points = np.concatenate([r.integers(-50, 50, (500, 4)) + c for c in (0, 4000, -4000)]).astype(np.int64)
    ids, unnamed, labels = np.arange(1500), np.zeros(1500, bool), np.repeat([1, 2, 66], 500)
    order, tree = hard_negatives.plant(ids, unnamed, points, labels)
    assert sorted(order) == list(range(1500))
    shard = vectors.Shard({"ids": ids[order].tobytes(), "unnamed": unnamed.tobytes(), "labels": labels[order].tobytes(), "dim": 4, "width": 8, "vectors": points[order].tobytes(), "tree": tree})
    seen = []
    query = np.array([[1.0, 1.0, 1.0, 1.0]])
    best = np.sort((points @ query[0]))[-5]
    hard_negatives.Tree(shard).walk(query, lambda node, at, low, high: high >= best, lambda start, end, at: seen.append((start, end)))
    assert sum(e - s for s, e in seen) < 600  # the other two clouds are never read
    exact = {k for s, e in seen for k in range(s, e)}
    assert {k for k in range(1500) if shard.vectors[k] @ query[0] >= best} <= exact


def brute_words(docs):
    n = Counter()
    for own, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if own is None else own}:{run}".encode())
                n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
                run = ""
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    of = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: min(of[w], key=lambda x: (-n[x], x)) if of[w] else None for w in n}
    form = {w: f if f is not None and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], len(of[w]), n[form[w]] if form[w] else None) for w in n), key=str)


@pytest.mark.parametrize("block", [4096, 5])
def test_variants_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    r = random.Random(block)
    stems = ["abababa", "aaaaaaaa", "élevation", "mountains", "straßeßig", "interest", "interested"]
    docs = []
    for k in range(300):
        words = []
        for _ in range(r.randint(1, 40)):
            w = list(r.choice(stems)) if r.random() < 0.9 else [r.choice("ab") for _ in range(r.randint(6, 9))]
            for _ in range(r.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = r.choice(["", "a", "é", "x"])
            words.append("".join(w))
        docs.append((k, " ".join(words).replace("x", "X")))
    docs += [(None, "Mountains mountains"), (7, None), (8, ""), (9, "İnterest ÿÿÿÿÿÿÿ×÷ ÿÿÿÿÿÿÿ"), docs[0], (10, "mountain" * 20_000)]
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n int, word string").repartition(3)
    counted = spelling.counted_words(df)
    n = brute_words(docs)
    assert {x["word"]: x["n"] for x in counted.collect()} == n
    assert sorted(map(tuple, spelling.variants(counted).collect()), key=str) == brute_variants(n)
    assert spelling.variants(spelling.counted_words(df.limit(0))).isEmpty()


def test_short_words_and_long_chains(spark):
    n = {"cat": 1000, "cot": 100, "cut": 9, "at": 10, "a": 1, "b": 50, "": 3, "dogs": 1, "dots": 10, "dots!": 100, "dotss": 1000, "dotsss": 10_000}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert sorted(map(tuple, got.where("word <> ''").collect()), key=str) == [x for x in brute_variants({k: v for k, v in n.items() if k})]


def test_often_is_a_count():
    r = random.Random(1)
    for _ in range(300):
        lists = [sorted(r.sample(range(30), r.randint(0, 20))) for _ in range(r.randint(1, 8))]
        times = r.randint(1, 5)
        assert list(spelling.often(lists, times)) == sorted(x for x, k in Counter(v for own in lists for v in own).items() if k >= times)


def test_personal_data_among_decoys(spark):
    r = random.Random(2)
    digits = lambda n: "".join(r.choice("23456789") for _ in range(n))
    rows, real, decoys = [], set(), set()
    for k in range(400):
        number = f"{digits(3)}-{digits(3)}-{digits(4)}"
        if k % 4 == 0:
            rows.append((k, f"please write to jo{k} [at] mail{k} [dot] com for more"))
            real.add(k)
        elif k % 4 == 1:
            rows.append((k, f"you can call my mobile phone {number} today"))
            real.add(k)
        elif k % 4 == 2:
            rows.append((k, f"the parcel of order 0{number[1:]} was sent"))
            decoys.add(k)
        else:
            rows.append((k, f"mail a{k}@b.org, phone +1 (555) 010-{1000 + k}"))
    got = {x["doc_id"]: x["spans"] for x in personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([s["kind"] in ("masked_email", "local_phone") for s in got[k]] == [True] for k in real)
    assert not any(got[k] for k in decoys)
    assert all([s["kind"] for s in got[k]] == ["email", "phone"] for k in range(3, 400, 4))
