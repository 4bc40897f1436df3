"""The training-data operators against brute force, round trips and held-out labels, and at their edges."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import re
import tempfile
import tracemalloc
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from oracle import connect, duck_digest, spark_digest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import bpe, langid, lattice, minhash, packing, quality, queries, repeats, search, toxicity, warc
from tickloom.llm.common import components, crc_of, once_per_worker, table

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RANKS, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [
    "", " ", "a", "A a", "  x\n\n y\t", "don't I'll WE'RE 's", "x\x1cy \x1d z²½ Ⅷ9a_b", "日本語 テスト 12３", "a" * 3000,
    "ab" * 700 + " " * 90 + "é" * 200, "́abc​ d\x00e", "😀😀👍🏽 ok", "İstanbul ΣΑΣ ﬁ ẞ", "<|endoftext|> x", LONG,
]


def odd_documents(spark):
    """Nulls in every column, empty, odd and long texts, repeated rows, rows that share an id, columns that clash."""
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(3, "A a"), (50, None), (None, None), (None, "no id here"), (60, LONG), (61, LONG + " and more"), (62, "other text"), (62, "text other")]
    kind = "doc_id long, text string, lang string, score double, digest string, names array<long>, row int, label int"
    return spark.createDataFrame([(i, t, None, 0.5, "d", [1], 7, None) for i, t in rows], kind)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def documents(spark, sf=SMALL):
    return table(spark, sf, "documents")


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_queries_equal_their_sql(spark, name):
    for sf in (SMALL, MIDDLE):
        assert spark_digest(queries.all_queries()[name](spark, sf)) == duck_digest(connect(sf), queries.all_oracles()[name])


def test_components_of_stars_chains_and_rings(spark):
    edges = [(1, n) for n in range(2, 40)] + [(n, n + 1) for n in range(100, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5), (9, 9)]
    edges += [(350 - n, 351 - n) for n in range(40)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[n] for n in range(1, 40)} == {1} and {got[n] for n in range(100, 141)} == {100}
    assert {got[n] for n in (200, 201, 202)} == {200} and {got[n] for n in range(311, 352)} == {311}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings ----------------------------------------------------------------


def brute_vectors(rows, least):
    links = collections.defaultdict(set)
    for a, (_, v, l) in enumerate(rows):
        for b, (_, w, m) in enumerate(rows[:a]):
            if l is not None and l == m and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].add(b)
                    links[b].add(a)
    return links


def test_lattice_points_are_nearest(spark):
    short = lattice.minimal_vectors()
    assert short.shape == (240, 8) and {int((v * v).sum()) for v in short} == {8}
    x = np.random.default_rng(1).normal(0, 2, (500, 8))
    near = lattice.nearest(x)
    gap = ((x - near / 2) ** 2).sum(axis=1)
    for v in short:
        assert (((x - (near + v) / 2) ** 2).sum(axis=1) >= gap - 1e-9).all()


def test_vectors_link_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 24))
    rows = [(100 + i, (base[i % 12] + rng.normal(0, 0.06, 24)).tolist(), i % 2) for i in range(140)]
    rows += [(300 + i, base[0].tolist(), 0) for i in range(9)] + [(400, (base[0] * 3).tolist(), 0), (401, base[0].tolist(), 1)]
    good = list(rows)
    bad = [(500, None, 0), (501, [0.0] * 24, 0), (502, [], 0), (503, [float("nan")] * 24, 0), (504, [None, 1.0], 0), (505, base[0].tolist(), None)]
    bad += [(506, [float("inf")] + [1.0] * 23, 0), (None, base[0].tolist(), 0)]
    extra = [(*r, 9, "x") for r in good + bad]
    df = spark.createDataFrame(extra, "vec_id long, embedding array<double>, label int, id int, name string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(df).collect()}
    links = brute_vectors(good, 0.98)
    reach = {}
    for a in range(len(good)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        first = min(good[b][0] for b in seen)
        reach[good[a][0]] = (len(links[a]), first, first == good[a][0])
    assert {k: v for k, v in got.items() if k in reach} == reach
    assert all(got[r[0]] == (0, r[0], True) for r in bad)
    assert lattice.near_vectors(df.limit(0)).count() == 0


# --- archives ------------------------------------------------------------------


def test_archives_come_back_as_written(spark, folder):
    page = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"
    rows = [(5, "http://a/", page), (3, "http://b/", page), (9, None, page), (9, None, page), (1, "u", "small"), (2, "u", "small"), (4, "x\r\ny", None), (None, None, None)]
    rows += [(7, "http://c/", "é" * 99_999), (8, "http://c/", ""), (6, "http://a/", page + " ")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archives(df, folder + "/archives")
    captures = warc.assemble(warc.read_archives(spark, folder + "/archives"))
    got = {}
    for c in captures.collect():
        number = re.search(r"page-id: (-?\d+)", c["metadata"]["block"])
        got[int(number[1]) if number else None] = c
        assert c["request"]["block"].startswith("GET ")
    assert set(got) == {r[0] for r in rows}
    for page_id, _, html in rows:
        answer, want = got[page_id]["response"], html or ""
        assert answer["digest"] == hashlib.sha256(want.encode()).hexdigest() and answer["payload_bytes"] == len(want.encode())
        if page_id in (5, 9):
            assert answer["type"] == "revisit" and answer["refers_to"] == got[3]["response"]["record_id"] and answer["payload"] is None
        else:
            assert answer["type"] == "response" and answer["payload"] == want
    digests = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.page_digests(df).collect()}
    assert digests[5] == ("revisit", 3) and digests[1] == digests[2] == ("response", None) and len(digests) == len(got)
    assert warc.page_digests(df.limit(0)).count() == 0


# --- languages -----------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    got = queries.all_queries()["op3_languages"](spark, MIDDLE).join(documents(spark, MIDDLE).select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count() > 0


def test_mixtures_find_their_parts():
    rng = np.random.default_rng(3)
    table_ = np.log(rng.dirichlet(np.ones(50), 4)).astype(np.float32)
    draw = lambda k, n: rng.choice(50, n, p=np.exp(table_[k]) / np.exp(table_[k]).sum())
    one, two = draw(1, 400), np.concatenate([draw(0, 300), draw(2, 200)])
    share = langid.mixtures(table_[:, np.concatenate([one, two])].T, np.array([0, 400, 900]))
    assert share[0].tolist() == [0, 1, 0, 0]
    assert abs(share[1][0] - 0.6) < 0.1 and abs(share[1][2] - 0.4) < 0.1 and share[1][[1, 3]].sum() < 0.05


def test_languages_at_the_edges(spark):
    model = langid.learn(documents(spark), F.lit(True))
    got = langid.identify(odd_documents(spark), model)
    assert got.columns[:1] == ["doc_id"] and got.count() == odd_documents(spark).count()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.filter("doc_id < 51").collect()}
    assert by[0] == by[1] == by[50] == ("und", 0.0)
    assert all(0 <= s <= 1 and p in model.names for k, (p, s) in by.items() if k not in (0, 1, 50, 11)), by
    nothing = langid.learn(documents(spark), F.lit(False))
    assert langid.identify(documents(spark), nothing).filter("lang_pred <> 'und' OR score <> 0").isEmpty()
    assert langid.identify(documents(spark).limit(0), model).count() == 0


# --- search --------------------------------------------------------------------


def test_search_equals_scoring_everything(spark, monkeypatch):
    monkeypatch.setattr(search, "POSTINGS", 2000)
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "ROUND", 1)
    docs = {r["doc_id"]: r["text"] for r in documents(spark).limit(120).collect()} | {900: "", 901: None, 902: "a A a b"}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = {d: collections.Counter(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(lower))) for d, t in docs.items()}
    df = collections.Counter(t for c in terms.values() for t in c)
    n, mean = len(docs), sum(sum(c.values()) for c in terms.values()) / len(docs)
    want = []
    for q in (d for d in docs if d % 10 == 0):
        scores = collections.Counter()
        for t in terms[q]:
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            for d, c in terms.items():
                if c[t]:
                    norm = 1.2 * (1 - 0.75 + 0.75 * sum(c.values()) / mean)
                    scores[d] += math.floor(idf * (c[t] * 2.2 / (c[t] + norm)) * 1_000_000 + 0.5)
        best = sorted(scores, key=lambda d: (-scores[d], d))[:10]
        want += [(q, i + 1, d, scores[d] / 1_000_000) for i, d in enumerate(best)]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id long, text string, terms string")
    got = rows_of(search.top_k(frame, F.col("doc_id") % 10 == 0), "query_id", "rank", "doc_id", "score")
    assert got == sorted(want, key=repr)
    assert search.top_k(frame.limit(0), F.lit(True)).count() == 0
    assert search.top_k(odd_documents(spark), F.col("doc_id") < 5).filter("query_id = 3 AND rank = 1 AND doc_id = 3").count() == 1


# --- quality and toxicity --------------------------------------------------------


def test_quality_of_held_out_documents(spark):
    got = queries.all_queries()["op5_ordinal_quality"](spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id")
    held = got.filter("held_out")
    assert held.filter("kept = (quality = 1)").count() >= 0.97 * held.count() > 0
    assert got.filter("expected_grade < 0 OR expected_grade > 2 OR tail < 0 OR tail > 1").isEmpty()


def test_thresholds_keep_their_order_and_the_gradient_is_right():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5))
    y = np.digitize(x @ [2, -1, 0, 0, 1] + rng.logistic(size=600), [-2, 0, 0.5])
    p = rng.normal(0, 0.3, 8)
    loss, grad = quality._loss(p, x, y, 3)
    for i in range(len(p)):
        step = np.zeros(8)
        step[i] = 1e-5
        assert abs((quality._loss(p + step, x, y, 3)[0] - quality._loss(p - step, x, y, 3)[0]) / 2e-5 - grad[i]) < 1e-5
    weights, thresholds = quality.fit(x, y, 3)
    assert (np.diff(thresholds) > 0).all() and np.abs(thresholds - [-2, 0, 0.5]).max() < 0.6 and weights[0] > 1 > 0 > weights[1]


def test_toxicity_of_held_out_documents(spark):
    got = queries.all_queries()["op9_toxicity"](spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id")
    held = got.filter("held_out")
    toxic, clean = held.filter("toxic = 1"), held.filter("toxic = 0")
    assert toxic.filter("predicted = 1").count() >= 0.9 * toxic.count() > 0
    assert clean.filter("predicted = 0").count() >= 0.99 * clean.count() > 0


def test_folding_terms_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot": 3.0, " kys ": 5.0}, [" idiot savant "], (-2.0, 1.0, 1.0, 1.0, 1.0))
    found = toxicity.automaton(lexicon)
    texts = ["1D10T!", "ѕome іdíоts", "an idiot savant spoke", "idiot savants", "kys", "kysx", "videoidiot", "", "IDIOT idiot"]
    whole, bounds, words = toxicity.folded(texts)
    at, weight = toxicity.hits(found, whole)
    sums = np.bincount(np.searchsorted(bounds, at, "right") - 1, weight, len(texts))
    assert sums.tolist() == [3, 3, 0, 3, 5, 0, 0, 0, 6]
    assert words.tolist() == [1, 2, 4, 2, 1, 1, 1, 0, 2]


def test_scores_at_the_edges(spark):
    docs, labels = documents(spark), table(spark, SMALL, "labels")
    lexicon = toxicity.learn(docs, labels, F.lit(True))
    odd = odd_documents(spark)
    got = toxicity.score(odd, lexicon)
    assert got.count() == odd.count() and got.filter("score IS NULL OR score < 0 OR score > 1").isEmpty()
    nulls = labels.select("doc_id", F.lit(None).cast("int").alias("toxic"), F.lit(None).cast("int").alias("grade"))
    none = toxicity.learn(docs, nulls, F.lit(True))
    assert none.terms == {} and toxicity.score(docs.limit(0), none).count() == 0
    grades = quality.learn(docs, nulls, F.lit(True))
    assert quality.grade(odd, grades).filter("expected_grade <> 0").isEmpty()
    model = quality.learn(docs, labels.withColumn("grade", F.col("quality")), F.lit(True))
    assert quality.grade(odd, model).count() == odd.count() and quality.grade(docs.limit(0), model).count() == 0


# --- near copies ---------------------------------------------------------------


def brute_groups(docs, size, percent):
    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()

    sets = [(d, shingles(t)) for d, t in docs]
    top = {d: d for d, _ in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                top[q] = p
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies_as_by_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "PART", 32)
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, 90)) for _ in range(6)]
    docs = []
    for i in range(260):
        text = list(base[0 if i % 2 else i % 6])
        for j in rng.choice(len(text), rng.integers(0, 5), replace=False):
            text[j] = str(rng.choice(vocabulary))
        docs.append((1000 - i, " ".join(text) if i % 3 else "  ".join(text).upper()))
    docs += [(i, t) for i, t in enumerate(ODD)] + [(40, None), (41, LONG), (42, LONG + " x")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_shingles int")
    got = minhash.near_duplicates(frame, size)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute_groups(docs, size, 80), key=repr)


def test_near_copies_among_rows_of_one_template(spark, monkeypatch):
    """Lone pairs of similarity 0.82 among rows that share 80 % of their words: in regions of any size."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "PART", 32)
    rng = np.random.default_rng(11)
    template = [f"t{i}" for i in range(72)]
    docs, pairs = [], {}
    for i in range(2000):
        text = template + [f"u{i}x{j}" for j in range(18)]
        docs.append((i, text))
        if i % 25 == 0:
            pairs[10_000 + i] = i
            docs.append((10_000 + i, text[:-9] + [f"y{i}x{j}" for j in range(9)]))
    # a group of many copies beside them
    docs += [(20_000 + i, [f"c{j}" for j in range(86)] + [f"c{i}x{j}" for j in range(4)]) for i in range(600)]
    rng.shuffle(docs := [(d, " ".join(t)) for d, t in docs])
    frame = spark.createDataFrame([(int(d), t) for d, t in docs], "doc_id long, text string")
    got = dict(minhash.near_duplicates(frame, 2).select("doc_id", "component_id").collect())
    assert got == {int(d): pairs.get(int(d), 20_000 if int(d) >= 20_000 else int(d)) for d, _ in docs}


def test_a_lone_pair_at_the_threshold_is_hardly_missed():
    error = math.sqrt(0.8 * 0.2 / minhash.LENGTH)
    assert (1 - 0.8**minhash.LEAST_DEPTH) ** minhash.TREES < 2e-5 and minhash.SLACK > 5 * error
    size = np.array([80, 100, 79])
    assert minhash._fits(size, size[1], 80).tolist() == [True, True, False]
    signature = np.ones((3, minhash.LENGTH), np.uint16)
    assert {(min(i, j), max(i, j)) for i, j, _ in minhash._strongest(signature, size, 0.6, 80)} == {(0, 1), (0, 2)}


def test_near_copies_at_the_edges(spark):
    got = collections.defaultdict(set)
    for r in minhash.near_duplicates(odd_documents(spark), 2).collect():
        got[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert got[None] == {(None, True)} and got[0] == {(0, True)} and got[50] == {(50, True)}
    assert got[14] == {(14, True)} and got[60] == got[61] == {(14, False)} and got[62] == {(62, True)} and got[3] == {(3, True)}
    assert minhash.near_duplicates(odd_documents(spark).limit(0)).count() == 0


def test_search_with_one_giant_text_and_many_small_shards(spark, monkeypatch):
    """Shards of few postings and blocks of few documents find what one of all does."""
    rows = [(100, " ".join(str(i) for i in range(1_000_000)))] + [(i, f"{i} {i % 7} common {'word ' * (i % 5)}") for i in range(101, 700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = rows_of(search.top_k(frame, F.col("doc_id") % 100 == 0), "query_id", "rank", "doc_id", "score")
    for name, value in (("POSTINGS", 300), ("BLOCK", 4), ("FIRST", 1), ("COMMON", 3), ("BLOCK_TERMS", 20), ("ROUND", 2), ("WIDER", 2)):
        monkeypatch.setattr(search, name, value)
    frame = frame.filter("doc_id > 100")
    few = rows_of(search.top_k(frame, F.col("doc_id") % 100 == 0), "query_id", "rank", "doc_id", "score")
    monkeypatch.undo()
    assert few == rows_of(search.top_k(frame, F.col("doc_id") % 100 == 0), "query_id", "rank", "doc_id", "score")
    assert [w for w in want if w[0] == 100][0][:3] == (100, 1, 100) and len([w for w in want if w[0] == 100]) == 10


# --- repeated strings ------------------------------------------------------------


def brute_repeats(docs, length):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = collections.Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        cut = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                cut[s : s + length] = b"\1" * length
        left = bytes(x for x, y in zip(b, cut, strict=True) if not y)
        runs = sum(1 for i, y in enumerate(cut) if y and not (i and cut[i - 1]))
        out.append((d, len(b), sum(cut), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "short", "runs"), [(400, 50, 2048), (30, 8, 1), (12, 5, 3)])
def test_repeated_strings_as_by_brute_force(spark, monkeypatch, length, short, runs):
    monkeypatch.setattr(repeats, "RUNS", runs)
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    docs = docs if length == 400 else [(d, t[:700]) for d, t in docs[:60]]
    docs += [(1000 + i, t[:4000]) for i, t in enumerate(ODD)] + [(2000, None), (2001, "line of text\n" * 200), (2002, "y" * 399), (2003, "z" * 400), (2004, "z" * 401)]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, digest string, runs int")
    got = rows_of(repeats.removed(repeats.repeats(frame, length, short)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(docs, length)


def test_removal_gives_the_text_that_is_left(spark):
    """Every row gives the text that is left: copies, null ids, rows that come twice, cuts within characters."""
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(450))
    docs = [(1, f"one,{passage} two"), (2, f"three:{passage}"), (3, passage[:399]), (4, "same " * 90), (4, "same " * 90), (5, "same " * 90)]
    docs += [(None, f"{passage};four"), (None, None), (6, None), (7, ""), (7, "short"), (8, "short"), (None, "short"), (9, "ab\u00e9" + "x" * 399), (10, "b\u0129" + "x" * 399)]
    docs += [(None, "same " * 90), (None, "same " * 90)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = rows_of(repeats.removed(repeats.repeats(frame)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text")
    assert [r[:5] for r in got] == brute_repeats(docs, 400) and len(got) == len(docs)
    texts = collections.Counter((r[0], r[-1]) for r in got)
    want = [(1, "one, two"), (2, "three:"), (3, passage[:399]), (4, ""), (4, ""), (5, ""), (None, ";four"), (None, ""), (6, ""), (7, ""), (7, "short"), (8, "short")]
    # é and ĩ end in the same byte, which goes with the 399 after it; their first bytes are no text
    want += [(None, "short"), (9, "ab"), (10, "b"), (None, ""), (None, "")]
    assert texts == collections.Counter(want)
    halves = {(9, "ab"): 1, (10, "b"): 1}
    for _, n_bytes, n_removed, n_spans, digest, spans, text in (r for r in got if (r[0], r[-1]) not in halves):
        assert hashlib.sha256(text.encode()).hexdigest() == digest and len(text.encode()) == n_bytes - n_removed
        assert sum(b - a for a, b in spans) == n_removed and len(spans) == n_spans


def brute_passages(docs, length, words):
    """Texts without stretches of more than ``words`` words whose strings stand in another text too."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    holders = collections.defaultdict(set)
    for d, b in raw:
        for s in range(len(b) - length + 1):
            holders[b[s : s + length]].add(d)
    out = []
    for d, b in raw:
        cut = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if len(holders[b[s : s + length]]) > 1:
                cut[s : s + length] = b"\1" * length
        left, at = [], 0
        for m in re.finditer(b"\1+", bytes(cut)):
            if len(b[m.start() : m.end()].split()) > words:
                left.append(b[at : m.start()])
                at = m.end()
        out.append((d, "".join(p.decode(errors="ignore") for p in [*left, b[at:]])))
    return sorted(out, key=repr)


def test_passages_of_many_words_that_stand_in_several_texts(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghé"), rng.integers(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short, page = text(60), text(45), text(30)
    docs = [(i, f"{text(20)} {long if i % 3 == 0 else short if i % 3 == 1 else page} {text(int(rng.integers(0, 40)))}") for i in range(60)]
    # one that repeats only itself stays whole, and so does what shares little
    docs += [(100, " ".join([text(70)] * 2)), (101, "la " * 300), (102, text(400)), (103, ""), (104, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(repeats.without_repeats(frame, 100, words=50, across=True).na.fill(""), "doc_id", "text")
    want = brute_passages(docs, 100, 50)
    assert got == want and sum(long in (t or "") for _, t in got) == 0
    assert dict(got)[100] == docs[60][1] and dict(got)[1] == docs[1][1]


def test_a_passage_in_a_third_of_all_texts(spark):
    """Copies of the passage travel once for each slab; the result is that of brute force."""
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(700))
    docs = [(i, (passage if i % 3 == 0 else "") + f"{i}:" + str(i) * (i % 50)) for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = repeats.repeats(frame)
    assert rows_of(repeats.removed(found), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(docs, 400)


def test_texts_without_their_repeated_strings(spark):
    passage = "é" * 300
    rows = [(1, "a" + passage + "b"), (2, "c" + passage + "d"), (3, "same " * 100), (3, "same " * 100), (None, None), (None, "x"), (4, "")]
    frame = spark.createDataFrame([(i, t, 9, "q") for i, t in rows], "doc_id long, text string, n_chars long, _text string")
    got = repeats.without_repeats(frame)
    assert got.columns == frame.columns
    assert rows_of(got, "doc_id", "text", "n_chars") == sorted([(1, "ab", 2), (2, "cd", 2), (3, "", 0), (3, "", 0), (None, None, None), (None, "x", 1), (4, "", 0)], key=repr)
    assert repeats.without_repeats(frame.limit(0)).count() == 0


# --- tokens --------------------------------------------------------------------


def test_encoding_equals_the_library_and_decodes(spark):
    ranks = bpe.Ranks.read(RANKS).tokens
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark).select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    ids = bpe.encode(docs.withColumn("ids", F.lit(1)).withColumn("again", F.col("text")), RANKS, public_tokenizers.PATTERN)
    got = bpe.decode(ids.select("again", "ids", F.col("ids").alias("kept")), RANKS).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r["again"] or ""
        assert np.frombuffer(r["kept"], "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_a_vocabulary_whose_merges_run_ahead():
    """A pair that a merge makes may rank below it: then places depend on their order, as in one word alone."""
    tokens = {bytes([b]): b for b in range(256)} | {b"abab": 256, b"ab": 257, b"ba": 258, b"aba": 259, b"bab": 260}
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=tokens, special_tokens={})
    words = bpe.Ranks(tokens).words(r"\S+|\s+")
    words.split = re.compile(r"\S+|\s+").findall
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("ab "), n)) for n in rng.integers(0, 60, 400)]
    ids, bounds = words.encode(texts)
    for t, low, high in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[low:high].tolist() == library.encode_ordinary(t)


def test_pieces_tile_documents_and_windows(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    docs = documents(spark).select("doc_id", "text", F.lit("x").alias("place")).unionByName(
        odd_documents(spark).filter("doc_id IN (50, 60) OR doc_id < 15 AND doc_id <> 3").select((F.col("doc_id") + 5000).alias("doc_id"), "text", F.lit("x").alias("place"))
    )
    got = packing.pack(packing.cut(docs, WORDS)).collect()
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, packing.END], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(r["length"] for r in got)
    assert 1 - used / (2048 * len(by_window)) < 0.05
    assert packing.pack(packing.cut(docs.limit(0), WORDS)).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted(r["length"] for r in packing.pack(packing.cut(twice, WORDS)).collect()) == [1, 1, 3, 3]


def test_added_tokens_are_ids_as_in_the_library(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    texts = ["<|endoftext|> x", "a<|ENDOFTEXT|>b", "a <|endoftext|><|startoftext|>  b", "e<|endoftext|>\u0301's", "<|endoftext", "", "x"]
    ids, bounds = packing.word_bpe(WORDS, added=True).encode(texts)
    wanted = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == wanted
    folder = tempfile.mkdtemp(prefix="run-")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = queries.all_queries()["op7_differencing"](spark, folder).select("doc_id", "doc_tokens").distinct().collect()
    assert dict(got) == {i: len(w) + 1 for i, w in enumerate(wanted)}


def test_words_are_split_and_numbered_in_bulk(monkeypatch):
    """The words of many texts are one Arrow array, as by the library's expression, and keep their numbers between blocks."""
    exact = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    rng = np.random.default_rng(8)
    letters = [*"'smtdrevlab  \n\t19!._-é²日Ⅷ٣😀", "'", "'", "́", "\x1c", "\x85", "'re", "'ll", "<|endoftext|>", "<|end"]
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 30, 3000)] + [*ODD, "'", "x'", "'s's", "''s", "'r", "'"]
    monkeypatch.setattr(packing, "SPLIT", 500)
    found, bounds = packing.word_bpe(WORDS).words(texts)
    assert isinstance(found, pa.Array)
    for t, low, high in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        folded = unicodedata.normalize("NFC", t).replace("Σ", "σ").lower()
        assert [w.decode() for w in found[low:high].to_pylist()] == exact.findall(folded)
    tokenizer = Tokenizer.from_file(WORDS)
    wanted = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for kept in (0, 1_000_000):
        monkeypatch.setattr(packing, "KEPT_WORDS", kept)
        words, got = packing.word_bpe(WORDS, added=True), []
        for at in range(0, len(texts), 700):
            ids, ends = words.encode(texts[at : at + 700])
            got += [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert got == wanted
        assert len(words.known) == len(words.bounds) - 1 == len(words.known.unique()) and (len(words.known) > 0) == (kept > 0)
    assert [len(x) for x in words.encode([])] == [0, 1]


def test_a_large_batch_is_cut_in_bounded_memory(monkeypatch):
    """Spark hands over 10,000 rows at once: what is held follows blocks of text, not the batch, and blocks don't show in the result."""
    rng = np.random.default_rng(9)
    known = np.array(["".join(rng.choice(list("etaoinshr'd1"), n)) for n in rng.integers(1, 9, 20_000)])
    texts = [" ".join(rng.choice(known, 700)) for _ in range(4_500)]
    size = sum(map(len, texts))
    batch = pa.record_batch({"row": pa.array(range(len(texts))), "text": pa.array(texts)})
    del texts
    cut = lambda b: [r for out in packing._cut(WORDS, 2048, True)([b]) for r in out.to_pylist()]
    head, got = batch.slice(0, 300), []
    for block in (1 << 14, 1 << 30):
        with monkeypatch.context() as m:
            m.setattr(packing, "TEXT", block)
            got.append(cut(head))
    assert got[0] == got[1] == cut(head)
    tracemalloc.start()
    try:
        n = sum(out.num_rows for out in packing._cut(WORDS, 2048, True)([batch]))
        left, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    print(f"{size >> 20} MB of text: peak {peak >> 20} MB, left {left >> 20} MB")
    assert n == 4_500 and size > 12 << 20 and peak < 4 * size
    assert not len(once_per_worker(f"words {WORDS} True", None).known)


def test_differencing_keeps_every_item_and_evens_out():
    rng = np.random.default_rng(7)
    for n, windows in ((1, 1), (1, 4), (5, 2), (40, 7), (300, 31)):
        sizes = rng.integers(1, 200, n)
        at, sums = packing.differenced(sizes.copy(), windows)
        assert (np.bincount(at, sizes, windows) == sums).all()
    assert sums.max() - sums.min() <= 20
    at = packing.packed(np.array([1500, 1500, 1500]), 2048)
    assert sorted(at) == [0, 1, 2] and packing.packed(np.array([], int), 2048).size == 0


# --- pipeline ------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents(spark, MIDDLE).withColumn("score", F.lit(1)).withColumn("row", F.lit("x"))
    columns = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, MIDDLE, "labels").collect()}
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, MIDDLE).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if name == "toxicity":
            left = {r["doc_id"] for r in docs.collect()}
            assert sum(t == 0 and d not in left for d, t in labels.items()) <= 2
            assert sum(t == 1 and d in left for d, t in labels.items()) <= 0.5 * sum(labels.values())
        if name == "language":
            before = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        if name == "near copies":
            kept = {d for d, _, _, k in brute_groups(before, 5, 80) if k} if len(before) < 1200 else None
            assert kept is None or {r["doc_id"] for r in docs.collect()} == kept
            before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "repeated strings":
            want = brute_passages(before, corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)
            assert rows_of(docs, "doc_id", "text") == want
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, MIDDLE)
    assert pieces.select("doc_id").distinct().count() == sizes[-1] == sizes[-2]
    empty = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, SMALL)
        assert empty_out.count() == 0


def test_pipeline_at_the_edges(spark):
    import corpus_pipeline

    docs = odd_documents(spark).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    assert "digest" in docs.columns and docs.count() > 0
