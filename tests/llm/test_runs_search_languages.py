"""Periodic runs and lexical search against brute force; the language field by numbers and held-out rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import langid, lexical, periods, queries

DOC = "doc_id long, text string"


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            part = words[at : at + length]
            if end > at and length >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((at, length, q))
            at = max(end, at + 1)
    return sorted(out)


def brute_collapse(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def periodic_words(rng):
    k = rng.choice([1, 2, 3, 8])
    words = [rng.randrange(k) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(words) + 1)
        words[at:at] = [rng.randrange(k) for _ in range(rng.randrange(1, 12))] * rng.randrange(3, 7)
    return [b"%d" % w for w in words]


def test_runs_of_small_alphabets_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        texts = [periodic_words(rng) for _ in range(rng.randrange(1, 4))]
        assert periods._batch(texts) == [brute_runs(t) for t in texts]


def test_every_word_of_a_run_is_covered():
    rng = random.Random(6)
    for _ in range(200):
        words = periodic_words(rng)
        held = periods.covered(np.array([int(w) for w in words], np.int64)) if words else np.empty(0, bool)
        assert all(held[s : s + n].all() for s, n, _ in brute_runs(words))


def test_segments_crossed_stay_few():
    """The paths of a text of one word are as deep as it is long; access must not walk them."""
    a, b = ["0"], ["0", "1"]
    while len(b) < 8000:
        a, b = b, b + a
    for codes in ([0] * 8000, [k % 97 for k in range(8000)], [int(c) for c in b[:8000]]):
        automaton = periods.SuffixAutomaton(codes)
        paths = periods.PathColours(automaton.link)
        crossed = sum(len(paths.access(s, k)) for k, s in enumerate(automaton.prefix))
        assert crossed <= 4 * len(codes) * math.log2(len(codes))


def test_find_has_defined_results(spark):
    words = " ".join(["x y z"] * 5)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, words), (4, words), (4, "other " + words), (None, words), (5, "a " * 20_000 + "b"), (6, "ä b " * 6)]
    frame = spark.createDataFrame([(*r, "kept", 7) for r in rows], DOC + ", runs string, _body int")
    got = periods.find(frame).collect()
    assert len(got) == len(rows)
    for (doc_id, text), r in zip(rows, got, strict=True):
        own = (text or "").encode().split()
        runs = [(x.start, x.length, x.period) for x in r.runs]
        assert r.doc_id == doc_id
        if len(own) < 1000:
            assert runs == brute_runs(own)
            assert r.collapsed.encode() == brute_collapse([w.decode() for w in own], runs).encode()
    assert [tuple(x) for x in got[7].runs] == [(0, 20_000, 1)] and got[7].collapsed == "a b"
    assert periods.find(frame.limit(0)).count() == 0
    assert [r.runs for r in frame.transform(lambda d: periods.find(d.drop("runs"), ("doc_id", "_body"))).collect()] == [r.runs for r in got]


def test_longest_run_breaks_ties(spark):
    rows = [(1, [(9, 8, 2), (20, 8, 1)]), (2, [(3, 8, 1), (3, 8, 2)]), (3, []), (4, [(0, 6, 1), (9, 7, 1)])]
    got = spark.createDataFrame(rows, f"id int, runs array<{periods.RUN}>").select("id", periods.longest(F.col("runs")).alias("r"))
    assert {r.id: r.r and tuple(r.r) for r in got.collect()} == {1: (9, 8, 2), 2: (3, 8, 1), 3: None, 4: (9, 7, 1)}


def test_run_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(str(rng.randrange(40)) for _ in range(rng.randrange(0, 90)))) for k in range(300)] + [(None, "a"), (-5, "b b b b b b"), (7, None)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        digest = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, brute_collapse(words, runs))]
        want.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest))
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute_search(docs, items):
    tf = [Counter(plain_terms(t)) for _, t in docs]
    n = sum(1 for c in tf if c)
    total = sum(sum(c.values()) for c in tf)
    df = Counter(t for c in tf for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), c in zip(docs, tf, strict=True):
            if not c:
                continue
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[: lexical.TOP], 1)]
    return out


def search_corpus():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["Éa", "éa", "a_b", "THE", "the", "naïve x"]
    docs = [(k % 180, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for k in range(200)]
    docs += [(1000, None), (1001, ""), (1002, "-- !!"), (None, "w1 w2"), (5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2"), (1003, "w1\x00w2w1 w1")]
    docs.append((1004, "w3 " * 50_000 + "xw3"))
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(6))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere"), (3, "w1 w1 the"), (3, "w1 w1 the"), (None, "w9")]
    return docs, items


@pytest.mark.parametrize("block", [lexical.BLOCK_CHARS, 80])
def test_search_equals_brute_force(spark, monkeypatch, block):
    docs, items = search_corpus()
    monkeypatch.setattr(lexical, "STEP_BYTES", 2000)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], DOC + ", item int, score string").repartition(5)
    wanted = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in lexical.search(frame, wanted, block_chars=block).collect()]
    assert sorted(got, key=str) == sorted(brute_search(docs, items), key=str)


def test_search_of_empty_tables(spark):
    docs, items = search_corpus()
    frame, wanted = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(frame.limit(0), wanted).count() == 0
    assert lexical.search(frame, wanted.limit(0)).count() == 0
    assert lexical.search(frame, wanted.filter("item_id in (50, 51)")).count() == 0


def test_best_keeps_what_a_full_sort_keeps(monkeypatch):
    monkeypatch.setattr(lexical, "TOP", 3)
    rng = np.random.default_rng(2)
    best, rows = lexical.Best(4), []
    for _ in range(30):
        part = [rng.integers(0, 4, 50), rng.integers(1, 9, 50), rng.integers(0, 40, 50), rng.integers(0, 2, 50)]
        rows.append(np.stack(part))
        good = part[1] >= best.least[part[0]]
        best.add(*(c[good] for c in part))
        best.cut()
    every = np.concatenate(rows, axis=1)
    order = np.lexsort((every[2], every[3], -every[1], every[0]))
    every = every[:, order]
    want = np.concatenate([every[:, every[0] == k][:, :3] for k in range(4)], axis=1)
    assert (best.cut() == want).all()


def test_sums_in_halves_are_whole():
    cells, values = np.array([0, 1, 0, 0]), np.array([2**53 - 1, 5, 2**52 + 1, 3])
    assert lexical._add(cells, values, 2, exact=False).tolist() == [2**53 + 2**52 + 3, 5]


def plain_marginals(e, first, step):
    def total(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)

    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = first + e[0]
    for t in range(1, len(e)):
        alpha[t] = total(alpha[t - 1][:, None] + step, 0) + e[t]
    for t in range(len(e) - 2, -1, -1):
        beta[t] = total(step + (e[t + 1] + beta[t + 1])[None, :], 1)
    both = np.exp(alpha + beta - (alpha + beta).max(axis=1, keepdims=True))
    return both / both.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_segments_give_the_marginals_of_whole_chains(k):
    rng = np.random.default_rng(k)
    counts = np.array([1, 127, 128, 129, 3, 700, 256])
    e, first, step = rng.normal(0, 3, (counts.sum(), k)), rng.normal(size=k), rng.normal(size=(k, k))
    want = np.concatenate([plain_marginals(x, first, step) for x in np.split(e, np.cumsum(counts)[:-1])])
    assert np.allclose(langid.forward_backward(e, counts, first, step), want, atol=1e-9)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    e, first, step, y = rng.normal(size=(2, 5, 3)), rng.normal(size=3), rng.normal(size=(3, 3)), rng.integers(0, 3, (2, 5))
    _, *found = langid._chains_gradient(e, first, step, y)
    for x, g in zip((e, first, step), found, strict=True):
        for at in np.ndindex(*x.shape):
            kept, loss = x[at], []
            for shift in (1e-5, -1e-5):
                x[at] = kept + shift
                loss.append(langid._chains_gradient(e, first, step, y)[0])
            x[at] = kept
            assert abs((loss[0] - loss[1]) / 2e-5 - g[at]) < 1e-6


def test_scores_are_sums_of_features():
    """Scores of distinct words, by arrays, against a plain loop over the slots of one word."""
    rng = np.random.default_rng(4)
    k = 3
    weights = rng.normal(size=(langid.SLOTS + 1, k)).astype(np.float32)
    weights[-1] = 0
    lexicon = rng.integers(0, 3, (langid.SLOTS, k)).astype(np.float32)
    model = langid.Model(list("abc"), weights, lexicon, np.array([0.5], np.float32), np.ones(k, np.float32), np.zeros(k, np.float32), np.zeros((k, k), np.float32))
    words = langid.Words.of(["Über das Haus über", "x das"])
    distinct, keys, which = words.distinct()
    got = model.scores(distinct, langid.Features.of(distinct, keys))[which]
    for i, word in enumerate(["über", "das", "haus", "über", "x", "das"]):
        alone = langid.Words.of([word])
        f = langid.Features.of(alone, alone.keys())
        want = sum(weights[s] for s in [*f.grams.ravel(), *f.affixes.ravel()])
        count = lexicon[f.word[0]]
        log = np.log(count + 0.5)
        want = want + 0.5 * (log - log.mean()) + (count.sum() == 0)
        assert np.allclose(got[i], want, atol=1e-4)
        assert (f.grams < langid.SLOTS).sum() == sum(max(0, len(word) - n) for n in range(3))
        assert (f.affixes < langid.SLOTS).sum() == 2 * min(3, len(word))


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op13_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    unseen = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    right = sum(got[d.doc_id].lang_pred == d.lang for d in unseen)
    assert right >= 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 for r in got.values())


EN, DE = "the house and the garden of the king were there with them", "das haus und der garten des königs waren dort mit ihnen und sie"


def switched(spark):
    rows = [(k, " ".join((EN if k % 2 else DE).split()[k % 5 :]), "en" if k % 2 else "de") for k in range(120)]
    return spark.createDataFrame(rows, DOC + ", lang string")


def test_words_of_switched_texts_are_labelled(spark):
    model = langid.train(switched(spark))
    text = f"{EN}. {DE}! {EN}"
    [row] = langid.label(spark.createDataFrame([(1, text)], DOC), model).collect()
    assert [s.lang for s in row.spans] == ["en", "de", "en"]
    lower = text.lower()
    assert [lower[s.start : s.stop] for s in row.spans] == [EN, DE, EN]
    assert row.lang_pred == "en" and 0.5 < row.score < 0.9


def test_labels_have_defined_results(spark):
    model = langid.train(switched(spark))
    rows = [(1, None), (2, ""), (3, "12 -- 3"), (4, "x" * 1000), (None, EN), (5, EN), (5, EN), (6, f"{DE} " * 3000), (7, "́"), (8, "中文")]
    frame = spark.createDataFrame([(*r, "zz", 1) for r in rows], DOC + ", lang string, score int")
    got = langid.label(frame, model).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and [r.score for r in got[:3]] == [0.0] * 3
    assert [r.lang_pred for r in got[4:8]] == ["en", "en", "en", "de"]
    assert got[8].lang_pred == "und" and got[9].lang_pred in ("de", "en")
    assert len(got[7].spans) == 1
    assert langid.label(frame.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = switched(spark)
    for none in (docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string")), docs.withColumn("doc_id", F.lit(None).cast("long"))):
        assert langid.train(none) is None
    assert [tuple(r)[1:3] for r in langid.label(docs.limit(2), None).collect()] == [("und", 0.0)] * 2
    one = langid.train(docs.filter("lang = 'de'"))
    assert {r.lang_pred for r in langid.label(docs, one).collect()} == {"de"}


def test_a_sample_is_bounded_and_spread(spark):
    docs = switched(spark).union(spark.range(3000).selectExpr("7", f"'{EN}'", "'en'"))
    seen = []
    real = langid.fit
    try:
        langid.fit = lambda passages: seen.extend(passages)
        langid.train(docs, most=40)
    finally:
        langid.fit = real
    assert 0 < len(seen) <= 40 and {lang for lang, _ in seen} == {"de", "en"}
