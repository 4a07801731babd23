"""Quality rules, url filters and secret scans against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from annalist.llm import quality_rules, secrets, url_filters

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n ", "a", "a b a b a b a b", "x y z\x0bw", "é " * 70, "A B C d\nA B C d\n\nA B C d", "*** $$$ <b>|</b>",
    "one two three " * 400, "\n".join(["same line here"] * 9), "ÉCOUTEZ!! " * 60,
]


def test_measurements_match_python(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(90))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r.doc_id: tuple(r[n] for n in names) for r in quality_rules.ledger(rows.select("doc_id", "text")).collect()}
    assert got == {k: measured(t) for k, t in enumerate(texts)}


def test_policies_and_ablations_are_bitwise(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "a"), (3, "a")], "doc_id long, text string")
    entries = quality_rules.apply_policy(quality_rules.ledger(rows)).collect()
    mask = quality_rules.mask("v2")
    assert all(r.kept == (r.failure_bits & mask == 0) for r in entries) and len(entries) == len(TEXTS) + 2
    found = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(rows)).collect()}
    for name, r in found.items():
        b = quality_rules.bit(name)
        bits = [e.failure_bits & mask for e in entries]
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(x & b > 0 for x in bits), sum(x == b for x in bits), sum(x & ~b == 0 for x in bits))


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.apply_policy(quality_rules.ledger(none)).count() == 0
    assert [r.n_failed for r in quality_rules.ablations(quality_rules.ledger(none)).collect()] == [0] * 5
    assert secrets.scan(none).count() == 0


URLS = [
    (1, "http://A.Example.org/es/x?q=1"), (2, "https://example.org/en/12"), (3, "https://b.example.org/en/2"), (4, "http://x.com/fr/1"),
    (5, "http://x.com/de/1#top"), (6, "http://notorg/es/"), (7, None), (8, "no scheme"), (9, "http://example.org"), (10, "ftp://x.com?u=http://y.org/"), (10, "http://x.com/de/1#top"), (None, "http://x.net/a"),
]


def test_base_rules(spark):
    rows = spark.createDataFrame(URLS, "page_id long, url string")
    none = url_filters.mine_rules(spark.createDataFrame([], "url string, bad boolean"))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(rows, none).collect()]
    assert len(got) == len(URLS)
    assert set(got) == {
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "b.example.org", "/en/2", "org/", "allow"), (4, "x.com", "/fr/1", "com/fr/", "allow"), (5, "x.com", "/de/1", "com/de/", "block"),
        (6, "notorg", "/es/", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "example.org", "", None, "allow"),
        (10, "x.com", "", None, "allow"), (10, "x.com", "/de/1", "com/de/", "block"), (None, "x.net", "/a", None, "allow"),
    }


@pytest.mark.parametrize("limit", [20_000, 0])
def test_mined_rules_match_by_rarest_token(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", limit)
    good = [(f"http://news{k}.net/en/{k}", False) for k in range(30)]
    bad = [(f"http://spam.net/pills/{k}", True) for k in range(10)] + [(f"http://news{k}.net/pills/{k}", True) for k in range(4)]
    labelled = spark.createDataFrame(good + bad, "url string, bad boolean")
    rules = url_filters.mine_rules(labelled)
    found = {tuple(r.tokens): (r.confidence, r.n_bad) for r in rules.collect()}
    assert found[("path=pills",)] == (1.0, 14) and not any(len(t) > 1 and "path=pills" in t for t in found)
    asked = spark.createDataFrame([(1, "https://other.org/pills/7"), (2, "https://other.net/en/")], "page_id long, url string")
    judged = {r.page_id: (r.verdict, r.mined_rule) for r in url_filters.judge(asked, rules).collect()}
    assert judged == {1: ("allow", "path=pills"), 2: ("allow", None)}


def test_no_url_is_dropped_or_doubled_when_a_third_is_one_url(spark):
    rows = spark.range(300).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://h.net/x").otherwise(F.concat(F.lit("http://h.net/"), "id")).alias("url"))
    rules = url_filters.mine_rules(rows.select("url", (F.col("page_id") % 3 == 0).alias("bad")))
    assert rules.count() > 0 and url_filters.judge(rows, rules).count() == 300


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password", "((?i:password").replace("key)", "key))", 1))
OTHERS = (("access", re.compile("AKIA[A-Z0-9]+"), 20), ("hex", re.compile("[0-9a-f]+"), 24))


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for k, (kind, pattern, least) in enumerate(OTHERS, 1):
        spans += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text) if len(m[0]) >= least]
    return sorted(spans)


def entropy(token, width):
    return max(-sum(n / width * math.log2(n / width) for n in Counter(token[i : i + width]).values()) for i in range(len(token) - width + 1))


def test_spans_redaction_and_entropy(spark):
    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(rng.choice(alphabet) for _ in range(40))
    texts = [
        None, "", "é😀 token = abcdef", "secret=token: abcdefgh", "PassWord:'x.y-z/=+9' api_key\"= \"12345", "AKIA" + "Z9" * 8 + " AKIA123", "0" * 24 + "g" + "f" * 23,
        "x " + key + " y", "z 12345678-1234-1234-1234-123456789abc", "AKIA token=AKIA" + "B2" * 9 + "é" + "ab12" * 7, "secret=" + "a" * 100_000, f"{key[:30].upper()}\n{key}{key}",
    ]
    rows = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").withColumn("base", F.lit(1))
    got = secrets.scan(rows.select("doc_id", "text")).withColumn("clean", secrets.redact(F.col("text"), F.col("found"))).collect()
    for r in got:
        base = base_spans(r.text)
        assert [(s.start, s.order, s.kind, s.stop) for s in r.base] == base
        for s in r.found:
            if s.kind == "entropy":
                threshold = next(c.threshold for c in secrets.CLASSES if re.match(c.pattern, s.value))
                assert entropy(s.value, secrets.WINDOW) >= threshold and all(b[3] <= s.start or s.stop <= b[0] for b in base)
        text, out, at = r.text or "", "", 0
        for s in r.found:
            if s.start >= at:
                out += text[at : s.start] + "[SECRET]"
            at = max(at, s.stop)
        assert (r.clean or "") == out + text[at:]
    assert {s.kind for r in got for s in r.found} == set(secrets.KINDS)


def test_keys_of_narrow_alphabets_and_beside_other_words(spark):
    """Keys behind a name or a path that an allow-list rule knows, and beside a base span, are found."""
    rng = random.Random(5)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    keys = {"base32": make(upper + "234567", 32), "lower": make(lower + "0123456789", 32), "base64": make(upper + lower + "0123456789", 40)}
    texts, expected = [], []
    for key in keys.values():
        for before in ("", "SAMPLE_DB_ACCESS=", "see examples/", "AKIA" + "Q7" * 8 + "/"):
            texts.append(f"é {before}{key} end")
            expected.append((len(f"é {before}"), len(f"é {before}{key}")))
    texts += ["an example_of_a_placeholder/with/many/words2021 here", "12345678-1234-1234-1234-123456789abc", "0123456789" * 4, "x" * 60 + "1"]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, span in zip(got, expected, strict=False):
        assert span in [(s.start, s.stop) for s in r.found], r
    assert not any(s.kind == "entropy" for r in got[len(expected) :] for s in r.found)


@pytest.mark.parametrize("case", ["token", "dull token", "matches", "words"])
def test_very_long_texts_take_seconds(spark, case):
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    text = {
        "token": "".join(rng.choice(letters) for _ in range(1_000_000)),
        "dull token": "0Gb1" * 250_000,
        "matches": "".join(f"token={rng.randrange(10**9):09d}xyz;é\n" for _ in range(20_000)),
        "words": "plain words of no interest " * 400_000,
    }[case]
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    rows.count()
    query = secrets.scan(rows).select("base", "found")  # making the plan takes a second or two, whatever the text
    began = time.time()
    found = query.collect()[0]
    assert time.time() - began < 10
    known = spark.createDataFrame([(text, found.found)], f"text string, found array<{secrets.SPAN}>")
    began = time.time()
    redacted = known.select(F.length(secrets.redact(F.col("text"), F.col("found"))).alias("n")).collect()[0].n
    assert time.time() - began < 10
    rows.unpersist()
    assert [(s.start, s.order, s.kind, s.stop) for s in found.base] == base_spans(text)
    expected = {"token": [(0, 1_000_000)], "dull token": [], "matches": [(s[0], s[3]) for s in base_spans(text)], "words": []}[case]
    assert [(s.start, s.stop) for s in found.found] == expected
    assert redacted == len(text) - sum(b - a - len("[SECRET]") for a, b in expected)


def test_window_entropy_is_the_plain_one(spark):
    rng = random.Random(3)
    tokens = ["".join(rng.choice("abcdef0123456789"[: rng.randrange(1, 17)]) for _ in range(rng.randrange(24, 60))) for _ in range(40)]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string")
    for r in rows.select("t", secrets.max_entropy(F.col("t")).alias("h")).collect():
        assert abs(r.h - entropy(r.t, secrets.WINDOW)) < 1e-9


def test_sha_of_spans(spark):
    row = secrets.scan(spark.createDataFrame([(1, "token=abcdefg")], "doc_id long, text string")).select(F.sha2(secrets.joined(F.col("base")), 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"assign:0:13").hexdigest()
