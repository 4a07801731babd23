"""N-gram join, decontamination and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from annalist.llm import decontam, induced_sort, ngram_join, suffix_dedup
from annalist.llm.shingles import MinHash, bands_for, shingle_set


def grams(text, n=5):
    words = (text or "").encode().split()
    n = min(n, len(words))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else frozenset()


def near_corpus(seed=4, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [None, "", " ", "short one", "short one", "short two", "a b c d e"]
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
    texts.append(texts[10] + "\n\n")
    return texts


def brute_classes(texts):
    sets = [grams(t) for t in texts]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (root(k), links[k]) for k in range(len(texts))}


@pytest.mark.parametrize("block", [256, 3])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = near_corpus()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS class_id", "'x' AS id")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(rows.select("doc_id", "text")).collect()}
    assert got == brute_classes(texts)


def test_join_of_a_large_group_of_near_copies(spark):
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(60)] + [" ".join(base)] * 40
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(rows).collect()}
    assert got == brute_classes(texts)


def test_join_of_odd_ids_and_of_nothing(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(None, text), (5, text), (5, text), (6, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(rows).collect()), key=str)
    assert got == [(5, 5, 1), (5, 5, 1), (6, 6, 0), (None, None, None)]
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_join_of_repeated_ids_with_several_texts(spark):
    """Each row is a document: its links are those of its own text."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for k in range(12):
        base = [word() for _ in range(rng.choice([60, 90]))]
        for _ in range(rng.randrange(1, 4)):
            near = list(base)
            near[rng.randrange(len(near))] = "edited"
            rows.append((rng.randrange(6), " ".join(near)))
        rows.append((20 + k, " ".join(base)))
    rows += rows[:6]
    rows += [(5, "one " + " ".join(f"v{k}" for k in range(60_000))), (3, " ".join(f"v{k}" for k in range(60_000)))]
    ids, found = [i for i, _ in rows], brute_classes([t for _, t in rows])
    least = {}
    for k, (root, _) in found.items():
        least[root] = min(least.get(root, ids[k]), ids[k])
    want = sorted((ids[k], least[root], n) for k, (root, n) in found.items())
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == want


def test_bands_reach_the_recall():
    bands, rows = bands_for(0.8, ngram_join.RECALL, ngram_join.MOST_HASHES)
    assert bands * rows <= ngram_join.MOST_HASHES and (1 - 0.8**rows) ** bands <= 1 - ngram_join.RECALL
    rng, hasher, met = np.random.default_rng(1), MinHash(bands, rows), 0
    for _ in range(200):
        common, own = rng.integers(0, 2**63, 80, dtype=np.uint64), rng.integers(0, 2**63, 20, dtype=np.uint64)
        a, b = np.r_[common, own[:10]], np.r_[common, own[10:]]
        met += bool((hasher.band_hashes(a) == hasher.band_hashes(b)).any())
    assert met == 200
    assert len(shingle_set(np.arange(3, dtype=np.uint64))) == 1


@pytest.mark.parametrize("block_chars", [decontam.BLOCK_CHARS, 400, 50])
def test_decontamination_equals_brute_force(spark, block_chars):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 5, 8, 40, 90])))) for k in range(25)] + [(None, "w1 w2 w3 w4 w5 w6"), (90, None), (91, " ")]
    docs = [(None, "w1 w2 w3 w4 w5 w6 w7"), (1, None), (2, "")]
    for k in range(40):
        body = [word() for _ in range(rng.randrange(0, 3000))]
        quoted = (items[rng.randrange(25)][1]).split()
        if k % 3 == 0 and len(quoted) > 20:
            quoted[rng.randrange(len(quoted))] = "edited"
        at = rng.randrange(len(body) + 1)
        docs.append((k + 3, " ".join(body[:at] + quoted + body[at:])))
    found = decontam.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars)
    got = sorted(((r.doc_id, r.item_id, r.n_found) for r in found.collect()), key=str)
    expected = []
    for i, text in items:
        own = grams(text)
        for d, body in docs:
            words, n = (body or "").encode().split(), min(5, len((text or "").split()))
            theirs = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
            if own and 5 * len(own & theirs) >= 4 * len(own):
                expected.append((d, i, len(own & theirs)))
    assert got == sorted(expected, key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1, "documents are read once"


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.search(none, items).count() == 0
    assert decontam.search(spark.createDataFrame([(1, "a b")], none.schema), items.limit(0)).count() == 0


def test_least_hits_keep_recall():
    rng = random.Random(8)
    for n in (5, 20, 64, 300):
        k, least = decontam.sketch_of(decontam.size_class(n))
        k = min(n, k)
        missing = set(range(n - -(-n * 4 // 5)))
        assert all(sum(x not in missing for x in rng.sample(range(n), k)) >= least for _ in range(500))


def brute_removed(rows, length=50):
    out, first = {}, {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            first.setdefault(data[k : k + length], i)
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < i:
                gone[k : k + length] = True
        gone = gone[: len(data)]
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def dedup_corpus(seed=3):
    rng = random.Random(seed)
    letters = "ab c" if seed % 2 else "abcdefghij klmé"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(n) for n in (49, 50, 51, 60, 200)] + ["For " * 40, "a" * 130]
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 50), (5, "x" * 400)]
    for k in range(6, 50):
        parts = [make(rng.randrange(0, 150)) for _ in range(3)]
        for at in range(rng.randrange(0, 4)):
            parts.insert(at, rng.choice(shared))
        rows.append((k, "".join(parts)))
    rows += [(60, rows[20][1]), (61, rows[20][1] + "tail"), (62, "head" + rows[20][1]), (63, rows[21][1][20:])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,step", [(3, None), (4, None), (3, 300)])
def test_dedup_equals_brute_force(spark, monkeypatch, seed, step):
    if step:
        monkeypatch.setattr(suffix_dedup, "STEP", step)
    rows = dedup_corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_removed(rows)


def test_dedup_of_odd_ids_and_of_nothing(spark):
    body = "abcdefghij" * 9
    rows = spark.createDataFrame([(None, body), (1, body), (1, body), (2, body), (2, "other " * 20)], "doc_id long, text string")
    got = suffix_dedup.dedup(rows, keep_text=True).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in got), key=str) == [(1, 0), (1, 0), (2, 0), (2, 90), (None, 0)]
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dedup_of_repeated_ids_with_several_texts(spark):
    """Each row loses what starts under a smaller id, nothing to rows of its own id."""
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    c = make(82)
    rows = [(1, c + make(350)), (2, c + make(350)), (2, c + make(353)), (3, c + "tail" + make(200)), (-4, make(30) + c), (None, c)]
    shared = [make(60) for _ in range(5)]
    rows += [(rng.randrange(8), rng.choice(shared) + make(rng.randrange(90)) + rng.choice(shared)) for _ in range(40)]
    rows += rng.choices(rows, k=15)
    want = []
    for i, text in rows:
        if i is None:
            want.append((None, len(text), 0, 0, hashlib.sha256(text.encode()).hexdigest(), None))
            continue
        one = brute_removed([(k, t) for k, t in rows if k is not None and k < i] + [(i, text)])[i]
        want.append((i, *one))
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted((w[:5] for w in want), key=str)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got if r.kept is not None)
    assert all(r.kept is not None for r in got if r.n_removed)


def longest_first(x, depth, memory=induced_sort.MEMORY):
    """Suffixes from the least to the largest, and the prefix each shares with the one before."""
    with induced_sort.Scratch(memory) as scratch:
        parts = [(np.asarray(p), np.asarray(v)) for p, v in induced_sort.suffixes(x, int(x.max()) + 1, depth, scratch)]
    position, prefix = (np.concatenate(c)[::-1] for c in zip(*parts, strict=True))
    return position.tolist(), np.r_[0, prefix[:-1]].tolist()


def shared_prefix(a, b):
    return next((k for k, (u, v) in enumerate(zip(a, b, strict=False)) if u != v), min(len(a), len(b)))


@pytest.mark.parametrize("block,memory", [(1 << 15, 1 << 28), (4, 512), (64, 4096)])
def test_suffix_order_and_prefixes_of_random_strings(monkeypatch, block, memory):
    monkeypatch.setattr(induced_sort, "LEAST_BLOCK", block)
    rng = np.random.default_rng(2)
    for trial in range(60):
        k = int(rng.integers(1, 5))
        x = np.r_[rng.integers(1, k + 1, rng.integers(0, 150)), 0] if trial % 3 else np.r_[np.tile(rng.integers(1, k + 1, rng.integers(1, 6)), 25), 0]
        for depth in (2, 3, 7, 50, 120):
            order, prefix = longest_first(x, depth, memory)
            keys = [tuple(x[i : i + depth]) for i in order]
            assert sorted(order) == list(range(len(x))) and keys == sorted(keys)
            assert prefix[1:] == [shared_prefix(a, b) for a, b in zip(keys, keys[1:], strict=False)]


def test_recursion_with_large_alphabets(monkeypatch):
    monkeypatch.setattr(induced_sort, "LEAST_BLOCK", 256)
    rng = np.random.default_rng(9)
    x = np.r_[rng.integers(1, 4, 30_000), 0].astype(np.uint16)
    order, prefix = longest_first(x, 50)
    text = bytes(x.astype(np.uint8))
    keys = [text[i : i + 50] for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(len(x)))
    assert prefix[1:] == [shared_prefix(a, b) for a, b in zip(keys, keys[1:], strict=False)]


def test_a_shard_twenty_times_its_memory(tmp_path, monkeypatch):
    """The bound holds for what is allocated; files hold the rest, and go."""
    monkeypatch.setattr(induced_sort.tempfile, "tempdir", str(tmp_path))
    bound = 512 << 10
    rng = np.random.default_rng(4)
    x = np.r_[rng.integers(1, 30, 20 * bound // 8), 0].astype(np.uint16)  # a suffix takes 8 bytes at least
    x[1000:3000] = x[501_000:503_000]
    tracemalloc.start()
    total, longest = 0, 0
    with induced_sort.Scratch(bound) as scratch:
        for position, prefix in induced_sort.suffixes(x, 30, 50, scratch):
            total += len(position)
            longest = max(longest, int(np.max(prefix)))
        assert scratch.folder is not None
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == len(x) and longest == 50
    assert peak < 40 << 20  # blocks of LEAST_BLOCK rows, and steps of a million positions, whatever the length
    assert not list(tmp_path.iterdir())


def test_shards_in_files_give_the_same(spark, monkeypatch):
    rows = dedup_corpus(5)
    monkeypatch.setattr(suffix_dedup.intervals, "__defaults__", (2048,))
    monkeypatch.setattr(suffix_dedup, "MEMO_BYTES", 500)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_removed(rows)


def test_dedup_of_a_very_long_text(spark):
    """Longer than a step: pieces overlap, so windows across their borders count."""
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(5_000_000))
    cut = suffix_dedup.STEP - 20
    rows = [(1, long[cut : cut + 200]), (2, long), (3, "0" * 40 + long[-70:])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (200, 1), 3: (70, 1)}


@pytest.mark.parametrize("part,memory", [(1 << 20, 1 << 28), (200, 1 << 20)])
def test_only_windows_found_twice_are_sorted(monkeypatch, part, memory):
    """Two copies of a passage, and nothing else, are covered; a part with a hot hash counts as a whole."""
    monkeypatch.setattr(suffix_dedup, "PART_WINDOWS", part)
    x = np.random.default_rng(3).integers(2, 200, 60_000).astype(np.uint16)
    x[[2_000, 30_000, 59_999]] = 1
    x[40_000:40_080] = x[500:580]
    shard = suffix_dedup.Shard(memory)
    with shard.scratch:
        covered = np.flatnonzero(shard._stretches(x))
        want = [*range(500, 580), *range(40_000, 40_080)]
        assert covered.tolist() == want
        x[10_000:12_000] = 7
        assert set(range(10_000, 12_000)) <= set(np.flatnonzero(shard._stretches(x)).tolist())


def test_batches_grow_with_the_shards(spark, monkeypatch):
    """So the rows that batches send to shards grow as the input; the result is the same."""
    steps, real = [], suffix_dedup.segments
    monkeypatch.setattr(suffix_dedup, "segments", lambda *args: steps.append(args[-1]) or real(*args))
    monkeypatch.setattr(suffix_dedup, "STEP", 400)
    rows = dedup_corpus(3)
    for share, bytes_ in ((256, 400), (1, 1600)):
        monkeypatch.setattr(suffix_dedup, "STEP_SHARDS", share)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute_removed(rows) and steps.pop() == bytes_
