"""Parallel clustering against sequential loops on random instances."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.functions import scores
from annalist.functions.dates import ymd
from annalist.operators import canonical, cells, cluster, pairs, scoring, timeline
from annalist.plans import adapters, cluster_queries


def random_vectors(seed, n=40, d=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, v):
    return spark.createDataFrame([(k, k, [float(x) for x in row]) for k, row in enumerate(v)], "id long, rank long, vector array<double>")


def sequential(sims, t):
    leader = {}
    for k in range(len(sims)):
        if k in leader:
            continue
        leader[k] = k
        for j in range(k + 1, len(sims)):
            if j not in leader and sims[k][j] >= t:
                leader[j] = k
    return leader


@pytest.mark.parametrize("seed,block,cell_rows", [(1, 4096, 1024), (2, 7, 1024), (3, 4, 6)])
def test_pairs_and_leaders(spark, monkeypatch, seed, block, cell_rows):
    monkeypatch.setattr(pairs, "CELL_ROWS", cell_rows)
    v = random_vectors(seed)
    points = table(spark, v)
    bad = spark.createDataFrame([(100, 100, [0.0, 0.0, 0.0]), (101, 101, None), (102, 102, [float("nan"), 1.0, 0.0])], points.schema)
    found = pairs.similar_pairs(points.union(bad), 0.8, block=block)
    sims = v @ v.T
    expected = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if sims[a, b] >= 0.8}
    assert {(r.a, r.b) for r in found.collect()} == expected
    got = {r.id: r.leader for r in cluster.leader_cluster(points.select("id", "rank"), found).collect()}
    assert got == sequential(sims, 0.8)
    lsh = {(r.a, r.b) for r in pairs.similar_pairs(points, 0.8, "lsh").collect()}
    assert lsh <= expected and len(lsh) >= 0.9 * len(expected)


@pytest.mark.parametrize("threshold,spread", [(0.3, 0.9), (0.8, 0.35)])
def test_sign_bands_find_nine_pairs_of_ten(spark, threshold, spread):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 32))
    v = centres[rng.integers(0, 60, 600)] + spread * rng.standard_normal((600, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sims = v @ v.T
    expected = {(a, b) for a in range(600) for b in range(a + 1, 600) if sims[a, b] >= threshold}
    found = pairs.similar_pairs(table(spark, v), threshold, "lsh", block=64).collect()
    got = {(r.a, r.b) for r in found}
    assert len(expected) > 500 and got <= expected and len(got) == len(found) and len(got) >= 0.9 * len(expected)
    assert all(abs(r.similarity - sims[r.a, r.b]) < 1e-6 for r in found)


def grouped_vectors(seed, groups, each, d=16, spread=0.12):
    rng = np.random.default_rng(seed)
    v = np.repeat(rng.standard_normal((groups, d)), each, axis=0)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v += spread * rng.standard_normal(v.shape) / np.sqrt(d)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("threshold", [0.95, 0.8, 0.3])
def test_pivots_lose_no_pair_and_copy_little(spark, threshold):
    """A third of the vectors are equal and another group is large; the rest are in small groups."""
    v = grouped_vectors(4, 40, 12)
    v[:160] = v[0]
    v[160:200] = v[160] + 0.02 * random_vectors(9, 40, 16)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sims = v @ v.T
    placed = pairs.placed_in_cells(table(spark, v).select("id", "vector"), threshold, 20)
    found = pairs._pairs_in_cells(placed, threshold, 32).collect()
    a, b = np.nonzero(np.triu(sims >= threshold - 1e-12, 1))
    assert len(found) == len(a) and {(r.a, r.b) for r in found} == set(zip(a.tolist(), b.tolist(), strict=True))
    copies, cells_ = placed.agg(F.sum(F.size("copies")), F.countDistinct("cell")).first()
    if threshold > 0.9:
        assert cells_ > 15 and copies < 2 * len(v)


@pytest.mark.parametrize("k,threshold", [(5, None), (3, 0.8), (40, None)])
def test_search_by_cells_is_exact_and_visits_few_rows(spark, monkeypatch, k, threshold):
    monkeypatch.setattr(cells, "SLOT_ROWS", 50)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 9)
    v = grouped_vectors(6, 60, 20)
    v[:300] = v[0]
    store = table(spark, v).select("id", "vector")
    index = cells.CellIndex.build(store, 48)
    asked = store.filter("id % 37 = 0").select(F.col("id").cast("string").alias("query_id"), "vector")
    done = cells.search(asked, index, k, threshold)
    got = {}
    for r in done.found.collect():
        got.setdefault(int(r.query_id), []).append((r.rank, r.id))
    sims = np.round(v @ v.T, 12)
    for q in range(0, len(v), 37):
        best = sorted((j for j in range(len(v)) if threshold is None or sims[q, j] > threshold), key=lambda j: (-sims[q, j], j))[:k]
        assert sorted(got.get(q, [])) == list(enumerate(best, 1))
    visits = done.visits.collect()
    assert len(visits) == len({tuple(r) for r in visits})
    if k < 10:
        compared = sum(int(index.count[r.cell]) for r in visits if int(r.query_id) >= 300)
        queries = len([q for q in range(0, len(v), 37) if q >= 300])
        assert compared / queries < 0.2 * len(v), "a query meets a small part of the store"
    near = {(int(r.query_id), r.id) for r in cells.within(asked, index, 0.9).collect()}
    assert near == {(q, j) for q in range(0, len(v), 37) for j in range(len(v)) if sims[q, j] >= 0.9}


def test_search_of_nothing(spark):
    v = table(spark, random_vectors(1, 20)).select("id", "vector")
    asked = v.select(F.col("id").alias("query_id"), "vector")
    assert pairs.nearest(asked, v.limit(0), 3).count() == 0
    assert pairs.nearest(asked.limit(0), v, 3).count() == 0
    assert pairs.similar_pairs(v.limit(0), 0.8).count() == 0


def test_identical_vectors_are_similar(spark):
    points = table(spark, np.ones((3, 3)))
    assert pairs.similar_pairs(points, 0.999).count() == 3


def test_hybrid_unites_confirmed_groups(spark):
    v = random_vectors(5, 30)
    sims = v @ v.T
    found = pairs.similar_pairs(table(spark, v), 0.7)
    points = table(spark, v).select("id", "rank")
    got = {r.id: r.leader for r in cluster.hybrid_cluster(points, found, lambda p: p.filter("(a + b) % 2 = 0"), 0.9, 0.7).collect()}
    groups = sequential(sims, 0.9)
    parent = {k: k for k in set(groups.values())}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(parent):
        for b in range(a + 1, len(v)):
            if groups[b] > a and 0.7 <= sims[a, b] < 0.9 and (a + b) % 2 == 0:
                x, y = root(a), root(groups[b])
                parent[max(x, y)] = min(x, y)
    assert got == {k: root(g) for k, g in groups.items()}


def test_nearest_is_strict_and_ordered(spark):
    v = random_vectors(6, 50)
    store = table(spark, v).select("id", "vector")
    asked = store.filter("id < 10").select(F.col("id").alias("query_id"), "vector")
    got = {}
    for r in pairs.nearest_events(asked, store.filter("id >= 10"), 3, 0.5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    sims = v @ v.T
    for q in range(10):
        best = sorted((j for j in range(10, 50) if sims[q, j] > 0.5), key=lambda j: (-sims[q, j], j))[:3]
        assert [i for _, i in sorted(got.get(q, []))] == best


def test_nearest_query_searches_the_other_queries_too(spark, tmp_path):
    v = random_vectors(3, 120, 4)
    v[100], v[7] = v[50], v[50]
    rows = [(k, [float(x) for x in row], 0) for k, row in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in cluster_queries.nearest_events(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    sims = np.round(v @ v.T, 12)
    for q in (0, 50, 100):
        best = sorted((j for j in range(120) if j != q and sims[q, j] > 0.2), key=lambda j: (-sims[q, j], j))[:5]
        assert sorted(got.get(q, [])) == list(enumerate(best, 1))
    assert [i for _, i in sorted(got[50])][:2] == [7, 100]


def test_rule_clusters_equal_the_loop(spark):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        year = rng.choice([None, 2000, 2001, 2002, 2005])
        rows.append((k, rng.sample(["a", "b", "c", "d"], rng.randrange(0, 4)), ["T"], year, rng.choice(["en", "de"]), "x" * rng.choice([3, 5, 40])))
    t = spark.createDataFrame(rows, "id long, entity_ids array<string>, entity_types array<string>, year int, language string, description string")
    year = F.col("year")
    t = t.withColumn("date_range", F.when(year.isNotNull(), F.struct(ymd(year, F.lit(1), F.lit(1)).alias("start_date"), ymd(year, F.lit(12), F.lit(31)).alias("end_date"))))
    got = {r.id: r.leader for r in cluster.rule_cluster(t).collect()}

    def excluded(x, y):
        far = x[3] is not None and y[3] is not None and abs(x[3] - y[3]) > 2
        return far or max(len(x[5]), len(y[5])) > 5 * min(len(x[5]), len(y[5]))

    def match(x, y):
        smaller = min(len(x[1]), len(y[1]))
        return smaller > 0 and len(set(x[1]) & set(y[1])) / smaller >= 0.75 and x[3] == y[3]

    def score(x, y):
        gap = None if x[3] is None or y[3] is None else abs(x[3] - y[3])
        return 10 * len(set(x[1]) & set(y[1])) + 5 + {0: 30, 1: 20, 2: 10}.get(gap, 0) + 10 * (x[4] == y[4]) + 10 * (x[5] == y[5])

    leaders, expected = [], {}
    for row in sorted(rows, key=lambda r: (r[3] is None, r[3] or 0, r[0])):
        fit = [(score(lead, row), -n, lead[0]) for n, lead in enumerate(leaders) if not excluded(lead, row) and match(lead, row)]
        if fit:
            expected[row[0]] = max(fit)[2]
        else:
            leaders.append(row)
            expected[row[0]] = row[0]
    assert got == expected


def test_rule_cluster_unites_confirmed_near_matches(spark):
    rows = [
        (1, ["a", "b"], 2000), (2, ["a", "c"], 2001), (3, ["a", "d"], 2000), (4, ["z", "y"], 2000), (5, ["a", "b"], 2000), (6, ["a", "c"], 2004),
    ]
    t = spark.createDataFrame([(i, e, ["T"], y, "en", "text") for i, e, y in rows], "id long, entity_ids array<string>, entity_types array<string>, year int, language string, description string")
    year = F.col("year")
    t = t.withColumn("date_range", F.struct(ymd(year, F.lit(1), F.lit(1)).alias("start_date"), ymd(year, F.lit(12), F.lit(31)).alias("end_date")))
    pair = "a long, b long, is_same boolean, confidence double"
    answers = spark.createDataFrame([(2, 1, True, 0.9), (1, 3, True, 0.5), (1, 4, True, 0.9), (1, 6, True, 0.9), (3, 5, True, 0.9)], pair)
    asked = []

    def verify(found):
        asked.extend((r.a, r.b) for r in found.collect())
        return scoring.scored_verifier(answers)(found)

    got = {r.id: r.leader for r in cluster.rule_cluster(t, verify).collect()}
    # 4 shares no entity and 6 is too late for 1: never asked; 5 matches 1 by rule, which goes before its answer with 3
    assert sorted(asked) == [(1, 2), (1, 3), (2, 3), (2, 5), (3, 5)]
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6}
    assert {r.id: r.leader for r in cluster.rule_cluster(t).collect()}[2] == 2


def inserted(v, document, n_stored, near, cross, same, k):
    """The sequential loop: events in order, each with the documents it has so far."""
    sims = np.round(v @ v.T, 12)
    events, out = {i: {document[i]} for i in range(n_stored)}, {}
    for i in range(n_stored, len(v)):
        close = sorted((e for e in events if sims[e, i] > near), key=lambda e: (-sims[e, i], e))[:k]
        hit = next((e for e in close if sims[e, i] >= (same if document[i] in events[e] else cross)), None)
        if hit is None:
            events[i] = {document[i]}
        else:
            events[hit].add(document[i])
        out[i] = i if hit is None else hit
    return out


def insert_all(spark, v, document, n_stored, *thresholds):
    rows = [(k, k, [float(x) for x in v[k]], document[k]) for k in range(len(v))]
    all_ = spark.createDataFrame(rows, "id long, rank long, vector array<double>, document_id string")
    store = all_.filter(F.col("id") < n_stored).select(F.col("id").alias("event_id"), "vector", F.array("document_id").alias("document_ids"))
    return {r.raw_id: r.event_id for r in canonical.canonicalise(all_.filter(F.col("id") >= n_stored), store, *thresholds).collect()}


@pytest.mark.parametrize(
    "seed,documents,thresholds",
    [(8, 4, (0.80, 0.85, 0.95, 5)), (9, 2, (0.80, 0.85, 0.95, 1)), (10, 3, (0.3, 0.35, 0.9, 2)), (11, 1, (0.5, 0.6, 0.95, 3))],
)
def test_canonicalise_equals_the_loop_with_a_store(spark, seed, documents, thresholds):
    rng = random.Random(seed)
    v = random_vectors(seed, 50)
    document = [None if rng.random() < 0.1 else str(rng.randrange(documents)) for _ in range(50)]
    assert insert_all(spark, v, document, 15, *thresholds) == inserted(v, document, 15, *thresholds)


def test_a_large_cluster_takes_few_rounds(spark, monkeypatch):
    """A third of the rows are near copies of one another, others nearly equal to them: no chain as long as the cluster."""
    rng = np.random.default_rng(3)
    v = random_vectors(5, 180, 8)
    v[20:80] = v[20] + 0.02 * random_vectors(6, 60, 8)
    v[80:120] = v[20] + 0.45 * random_vectors(7, 40, 8)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    document = [str(d) for d in rng.integers(0, 400, len(v))]
    calls, real = [], canonical._decide
    monkeypatch.setattr(canonical, "_decide", lambda *a: calls.append(1) or real(*a))
    assert insert_all(spark, v, document, 10) == inserted(v, document, 10, 0.80, 0.85, 0.95, 5)
    assert len(calls) <= 12


def test_canonicalise_of_odd_rows(spark):
    rows = [(1, 1, None, "a"), (2, 2, [0.0, 0.0], "a"), (3, 3, [1.0, 0.0], "b"), (4, 4, [1.0, 0.0], None), (5, 5, [1.0, 0.0], None)]
    raw = spark.createDataFrame(rows, "id long, rank long, vector array<double>, document_id string")
    none = spark.createDataFrame([], "event_id long, vector array<double>, document_ids array<string>")
    got = {r.raw_id: (r.event_id, r.is_new) for r in canonical.canonicalise(raw, none).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (3, False), 5: (3, False)}
    assert canonical.canonicalise(raw.limit(0), none).count() == 0


def test_ranks_are_places_in_order(spark):
    rows = spark.createDataFrame([(k, (k * 37) % 101) for k in range(101)], "id long, key long")
    assert {r.id: r.rank for r in cluster.rank_by(rows, "key").collect()} == {k: (k * 37) % 101 + 1 for k in range(101)}


@pytest.mark.parametrize("per_key", [2000, 7])
def test_overlaps_of_all_ranges(spark, monkeypatch, per_key):
    """Ranges of days to millennia, a third of them in one month; each pair once."""
    monkeypatch.setattr(pairs.split_join, "__defaults__", (per_key,))
    rng = random.Random(per_key)
    rows = []
    for k in range(120):
        first = rng.randrange(730_000, 730_020) if k % 3 == 0 else rng.randrange(1, 3_000_000)
        rows.append((k, first, min(3_600_000, first + int(10 ** rng.uniform(0, 6)) - 1)))
    rows += [(200, 5, 5), (201, 5, 5), (202, 6, 6), (203, None, None)]
    frame = spark.createDataFrame(rows, "id long, s int, e int")
    day = lambda c: F.date_add(F.lit("0001-01-01").cast("date"), F.col(c) - 1)
    events = frame.select("id", F.when(F.col("s").isNotNull(), F.struct(day("s").alias("start_date"), day("e").alias("end_date"))).alias("date_range"))
    got = [(r.a, r.b) for r in pairs.overlaps(events).collect()]
    known = [r for r in rows if r[1] is not None]
    want = {(x[0], y[0]) for x in known for y in known if x[0] < y[0] and x[1] <= y[2] and y[1] <= x[2]}
    assert len(got) == len(set(got)) and set(got) == want
    assert pairs.overlaps(events.limit(0)).count() == 0


@pytest.mark.parametrize("by,least", [(("entity", "type", "year"), 0), (("type",), 0), (("type", "year"), 55), (("entity", "type", "year"), 60), (("year",), 70)])
def test_candidates_share_a_key_and_can_reach_the_score(spark, monkeypatch, by, least):
    monkeypatch.setattr(pairs.split_join, "__defaults__", (9,))
    rng = random.Random(len(by) + least)
    rows = [
        (k, rng.sample("abcdefgh", rng.randrange(3)), rng.sample("PQ", rng.randrange(3)), None if k % 9 == 0 else 1900 + (0 if k % 3 == 0 else rng.randrange(40)))
        for k in range(70)
    ] + [(80, ["a", "a"], None, None), (81, None, ["P", "P"], 1900)]
    table_ = spark.createDataFrame(rows, "id long, entity_ids array<string>, entity_types array<string>, year int")
    got = [(r.a, r.b) for r in pairs.block_candidates(table_, by, least).collect()]
    want = set()
    for x in rows:
        for y in rows:
            entities, types = len(set(x[1] or []) & set(y[1] or [])), len(set(x[2] or []) & set(y[2] or []))
            gap = abs(x[3] - y[3]) if None not in (x[3], y[3]) else 99
            met = ("entity" in by and entities) or ("type" in by and types) or ("year" in by and gap <= 1)
            if x[0] < y[0] and met and (not least or 10 * entities + 5 * types + {0: 30, 1: 20, 2: 10}.get(gap, 0) + 20 >= least):
                want.add((x[0], y[0]))
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("by", [("entity",), ("entity", "year")])
def test_candidates_bring_their_sides(spark, monkeypatch, by):
    """Pairs hold both events, the smaller id first, and are the rows that two joins behind them would give."""
    monkeypatch.setattr(pairs.split_join, "__defaults__", (4,))
    rows = [(k, ["h"] if k % 2 else ["h", f"e{k % 5}"], ["T"], 1900 + k % 4, f"text {k}") for k in range(24)]
    own = spark.createDataFrame(rows, "id long, entity_ids array<string>, entity_types array<string>, year int, description string")
    want = {(r.a, r.b, r.x.description, r.y.description) for r in pairs.with_sides(pairs.block_candidates(own, by), own).collect()}
    got = [(r.a, r.b, r.x.description, r.y.description) for r in pairs.block_candidates(own, by, sides=("description",)).collect()]
    assert len(got) == len(set(got)) == 24 * 23 // 2 and set(got) == want
    assert all(x == f"text {a}" and y == f"text {b}" for a, b, x, y in got)


def test_vector_leaders_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(cluster, "FIRST_BATCH", 60)
    monkeypatch.setattr(cluster, "GROWTH", 3)
    rng = np.random.default_rng(3)
    points = table(spark, rng.standard_normal((150, 6))).withColumn("rank", (F.col("id") * 37 % 401).cast("long"))
    every = pairs.similar_pairs(points, 0.6).cache()
    verify = lambda p: p.filter("(a + b) % 2 = 0")
    groups = cluster.leader_cluster(points.select("id", "rank"), every.filter("similarity >= 0.7"))
    assert {tuple(r) for r in cluster.vector_leaders(points, 0.7).collect()} == {tuple(r) for r in groups.collect()}
    hybrid = cluster.hybrid_cluster(points, every, verify, 0.7, 0.6)
    assert {tuple(r) for r in cluster.vector_hybrid(points, verify, 0.7, 0.6).collect()} == {tuple(r) for r in hybrid.collect()}


def test_similarities_are_added_up_in_blocks(spark, monkeypatch):
    points = table(spark, np.random.default_rng(3).standard_normal((120, 6)))
    every = pairs.similar_pairs(points, 0.6)
    monkeypatch.setattr(pairs, "MOST_ROWS", 40)
    groups = points.select("id", (F.col("id") % 3).alias("leader"))
    want = {r.id: r.total for r in timeline.similarity_totals(groups, every).collect()}
    got = {r.id: r.total for r in pairs.similarities_inside(groups.join(points.select("id", "vector"), "id"), 0.6).collect()}
    assert all(abs(got[i] - want.get(i, 0)) < 1e-9 for i in got) and set(want) <= set(got)


def test_pairs_that_cells_do_not_rule_out_are_dealt_to_blocks(spark, monkeypatch):
    points = table(spark, np.random.default_rng(4).standard_normal((300, 6)))
    want = {(r.a, r.b) for r in pairs.similar_pairs(points, 0.2).collect()}
    monkeypatch.setattr(pairs, "CELL_ROWS", 10)
    monkeypatch.setattr(pairs, "FLAT_BLOCKS", 4)
    found = pairs.similar_pairs(points, 0.2, block=16)
    assert found.count() == len(want) and {(r.a, r.b) for r in found.collect()} == want
    dealt = []
    monkeypatch.setattr(pairs, "_pairs_in_cells", lambda placed, least, block: dealt.append((placed.select("cell").distinct().count(), block)))
    pairs.similar_pairs(points, 0.2, block=16)
    assert dealt == [(1, 75)]


def test_canonicalise_makes_few_candidates_in_several_steps(spark, monkeypatch):
    """Raw events decided a few open ones at a time, with the bounds of what they hold, give what the loop gives; no candidate is
    behind k stored events or behind a sure one."""
    rng = np.random.default_rng(12)
    v, thresholds = random_vectors(13, 60, 8), (0.2, 0.25, 0.8, 2)
    document = [str(d) for d in rng.integers(0, 5, len(v))]
    found, real = [], canonical._candidates
    monkeypatch.setattr(canonical, "OPEN_ROWS", 16)
    monkeypatch.setattr(canonical, "_candidates", lambda *a: found.append(real(*a)) or found[-1])
    assert insert_all(spark, v, document, 10, *thresholds) == inserted(v, document, 10, *thresholds)
    assert len(found) > 2
    for step in found:
        of: dict = {}
        for r in step.collect():
            of.setdefault(r.r, []).append((-r.score, r.f, r.is_event, r.sure))
        for rows in of.values():
            rows.sort()
            assert sum(x[2] for x in rows) <= thresholds[3] and not any(x[2] and x[3] for x in rows[:-1])


@pytest.mark.parametrize("cells_pay", [True, False])
def test_best_stored_finds_the_nearest_of_each_query(spark, monkeypatch, cells_pay):
    v = grouped_vectors(21, 12, 10)
    points = table(spark, v)
    index = cells.CellIndex.build(points.filter("id % 3 > 0").select("id", "vector"))
    monkeypatch.setattr(cells, "rows_sent", lambda *a: 0 if cells_pay else 10**9)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 4)
    got: dict = {}
    for r in pairs.best_stored(points.filter("id % 3 = 0"), index, 40, 0.5, 3).collect():
        got.setdefault(r.query_id, []).append((-round(r.similarity, 12), r.id))
    sims = np.round(v @ v.T, 12)
    for q in range(0, len(v), 3):
        want = sorted((-sims[q, i], i) for i in range(len(v)) if i % 3 and sims[q, i] >= 0.5)[:3]
        assert [i for _, i in sorted(got.get(q, []))[:3]] == [i for _, i in want]


@pytest.mark.parametrize("threshold,groups", [(0.9, 40), (0.3, 8)])
def test_lsh_makes_a_pair_once_where_vectors_meet(spark, threshold, groups):
    """By buckets and, at the low threshold, in blocks: exactly the pairs that share a band, and none is shuffled."""
    v = grouped_vectors(31, groups, 8)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = pairs.similar_pairs(table(spark, v), threshold, "lsh", block=16)
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    bits, bands = pairs.sign_bands(threshold)
    up = (unit @ np.random.default_rng(11).standard_normal((v.shape[1], bits * bands)) > 0).reshape(len(v), bands, bits)
    shared = (up[:, None] == up[None]).all(axis=3).any(axis=2)
    sims = unit @ unit.T
    want = sorted((a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if sims[a, b] >= threshold and shared[a, b])
    assert want and sorted((r.a, r.b) for r in found.collect()) == want


@pytest.mark.parametrize("least,per_key", [(0.75, 10_000), (0.5, 5), (1.0, 10_000)])
def test_rule_pairs_meet_under_few_entities(spark, monkeypatch, least, per_key):
    """All candidates that match by rule, with nulls, a common entity and no dates; far fewer pairs meet than share an entity."""
    monkeypatch.setattr(pairs.split_join, "__defaults__", (per_key,))
    met, real = [], pairs.split_join
    monkeypatch.setattr(pairs, "split_join", lambda *args: met.append(real(*args)) or met[-1])
    rng = random.Random(per_key)
    rows = []
    for k in range(90):
        own = rng.sample("abcdefghijklmnop", rng.randrange(4)) + ["0hot"] + [None] * (k % 7 == 0) + ["0hot"] * (k % 5 == 0)
        first = rng.randrange(1, 60)
        rows.append((k, own, *((None, None) if k % 4 == 0 else (first, first + rng.randrange(12)))))
    rows += [(200, [None], 1, 9), (201, None, 1, 9), (202, [], None, None)]
    frame = spark.createDataFrame(rows, "id long, entity_ids array<string>, s int, e int")
    day = lambda c: F.date_add(F.lit("2000-01-01").cast("date"), F.col(c))
    events = frame.withColumn("date_range", F.when(F.col("s").isNotNull(), F.struct(day("s").alias("start_date"), day("e").alias("end_date"))))
    events = events.withColumns({"year": F.year("date_range.start_date"), "entity_types": F.array()})
    every = pairs.block_candidates(events, ("entity",), sides=("entity_ids", "date_range"))
    want = {(r.a, r.b) for r in every.filter(scores.rule_match(F.col("x"), F.col("y"), least)).collect()}
    met.clear()
    got = pairs.rule_pairs(events, least, sides=("id", "s")).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b) for r in got} == want != set()
    assert all((r.x.id, r.y.id) == (r.a, r.b) for r in got)
    if least > 0.5:
        assert met[0].filter("id_x < id_y").count() < every.count() / 3


def test_merge_stats_counts_uncertain_pairs(spark):
    """Those of the loop that groups at the high threshold: a leader and a later point that no leader has claimed yet."""
    v = random_vectors(12, 60)
    sims, claimed, want = v @ v.T, {}, 0
    for k in range(60):
        if k not in claimed:
            claimed[k] = k
            for j in range(k + 1, 60):
                if j not in claimed and sims[k][j] >= 0.9:
                    claimed[j] = k
                elif j not in claimed and sims[k][j] >= 0.8:
                    want += 1
    groups, uncertain = cluster.vector_uncertain(table(spark, v), 0.9, 0.8)
    assert {r.id: r.leader for r in groups.collect()} == claimed and uncertain.count() == want > 0
    assert cluster.merge_stats(groups, uncertain.count()).first().n_uncertain == want
    assert cluster_queries.merge_stats(spark, "/root/testdata/sf0.01").first().n_uncertain > 0


def test_candidate_query_has_pairs_of_types_and_years(spark):
    """Not those of a common entity only."""
    folder = "/root/testdata/sf0.001"
    got = cluster_queries.block_candidates(spark, folder).distinct()
    for by in ("entity", "type", "year"):
        assert pairs.block_candidates(adapters.events(spark, folder), (by,)).join(got, ["a", "b"], "left_anti").isEmpty()
    assert got.count() == pairs.block_candidates(adapters.events(spark, folder), ("type", "entity", "year")).count()
