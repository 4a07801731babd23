"""Corpus jobs, sources, entities, timelines and streams on hand-made rows."""

from __future__ import annotations

import json
import math
import random
import re
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions import text
from annalist.operators import canonical, entities, scoring, search, tasks, timeline
from annalist.plans import adapters, timeline_queries
from annalist.scratch import shared_dir
from annalist.sources import corpus, tables
from annalist.streaming import ingest


def test_html_main_block_and_fallback():
    page = (
        '<html><body>out<div class="mw-parser-output"><p>One <b>two</b></p><ol class="references"><li>ref</li></ol><table class="infobox x"><tr><td>box</td></tr></table>'
        '<sup class="reference">[1]</sup><sup>2</sup><span class="IPA">ipa</span><br><style>p{}</style><script>var t="</p>"</script>end</div>after</body></html>'
    )
    assert corpus.html_text(page) == "One\ntwo\n2\nend"
    assert corpus.html_text('<body>a<p class="navbox">b</p><script>x</script></body>') == "a\nb" and corpus.html_text(None) == ""


def sliced(text, size, overlap, only_above):
    """Chunks by a plain loop over the ends of units."""
    text = (text or "").strip(" \t\r\n")
    if len(text) <= only_above:
        return [text] if text else []
    units = re.findall(r"(?s).+?(?:\n[ \t\r\n]*\n|\Z)", text)
    if len(units) == 1:
        units = re.findall(r"(?s).+?(?:[.!?]+[ \t\r\n]+|\Z)", text)
    ends, at = [], 0
    for unit in units:
        ends += [at + k for k in range(size - overlap, len(unit), size - overlap)] + [at + len(unit)]
        at += len(unit)
    chunks, begin = [], 0
    while True:
        stop = max(e for e in ends if e <= begin + size)
        chunks.append(text[begin:stop])
        if stop == len(text):
            return chunks
        begin = stop - overlap


def test_chunks_are_overlapping_slices_that_end_with_units(spark):
    rng = random.Random(1)
    unit = lambda: "é" * rng.randrange(1, 90) + rng.choice([". ", "! ", "\n\n", "\n \n ", " "])
    texts = [None, "", " \n ", "short", "x" * 1000, "x. " * 400, "a\n\n" * 300] + ["".join(unit() for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    got = corpus.chunk_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 200, 30, 250).collect()
    expected = [(k, i, c) for k, t in enumerate(texts) for i, c in enumerate(sliced(t, 200, 30, 250))]
    assert sorted((r.doc_id, r.chunk_index, r.chunk_text) for r in got) == expected
    with pytest.raises(ValueError):
        corpus.chunk_documents(spark.createDataFrame([], "doc_id long, text string"), 100, 100)


@pytest.mark.parametrize(
    "answer,expected",
    [
        ('```json\n[{"a": 1}]\n```', [{"a": 1}]), ('Here: {"a": [1, 2]} bye', {"a": [1, 2]}), ('[{"a": "x"}, {"a": "y", "b": "cut', [{"a": "x"}, {"a": "y"}]),
        ('{"events": [{"d": "1"}, {"d": ', {"events": [{"d": "1"}]}), ("no json", None), (None, None), ("see [note]: {\"a\": \"[\"}", {"a": "["}), ("7", 7), ('{"a": "\\\\\\"', {}), ("[" * 5000, []), ("[" * 200_000 + "]" * 200_000, None), ('{"a": "b, ]"', {}),
    ],
)
def test_answers(answer, expected):
    assert corpus.parse_response(answer) == expected


def test_records_and_failures(spark):
    rows = [("1", '[{"a":"x"}]'), ("2", 'so {"a":"y"} done'), ("3", "nothing"), ("4", None), ("5", '[{"a":"z"},{"a":"cu')]
    records, failures = corpus.records_from_responses(spark.createDataFrame(rows, "response_id string, content string"), "a:string")
    assert sorted((r.response_id, r.a) for r in records.collect()) == [("1", "x"), ("2", "y"), ("5", "z")]
    assert {r.response_id for r in failures.collect()} == {"3", "4"}


def test_first_of_each_key_keeps_null_keys_apart(spark):
    rows = spark.createDataFrame([("u", 2), ("u", 1), (None, 3), (None, 4)], "url string, n int")
    assert sorted(r.n for r in tables.dedupe_first(rows, ["url"], ["n"]).collect()) == [1, 3, 4]


def test_insert_update_delete(spark):
    target = spark.createDataFrame([("1", "pending", None), ("2", "pending", None)], "id string, status string, processed_at timestamp")
    changed = tables.apply_updates(target, spark.createDataFrame([("1", "completed")], "id string, status string"))
    got = {r.id: r for r in changed.collect()}
    assert got["1"].processed_at is not None and got["2"].status == "pending"
    new = spark.createDataFrame([("2", "x"), ("3", "y"), ("3", "z")], "id string, status string")
    assert tables.insert_ignore(target, new, ["id"]).count() == 1 and tables.delete_by_key(target, new).count() == 1


def test_tables_have_their_schema(spark):
    folder = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    for name in schemas.COLUMNS:
        spark.createDataFrame([], schemas.schema(name)).write.parquet(f"{folder}/{name}.parquet")
    assert {n: d.columns for n, d in tables.read_tables(spark, folder).items()} == {n: schemas.schema(n).names for n in schemas.COLUMNS}
    assert all(set(k) <= set(schemas.schema(n).names) for n, k in schemas.KEYS.items())


def test_exports(spark):
    work = spark.createDataFrame([("t", "v", 'a "topic"', "completed", None), ("n", "w", "b", "completed", None)], "id string, viewpoint_id string, topic_text string, status string, created_at timestamp")
    work = work.withColumn("config", F.lit(None).cast("map<string,string>"))
    events = spark.createDataFrame([("v", 1, "second"), ("v", 0, "fi\nrst")], "viewpoint_id string, sequence_order int, description string")
    sources = spark.createDataFrame([("v", "src_1", "T, x")], "viewpoint_id string, ref string, title string")
    got = {r.task_id: json.loads(r.json) for r in tables.timeline_json(work, events, sources).collect()}
    assert [e["description"] for e in got["t"]["events"]] == ["fi\nrst", "second"] and got["t"]["sources"] == {"src_1": {"title": "T, x"}}
    assert got["n"]["eventsCount"] == 0 and got["t"]["taskInfo"]["topic"] == 'a "topic"'
    lit = lambda v, t: F.lit(v).cast(t)
    info = F.struct(*[lit(v, "string" if n < 3 else "int") if n < 9 else F.lit(False) for n, v in enumerate(("o", "", "year", 1999, None, None, None, None, None, False))])
    names = ("original_text", "display_text", "precision", "start_year", "start_month", "start_day", "end_year", "end_month", "end_day", "is_bce")
    info = info.cast("struct<" + ",".join(f"{n}:{'string' if k < 3 else 'int' if k < 9 else 'boolean'}" for k, n in enumerate(names)) + ">")
    section = tables.event_markdown(F.lit(1), F.lit("D"), F.lit("1999"), info, F.create_map(F.lit("s"), F.lit("snip")), F.array(F.struct(F.lit("T").alias("title"), F.lit("u").alias("url"))), F.array(F.struct(F.lit("E").alias("original_name"), F.lit("ORG").alias("entity_type"))))
    text = spark.range(1).select(section.alias("s")).first().s
    assert text == "## 1. D\n\n**Date:** 1999\n\n**Date Range:** 1999-01-01 to 1999-12-31\n\n**Representative Source Snippet:** snip\n\n### Sources:\n\n- [T](u)\n\n### Related Entities:\n\n- **E** (ORG)\n\n---\n\n"


def test_views_take_the_last_snippet_of_a_source(spark):
    events = spark.createDataFrame([("e1",), ("e2",)], "id string").withColumns({"description": F.lit("d"), "event_date_str": F.lit("s"), "date_info": F.lit(None).cast(schemas.DATE_INFO)})
    raw = spark.createDataFrame([("r1", "d1", "old"), ("r2", "d1", "new"), ("r3", "d1", " "), ("r4", None, "loose")], "id string, source_document_id string, source_text_snippet string")
    documents = spark.createDataFrame([("d1", "T", "en", "u", "web")], "id string, title string, language string, wikipedia_url string, source_type string")
    links = spark.createDataFrame([("e1", r) for r in ("r1", "r2", "r3", "r4", "gone")], "event_id string, raw_event_id string")
    people = spark.createDataFrame([("p", "P", "ORG")], "id string, entity_name string, entity_type string")
    of = spark.createDataFrame([("e1", "p"), ("e1", "gone")], "event_id string, entity_id string")
    hydrated = timeline.hydrate_events(events, of, people, links, raw, documents)
    view = spark.createDataFrame([("v", "e1", 0, 0.5), ("v", "e2", 1, None)], "viewpoint_id string, event_id string, sequence_order int, relevance_score double")
    first, second = timeline.timeline_view(view, hydrated).orderBy("event_id").collect()
    assert first.source_snippets == {"src_d1": "new", "src_unknown_r4": "loose"} and first.is_merged and len(first.main_entities) == 1
    assert second.source_snippets == {} and not second.is_merged and second.main_entities == []


def test_entities_are_resolved_by_title_then_page(spark):
    asked = spark.createDataFrame([("A", "en", "PERSON"), ("B", "en", "PERSON"), ("C", "en", "PERSON"), ("D", "en", "PLACE"), ("E", "en", None)], "name string, language string, entity_type string")
    documents = spark.createDataFrame([("A", "en", "x1")], "title string, language string, entity_id string")
    pages = spark.createDataFrame([("B", "en", "Q2", False), ("C", "en", "Q3", True), ("D", "en", "Q4", False)], "title string, language string, kb_id string, is_disambiguation boolean")
    known = spark.createDataFrame([("x1", "Q1", "UNKNOWN"), ("x2", "Q2", "ORG")], "id string, wikibase_item string, entity_type string")
    got = {r.name: (r.status, r.resolved_type, r.entity_id) for r in entities.resolve_entities(asked, documents, pages, known).collect()}
    assert got["A"] == (200, "PERSON", "x1") and got["B"] == (202, "ORG", "x2") and got["C"][0] == 300 and got["D"][0] == 201 and got["E"][:2] == (500, "UNKNOWN")


def test_scorers_fall_back_to_single_rows(spark):
    def scorer(rows):
        if len(rows) > 1 and (rows["n"] == 3).any():
            raise ValueError("batch")
        if (rows["n"] == 3).any():
            raise ValueError("row")
        return rows["n"] * 1.0

    rows = spark.createDataFrame([(k % 5,) for k in range(20)], "n int").coalesce(1)
    got = {r.n: r.score for r in scoring.score_rows(rows, ["n"], scorer).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0, 3: None, 4: 4.0}
    answers = spark.createDataFrame([(2, 1, True, 0.8), (3, 4, True, 0.5)], "a long, b long, is_same boolean, confidence double")
    found = scoring.scored_verifier(answers)(spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long"))
    assert [(r.a, r.b) for r in found.collect()] == [(1, 2)]


def test_assembled_articles_skip_what_they_contain(spark):
    rows = [("q", "d1", 1, "alpha beta"), ("q", "d2", 2, "x"), ("q", "d1", 3, "beta"), ("q", "d1", 4, "gamma"), ("q", "d3", 5, "late")]
    ranked = spark.createDataFrame(rows, "query_id string, doc_id string, rank int, chunk_text string")
    got = {r.doc_id: r.text for r in search.assemble_articles(ranked, 2).collect()}
    assert got == {"d1": "alpha beta\n\n... gamma", "d2": "x"}


def test_chunks_of_a_very_long_text_are_its_slices(spark):
    rng = random.Random(2)
    text = "".join(rng.choice(["Höhe 𝄞 und Maß. ", "one two three! ", "x" * 40 + "? "]) for _ in range(60_000)).strip()
    rows = spark.createDataFrame([(1, text), (2, "short"), (3, " \n "), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_index, r.chunk_text) for r in corpus.chunk_documents(rows, 2000, 200, 3000).collect())
    long = [t for d, _, t in got if d == 1]
    assert [k for d, k, _ in got if d == 1] == list(range(len(long))) and got[len(long) :] == [(2, 0, "short")]
    at = 0
    for k, chunk in enumerate(long):
        assert len(chunk) <= 2000 and text[at : at + len(chunk)] == chunk
        assert at + len(chunk) == len(text) or (chunk.endswith(" ") and len(chunk) > 1900)
        at += len(chunk) - 200 if k + 1 < len(long) else len(chunk)
    assert at == len(text)


def test_orders_by_timestamp_and_by_year(spark):
    info = "struct<original_text:string,display_text:string,precision:string,start_year:int,start_month:int,start_day:int,end_year:int,end_month:int,end_day:int,is_bce:boolean>"
    day = lambda y, m, d: ("", "", "day", y, m, d, None, None, None, False)
    rows = [(1, day(2001, 5, 2), 2001), (2, day(1999, 1, 1), None), (3, day(-44, 3, 15), 5), (4, None, 5), (5, day(1999, 1, 1), -3)]
    events = spark.createDataFrame(rows, f"id long, date_info {info}, year int")
    assert [r.id for r in timeline.sort_by_timestamp(events).collect()] == [3, 4, 2, 5, 1]
    assert [r.id for r in timeline.merge_order(events).collect()] == [5, 3, 4, 1, 2]


def test_progress_messages_and_kept_records(spark):
    steps = spark.sql("SELECT array(named_struct('step_name', 's', 'event_timestamp', timestamp'2024-01-02 03:04:05.678', 'message', 'm')) AS steps, 1 AS k")
    [row] = steps.select(F.explode(text.format_progress(F.col("steps"))).alias("m")).select("m.*").collect()
    assert tuple(row) == ("m", "s", "2024-01-02T03:04:05.678Z")
    kept = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 9), (4, "a", 7), (5, None, 9)], "id long, topic string, last_accessed int")
    assert [r.id for r in tasks.recent_by_topic(kept, "a").collect()] == [4, 2, 1]


def test_chunk_corpus_is_read_with_its_schemas(spark, tmp_path):
    for name, schema in (("chunks", schemas.CHUNKS), ("chunk_pages", schemas.PAGES)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    chunks, pages = tables.read_chunk_corpus(spark, str(tmp_path))
    assert chunks.columns == spark.createDataFrame([], schemas.CHUNKS).columns and pages.columns == spark.createDataFrame([], schemas.PAGES).columns
    assert chunks.count() == pages.count() == 0


def test_pages_and_filters_check_their_input(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, k string")
    assert tasks.filter_by(rows, k=None).count() == 1 and tasks.filter_any(rows, []).count() == 0
    for bad in ((0, 0), (101, 0), (5, -1)):
        with pytest.raises(ValueError):
            tasks.page(rows, ["id"], *bad)
    with pytest.raises(ValueError):
        search.hybrid_chunks(rows, rows, 0, 0)


def test_stream_canonicalise_in_two_batches_equals_one(spark):
    base = [[1.0, 0.0], [0.99, 0.05], [0.0, 1.0], [0.02, 1.0], [0.7, 0.7]]
    rows = [(k, k, base[k], str(k % 2)) for k in range(5)]
    schema = "id long, rank long, vector array<double>, document_id string"
    folder = f"{shared_dir(spark)}/canonical-{uuid.uuid4().hex}"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        ingest.stream_canonicalise(stream.withColumn("vector", F.col("vector").cast("array<float>")), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    links = {r.raw_id: r.event_id for r in spark.read.parquet(f"{folder}/out/links").collect()}
    assert links == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_stream_canonicalise_query_matches_and_equals_one_batch(spark, tmp_path):
    """Several batches, with matches, give what one insertion of all rows gives."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((90, 6))
    rows = [(k, [float(x) for x in row], 0) for k, row in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.raw_id: r.event_id for r in timeline_queries.stream_canonicalise(spark, str(tmp_path)).collect()}
    raw = spark.createDataFrame([(k, k, x, str(k % 20)) for k, x, _ in rows], "id long, rank long, vector array<float>, document_id string")
    none = spark.createDataFrame([], "event_id long, vector array<float>, document_ids array<string>")
    want = {r.raw_id: r.event_id for r in canonical.canonicalise(raw, none, 0.30, 0.32, 0.40).collect()}
    assert got == want and len(set(got.values())) < 70


def test_stream_uniqueness_never_expires(spark):
    """A copy a year later, in a query started anew from the checkpoint, is dropped; so is one of a stored row."""
    folder = f"{shared_dir(spark)}/unique-{uuid.uuid4().hex}"
    schema = "id long, source_document_id string, description string, event_date_str string, created_at timestamp"
    stored = spark.sql("SELECT 'd9' AS source_document_id, sha2('d9-old-1', 256) AS deduplication_signature")
    batches = [
        [(1, "d1", "a", "1", "2024-01-01"), (2, "d1", "a", "1", "2024-01-02"), (3, "d9", "old", "1", "2024-01-01"), (4, None, "a", "1", "2024-01-01")],
        [(5, "d1", "a", "1", "2025-06-01"), (6, "d2", "a", "1", "2025-06-01"), (7, None, "a", "1", "2025-06-01")],
        [(8, "d1", "a", "1", "2029-06-01"), (9, "d2", "a", "1", "2019-06-01"), (10, "d3", "b", None, "2029-06-01"), (11, "d9", "old", "1", "2029-06-01")],
    ]
    for part in batches:
        rows = spark.createDataFrame([(*r[:4], r[4]) for r in part], schema.replace("timestamp", "string"))
        rows.withColumn("created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = ingest.stream_dedupe_raw_events(spark.readStream.schema(schema).parquet(f"{folder}/in"), stored)
        ingest.run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    got = sorted(r.id for r in spark.read.parquet(f"{folder}/out").collect())
    assert got in ([1, 4, 6, 10], [2, 4, 6, 10])


def test_stream_status_keeps_the_latest(spark):
    folder = f"{shared_dir(spark)}/status-{uuid.uuid4().hex}"
    schema = "task_id string, status string, changed_at timestamp"
    rows = spark.sql("SELECT * FROM VALUES ('a', 'pending', timestamp'2024-01-01'), ('a', 'completed', timestamp'2024-01-02'), ('b', 'pending', timestamp'2024-01-01') AS t(task_id, status, changed_at)")
    rows.write.parquet(f"{folder}/in")
    seen = {}
    status = ingest.stream_task_status(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    ingest.run_to_table(status, "", f"{folder}/checkpoint", "update", lambda df, _: seen.update({r.task_id: (r.status, r.is_terminal) for r in df.collect()})).awaitTermination()
    assert seen == {"a": ("completed", True), "b": ("pending", False)}


def test_tfidf_cosine_is_a_plain_loop(spark):
    rng = random.Random(4)
    words = ["the"] * 9 + [f"w{k}" for k in range(30)]
    items = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(60), " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(150)]
    items += [(1, None, "the w1"), (2, 7, None), (3, 900, "..."), (9, 1, "no topic"), (None, 5, "the"), (1, 901, "the " * 5000)]
    topics = [(1, "w1 w2 w2 unseen the"), (2, ""), (3, "W3, w4!"), (4, "w1")]
    together, asked = {}, {t: re.findall(r"\w+", x.lower()) for t, x in topics}
    for t, i, x in items:
        if t in asked:
            together.setdefault((t, i), []).extend(re.findall(r"\w+", (x or "").lower()))
    df = {}
    for ws in together.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1

    def vector(ws):
        return {w: ws.count(w) * (1 + math.log((1 + len(together)) / (1 + df.get(w, 0)))) for w in set(ws)}

    def cosine(x, y):
        size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(w, 0) for w, v in x.items()) / size if size else 0.0

    frames = spark.createDataFrame(items, "topic_id long, item_id long, text string"), spark.createDataFrame(topics, "topic_id long, topic_text string")
    got = {(r.topic_id, r.item_id): r.score for r in scoring.tfidf_scores(*frames).collect()}
    assert set(got) == set(together)
    for (t, i), ws in together.items():
        assert got[t, i] == pytest.approx(cosine(vector(ws), vector(asked[t])), abs=1e-8)
    assert scoring.tfidf_scores(frames[0].limit(0), frames[1]).count() == 0 == scoring.tfidf_scores(frames[0], frames[1].limit(0)).count()


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    held_out = F.col("doc_id") % 4 == 1
    model = corpus.fit_languages(docs.filter(~held_out))
    got = corpus.classify_languages(docs.filter(held_out).select("doc_id", "text"), model).join(docs, "doc_id")
    right, n = got.agg(F.count_if(F.col("language") == F.col("lang")), F.count("lang")).first()
    assert n > 200 and right >= 0.97 * n


def test_languages_of_odd_texts(spark):
    labelled = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der Hund und die Katze"), (None, "qqq"), ("fr", None)], "lang string, text string")
    model = corpus.fit_languages(labelled, 4)
    texts = [(1, "The dog"), (2, "die Katze"), (3, None), (4, "12 -- 3"), (5, ""), (6, "the " * 50000), (7, "a" * 20000), (8, "die"), (8, "Katze")]
    got = {r.doc_id: (r.language, r.margin) for r in corpus.classify_languages(spark.createDataFrame(texts, "doc_id long, text string"), model, 4).collect()}
    assert {k: v[0] for k, v in got.items() if k != 7} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en", 8: "de"}
    assert got[7][0] in ("de", "en") and got[3][1] is None and got[6][1] > 0
    untaught = corpus.fit_languages(labelled.limit(0))
    assert {r.language for r in corpus.classify_languages(spark.createDataFrame(texts, "doc_id long, text string"), untaught).collect()} == {"und"}


def test_a_source_that_fails_leaves_the_others_whole(spark):
    asked = spark.range(40, numPartitions=4)
    row = [F.concat(F.lit("u"), F.col("id") % 10).alias("source_url"), F.col("id").cast("string").alias("source_identifier")]

    def unplanned(rows):
        raise ConnectionError("no route\nto host")

    late = F.when(F.col("id") == 39, F.raise_error(F.lit("late"))).otherwise("x")
    sources = {"first": lambda rows: rows.filter("id < 5").select(*row), "late": lambda rows: rows.select(*row, late.alias("title")), "unplanned": unplanned, "all": lambda rows: rows.select(*row)}
    articles, status = corpus.acquire_with_status(asked, ["late", "first", "unplanned", "other", "all"], sources)
    assert sorted(r.source_url for r in articles.collect()) == [f"u{k}" for k in range(10)]
    assert sorted((r.source, r.state, r.n_articles) for r in status.collect()) == [("all", "ok", 40), ("first", "ok", 5), ("late", "failed", 0), ("other", "unknown", 0), ("unplanned", "failed", 0)]
    assert status.filter("source = 'unplanned'").first().error == "no route"
    none, _ = corpus.acquire_with_status(asked, ["unplanned"], sources)
    assert none.count() == 0 and none.columns == ["source_name", "source_url", "source_identifier"]
    with pytest.raises(ValueError):
        corpus.acquire_articles(asked, ["other"], sources)


def test_view_of_an_event_with_many_sources(spark):
    rng = random.Random(2)
    raw = [(f"r{k:03}", rng.choice([" ", None, f"s{k}"]), rng.choice([None, "d1", "d2", "d3"]), None, "en", None, "web") for k in range(80)]
    fields = "raw_event_id:string,source_text_snippet:string,source_document_id:string,title:string,language:string,url:string,source_type:string"
    schema = f"id string, description string, event_date_str string, date_info string, entities array<struct<entity_id:string,entity_name:string,entity_type:string>>, raw_events array<struct<{fields}>>"
    hydrated = spark.createDataFrame([("e", "d", "1999", None, None, raw), ("f", "d", "1999", None, None, None)], schema)
    links = spark.createDataFrame([("v", "e", 0, 1.0), ("v", "f", 1, 1.0)], "viewpoint_id string, event_id string, sequence_order int, relevance_score double")
    one, other = timeline.timeline_view(links, hydrated).orderBy("event_id").collect()
    snippets, order = {}, []
    for r in raw:
        ref = f"src_{r[2]}" if r[2] else f"src_unknown_{r[0]}"
        order += [ref] if ref not in order else []
        if r[1] and r[1].strip():
            snippets[ref] = r[1]
    assert one.source_snippets == snippets and [s.ref for s in one.sources] == order and one.is_merged
    assert other.source_snippets == {} and other.sources == [] and not other.is_merged and other.main_entities == []


def test_every_date_of_a_sentence_is_an_event(spark):
    text = (
        "In 1914 the Great War began, and by November 11, 1918 it was over in Compiegne. Between 1939-09-01 and 1945 nothing; between 1939 and 1945 Europe burned!\n"
        "Rome fell from 410 to the end. Caesar died in 44 BC; the 5th century BC - 3rd century BC, the late 1960s, mid 20th century, spring of 1848, 3rd of May 1791 and 1803–1815. No date here, room 12."
    )
    docs = [(1, text), (2, None), (3, ""), (4, "x " * 100000 + "1999")] + [(10 + k, "In 1999 it was. In 1999 it was.") for k in range(50)]
    got = corpus.extract_dated_events(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = got.orderBy("doc_id", "position", "place").collect()
    one = [(r.position, r.place, r.event_date_str) for r in rows if r.doc_id == 1]
    assert one == [
        (0, 0, "1914"), (0, 1, "November 11, 1918"), (1, 0, "1939-09-01"), (1, 1, "1945"), (1, 2, "between 1939 and 1945"), (3, 0, "44 BC"), (3, 1, "5th century BC - 3rd century BC"),
        (3, 2, "late 1960s"), (3, 3, "mid 20th century"), (3, 4, "spring of 1848"), (3, 5, "3rd of May 1791"), (3, 6, "1803–1815"),
    ]
    assert all(r.date_info.precision != "unknown" for r in rows)
    first = rows[0]
    assert first.entities == ["Great War", "Compiegne"] and first.date_info.start_year == 1914 and first.description.startswith("In 1914")
    war, caesar = (next(r.date_info for r in rows if r.event_date_str == d) for d in ("between 1939 and 1945", "44 BC"))
    assert (war.start_year, war.end_year, caesar.start_year, caesar.is_bce) == (1939, 1945, -44, True)
    assert {r.doc_id for r in rows} == {1, 4, *range(10, 60)} and len(rows) == len(one) + 1 + 100


def test_config_checks_of_halves_and_no_weights(spark, tmp_path):
    """Limits of a half are rounded up in both engines, and a hybrid search without weights is wrong in both."""
    from annalist.plans import catalog
    from tests.compare import assert_same, engine

    rows = spark.createDataFrame([(4, 0.0), (3, 0.5), (6, 50.5), (9, 2.5), (16, 7.0)], "event_id long, value double")
    rows.coalesce(1).toPandas().to_parquet(f"{tmp_path}/events.parquet")
    found = catalog.QUERIES["config_checks"](spark, str(tmp_path))
    assert {r.id: r.errors for r in found.collect()} == {4: "article_limit,weights", 6: "article_limit"}
    assert_same(found, engine(str(tmp_path)), catalog.ORACLES["config_checks"])


def test_exports_make_sources_once_an_event(spark):
    work = spark.createDataFrame([("t", "v", "topic", "completed")], "id string, viewpoint_id string, topic_text string, status string")
    work = work.withColumns({"config": F.create_map(F.lit("a"), F.lit("b")), "created_at": F.lit(None).cast("timestamp")})
    rows = [("v", 0, ["src_10", "src_1"]), ("v", 1, ["src_1", 'src_"2']), ("v", 2, [])]
    events = spark.createDataFrame(rows, "viewpoint_id string, sequence_order int, refs array<string>")
    source = lambda r: F.struct(r.alias("ref"), F.concat(F.lit("T"), r).alias("title"))
    listed = events.select("viewpoint_id", F.explode("refs").alias("r")).select("viewpoint_id", source(F.col("r")).alias("s")).select("viewpoint_id", "s.*").distinct()
    brought = events.select("viewpoint_id", "sequence_order", F.transform("refs", lambda r: tables.source_entry(source(r), ["title"])).alias("source_entries"))
    want = tables.timeline_json(work, events.drop("refs"), listed).collect()
    assert tables.timeline_json(work, brought).collect() == want and json.loads(want[0].json)["sourcesCount"] == 3


def test_documents_of_many_raw_events_are_not_a_shuffle_key(spark):
    events = spark.createDataFrame([("e",)], "id string")
    raw = spark.createDataFrame([("r", "d", "s")], "id string, source_document_id string, source_text_snippet string")
    documents = spark.createDataFrame([("d", "T", "en", "u", "web")], "id string, title string, language string, wikipedia_url string, source_type string")
    hydrated = timeline.hydrate_events(events, None, None, spark.createDataFrame([("e", "r")], "event_id string, raw_event_id string"), raw, documents)
    plan = hydrated._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source_document_id" not in plan and hydrated.first().raw_events[0].title == "T"


def test_pages_are_cleaned_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(corpus, "PAGE_ROWS", 3)
    pages = spark.createDataFrame([(n, f"u{n}", f"<p>t{n}</p>" if n else None) for n in range(10)], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text_content for r in corpus.pages_to_articles(pages).collect()}
    assert got == {n: f"t{n}" if n else "" for n in range(10)}


def test_few_query_terms_are_sent_to_the_words(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, "a b b"), (2, "c a"), (3, None)], "chunk_id long, chunk_text string")
    queries = spark.createDataFrame([("q", "b a"), ("r", "c z")], "query_id string, query_text string")
    sent = search.bm25_scores(chunks, queries)
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    assert sorted(sent.collect()) == sorted(search.bm25_scores(chunks, queries).collect()) != []


def spooled(monkeypatch, module):
    """The tables that a module writes, by name, with their plans as they were."""
    kept, real = {}, module.spool

    def keep(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        kept[name] = real(df, name), plan
        return kept[name][0]

    monkeypatch.setattr(module, "spool", keep)
    return kept


def test_tfidf_sends_no_text_to_the_task_of_its_topic(spark, monkeypatch):
    items = spark.createDataFrame([(k % 3, k, f"alpha word{k % 4} word{k % 7} beta") for k in range(30)], "topic_id long, item_id long, text string")
    topics = spark.createDataFrame([(0, "alpha word1 word1"), (1, "beta word5 none"), (7, "gamma")], "topic_id long, topic_text string")
    kept = spooled(monkeypatch, scoring)
    got = {(r.topic_id, r.item_id): r.score for r in scoring.tfidf_scores(items, topics).collect()}
    assert len(got) == 20 and "SortMergeJoin" not in kept["item-words"][1]
    monkeypatch.setattr(scoring, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(scoring, "FREQUENT_SHARE", 3)
    assert got == {(r.topic_id, r.item_id): r.score for r in scoring.tfidf_scores(items, topics).collect()}


def test_classify_languages_counts_words_where_they_are_read(spark, monkeypatch):
    """A row for all frequent words of a text; with rarer words and many n-grams the same answer."""
    labelled = spark.createDataFrame([("en", "the house and the garden of the king"), ("de", "das haus und der garten des königs"), (None, "zzz")], "lang string, text string")
    texts = [(k, f"the house {'und der garten' if k % 3 else 'of the king'} w{'abc'[k % 3] * (k % 5)}") for k in range(20)] + [(3, "der der"), (50, None), (51, "12 !")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = corpus.fit_languages(labelled)
    kept = spooled(monkeypatch, corpus)
    read = lambda: sorted((r.doc_id, r.language, r.margin) for r in corpus.classify_languages(docs, model).collect())
    got = read()
    assert kept["document-sums"][0].count() == 20 and "word-grams" not in kept
    monkeypatch.setattr(corpus, "FREQUENT_SHARE", 8)
    assert read() == got and kept["document-sums"][0].count() > 20
    monkeypatch.setattr(corpus, "BROADCAST_ROWS", 0)
    assert read() == got and "word-grams" in kept


@pytest.mark.parametrize("share", [200_000, 25])
@pytest.mark.parametrize("copies", [False, True])
def test_top_keywords_keeps_few_rows_of_a_document(spark, monkeypatch, share, copies):
    rng = np.random.default_rng(2)
    texts = {k: " ".join(["common", "usual", *(f"word{'abcdefghij'[x]}{'klmnopqrst'[y]}" for x, y in zip(rng.integers(0, 10, 30) ** 2 // 9, rng.integers(0, 10, 30)))]) for k in range(40)}
    rows = [*texts.items(), (90, None), *([(1, texts[2])] if copies else [])]
    monkeypatch.setattr(corpus, "FREQUENT_SHARE", share)
    kept = spooled(monkeypatch, corpus)
    got = sorted((r.doc_id, r["rank"], r.keyword, r.score) for r in corpus.top_keywords(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect())
    tf: dict = {}
    for k, text in rows:
        for w in (text or "").split():
            tf.setdefault(k, {})[w] = tf.get(k, {}).get(w, 0) + 1
    df = Counter(w for of in tf.values() for w in of)
    want = []
    for k, of in tf.items():
        best = sorted((-round(n * math.log(len(rows) / df[w]), 6), w) for w, n in of.items())[:3]
        want += [(k, place + 1, w, -s) for place, (s, w) in enumerate(best)]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(got, sorted(want), strict=True))
    if share > 25:
        assert kept["able-keywords"][0].count() < sum(map(len, tf.values())) * 0.4


def test_bm25_shuffles_no_words(spark, monkeypatch):
    """Scores are made where a chunk is read; of keys or query ids that repeat a term counts as in the SQL."""
    rng = random.Random(8)
    texts = [(k, " ".join(rng.choices("abcdefgh", k=rng.randrange(12)))) for k in range(60)] + [(60, None)]
    queries = spark.createDataFrame([("q", "b a z"), ("r", "c c"), ("q", "a"), (None, "d"), ("none", "")], "query_id string, query_text string")
    plain = spark.createDataFrame(texts, "chunk_id long, chunk_text string")
    monkeypatch.setattr(search, "ROWS", 7)
    got = search.bm25_scores(plain, queries)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    words = {k: (t or "").split() for k, t in texts}
    mean, df = sum(map(len, words.values())) / len(words), Counter(w for own in words.values() for w in set(own))
    want = {}
    for query, asked in (("q", "abz"), ("r", "c"), (None, "d")):
        for k, own in words.items():
            parts = [math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in asked if w in own]
            if parts:
                want[query, k] = pytest.approx(sum(parts), abs=2e-9)
    assert {(r.query_id, r.chunk_id): r.score for r in got.collect()} == want
    twice = plain.union(plain.limit(5))
    merged = search.bm25_scores(twice, queries).collect()
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    assert sorted(merged, key=str) == sorted(search.bm25_scores(twice, queries).collect(), key=str) != []


def test_hybrid_search_shuffles_found_texts_only(spark, tmp_path):
    """Few found chunks are sent to the texts, which needn't meet the vectors; vectors whose id repeats still repeat a chunk."""
    docs = spark.createDataFrame([(k, f"w{k % 4} common text {k}") for k in range(12)], "doc_id long, text string")
    vecs = spark.createDataFrame([(k, [float(k + 1), 1.0]) for k in range(4)], "vec_id long, embedding array<float>")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    vecs.write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "w1 text"), (1, "w3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    chunks, texts, queries = (f(spark, str(tmp_path)) for f in (adapters.chunks, adapters.chunk_texts, adapters.queries))
    found = search.hybrid_search(chunks, queries, 3, texts=texts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(found.collect()) == sorted(search.hybrid_search(chunks, queries, 3).collect()) != []
    assert "Join" not in texts._jdf.queryExecution().executedPlan().toString()
    vecs.union(vecs.limit(1)).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/more/embeddings.parquet")
    docs.write.parquet(f"{tmp_path}/more/documents.parquet")
    both = [f(spark, f"{tmp_path}/more") for f in (adapters.chunks, adapters.chunk_texts)]
    assert sorted(both[0].drop("vector").collect()) == sorted(both[1].collect()) and both[1].count() > 12


def test_view_query_shows_all_of_an_event(spark):
    rows = timeline_queries.timeline_view(spark, "/root/testdata/sf0.001").collect()
    assert {"event_date_str", "start_year", "main_entities", "sources"} <= set(rows[0].asDict())
    assert all(re.fullmatch(r"\d+=Supplier#\d+ \(ORG\)(;\d+=Supplier#\d+ \(ORG\))*", r.main_entities) for r in rows)
    assert all(len(r.sources.split(";")) >= len([s for s in r.source_snippets.split(";") if s]) for r in rows) and any("NATION_" in r.sources for r in rows)


def test_json_of_few_documents_carries_ids_only(spark, monkeypatch):
    """Documents are looked up behind the shuffle; sources of no document, and ids that could be mistaken, stay whole. The result is the same."""
    work = spark.createDataFrame([("t", "v", "topic", "completed"), ("u", "w", "none", "completed")], "id string, viewpoint_id string, topic_text string, status string")
    work = work.withColumns({"config": F.create_map(F.lit("a"), F.lit("b")), "created_at": F.lit(None).cast("timestamp")})
    documents = spark.createDataFrame([("1", "T1", "en", "u1", "web"), ("10", 'T"10', None, None, "web")], "id string, title string, language string, wikipedia_url string, source_type string")
    source = "struct<ref:string,title:string,language:string,url:string,source_type:string>"
    one, ten, gone, loose = ("src_1", "T1", "en", "u1", "web"), ("src_10", 'T"10', None, None, "web"), ("src_9", None, None, None, None), ("src_unknown_r", None, None, None, None)
    events = spark.createDataFrame([("v", 0, [ten, one]), ("v", 1, [loose, one, gone]), ("v", 2, []), ("v", 3, None)], f"viewpoint_id string, sequence_order int, sources array<{source}>")
    columns = ("title", "language", "url", "source_type")

    def made(docs):
        few, entries = tables.short_sources(docs, columns)
        brought = events.select("viewpoint_id", "sequence_order", entries.alias("source_entries"))
        return few, brought, sorted(tables.timeline_json(work, brought, few=few).collect())

    few, brought, got = made(documents)
    assert sorted(len(r.source_entries or []) for r in brought.collect()) == [0, 0, 1, 3] and few.count() == 2
    assert json.loads(got[0].json)["sourcesCount"] == 4 and json.loads(got[0].json)["sources"]["src_10"] == {"title": 'T"10', "source_type": "web"}
    assert all(made(documents.union(spark.createDataFrame([(x, "T", "en", "u", "web")], documents.schema)))[0] is None for x in ("1", "a,b", "unknown_r", '"', None))
    monkeypatch.setattr(tables, "FEW_SOURCES", 1)
    few, _, whole = made(documents)
    assert few is None and whole == got


def test_raw_events_and_links_are_shuffled_by_numbers(spark):
    plan = timeline_queries.export_json(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(concat_ws(-, cast(l_orderkey") == 2 and "hashpartitioning(raw_event_id" not in plan


def test_markdown_of_few_documents_carries_ids_only(spark, monkeypatch):
    """The lines of sources are made where a document is; the texts are those of whole sections, also where numbers tie and sources have no document."""
    folder = "/root/testdata/sf0.001"
    brought, real, every = [], tables.timeline_markdown, timeline_queries._documents
    monkeypatch.setattr(timeline_queries, "_documents", lambda *args: every(*args).filter("cast(id AS int) < 5"))
    monkeypatch.setattr(tables, "timeline_markdown", lambda *args: brought.append(args[1].columns) or real(*args))
    got = sorted(timeline_queries.export_markdown(spark, folder).collect())
    monkeypatch.setattr(tables, "FEW_SOURCES", 1)
    assert sorted(timeline_queries.export_markdown(spark, folder).collect()) == got
    assert brought == [["viewpoint_id", "number", "before", "sources", "after"], ["viewpoint_id", "number", "section"]]
    assert any("](u" in r.markdown and "- Source\n" in r.markdown for r in got)
