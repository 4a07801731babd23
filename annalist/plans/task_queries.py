"""Queries of tasks, entities, documents and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import scores, text, urls
from annalist.operators import entities, tasks, timeline
from annalist.plans import adapters as a
from annalist.plans.registry import Registry
from annalist.sources import corpus, tables

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_T = f"WITH tasks AS ({a.TASK_SQL})"


@query(f"{_T} SELECT id, topic_text, status FROM tasks WHERE coalesce(is_public, false) OR coalesce(owner_id = '7', false)")
def visible_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.visible_tasks(a.tasks(spark, sf_dir), "7").select("id", "topic_text", "status")


@query(f"""{_T} SELECT id, owner_id, c_name owner_name, created_at FROM (SELECT * FROM tasks WHERE status = 'completed' AND (is_public OR coalesce(owner_id = '7', false))
ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40) LEFT JOIN customer ON cast(c_custkey AS varchar) = owner_id""")
def list_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks.list_tasks(a.tasks(spark, sf_dir), a.users(spark, sf_dir), "7", status="completed", offset=40)
    return rows.select("id", "owner_id", "owner_name", "created_at")


@query(f"""{_T} SELECT t.id, n_events FROM tasks t JOIN (SELECT l_orderkey, count(*) n_events FROM lineitem GROUP BY 1) ON cast(l_orderkey AS varchar) = viewpoint_id
WHERE is_public AND status = 'completed' ORDER BY created_at DESC, t.id DESC LIMIT 50""")
def public_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.public_timelines(a.tasks(spark, sf_dir), a.viewpoint_links(spark, sf_dir), 50).select("id", "n_events")


@query(f"""{_T}, hit AS (SELECT trim(topic_text) topic, CASE WHEN cast(id AS bigint) % 2 = 0 THEN 'online_wikipedia' ELSE 'online_wikinews' END src, id, viewpoint_id, created_at FROM tasks
  WHERE status = 'completed' AND cast(viewpoint_id AS bigint) % 3 <> 0 AND trim(topic_text) <> '')
SELECT topic, src data_source_preference, arg_max(id, (created_at, id)) task_id FROM hit GROUP BY 1, 2""")
def reusable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = a.tasks(spark, sf_dir)
    source = F.when(F.col("id").cast("long") % 2 == 0, "online_wikipedia").otherwise("online_wikinews").alias("data_source_preference")
    state = F.when(F.col("viewpoint_id").cast("long") % 3 == 0, "failed").otherwise("completed").alias("status")
    views = own.filter("trim(topic_text) <> ''").select(F.col("viewpoint_id").alias("id"), F.trim("topic_text").alias("topic"), source, state)
    return tasks.reusable_tasks(views.select("topic", "data_source_preference"), own, views).drop("viewpoint_id")


@query(f"""{_T} SELECT id, CASE WHEN task_type = 'other' THEN 'task_type,required_field' ELSE 'required_field' END errors FROM tasks
WHERE NOT coalesce((task_type = 'synthetic_viewpoint' AND trim(topic_text) <> '') OR (task_type = 'entity_canonical' AND coalesce(entity_id, '') <> '')
  OR (task_type = 'document_canonical' AND source_document_id <> ''), false)""")
def task_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = tasks.check_tasks(a.tasks(spark, sf_dir))[1]
    return wrong.select("id", F.array_join("errors", ",").alias("errors"))


@query("""WITH c AS (SELECT event_id id, CASE event_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'hybrid_title_search' ELSE 'other' END m, value / 100 w, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE value / 200 END b, cast(round(value) AS int) l FROM events),
d AS (SELECT *, m = 'hybrid_title_search' AND w = 0 AND b = 0 unweighed FROM c)
SELECT id, array_to_string([x for x in [CASE WHEN m = 'other' THEN 'search_mode' END, CASE WHEN w > 1 THEN 'vector_weight' END, CASE WHEN b > 1 THEN 'bm25_weight' END,
 CASE WHEN l NOT BETWEEN 1 AND 50 THEN 'article_limit' END, CASE WHEN unweighed THEN 'weights' END] if x IS NOT NULL], ',') errors FROM d WHERE m = 'other' OR w > 1 OR b > 1 OR l NOT BETWEEN 1 AND 50 OR unweighed""")
def config_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("event_id") % 3 == 0, "semantic").when(F.col("event_id") % 3 == 1, "hybrid_title_search").otherwise("other")
    rows = a.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), mode.alias("search_mode"), (F.col("value") / 100).alias("vector_weight"),
        F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value") / 200).alias("bm25_weight"), F.round("value").cast("int").alias("article_limit"), F.lit(None).cast("double").alias("relevance_threshold"),
    )
    return tasks.check_configs(rows)[1].select("id", F.array_join("errors", ",").alias("errors"))


@query(f"{_T} SELECT DISTINCT trim(topic_text) topic FROM tasks WHERE trim(topic_text) <> ''")
def topics_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.export_topics(a.tasks(spark, sf_dir))


@query(f"""{_T} SELECT id, CASE task_type WHEN 'synthetic_viewpoint' THEN 'Synthetic Viewpoint' WHEN 'entity_canonical' THEN 'Entity Timeline' WHEN 'document_canonical' THEN 'Document Timeline' ELSE 'Unknown Type' END type_name,
 CASE task_type WHEN 'synthetic_viewpoint' THEN topic_text WHEN 'entity_canonical' THEN 'Entity: ' || coalesce(entity_id, 'Unknown')
  WHEN 'document_canonical' THEN 'Document: ' || coalesce(nullif(source_document_id, ''), 'Unknown') ELSE 'Unknown source' END description FROM tasks""")
def task_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return a.tasks(spark, sf_dir).select(
        "id", urls.task_type_name(c("task_type")).alias("type_name"),
        urls.task_description(c("task_type"), c("topic_text"), c("entity_id"), c("source_document_id")).alias("description"),
    )


@query(f"""{_T} SELECT id FROM tasks WHERE (status = 'completed' AND task_type = 'other') OR (status = 'failed' AND task_type = 'entity_canonical')""")
def filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [{"status": "completed", "task_type": "other"}, {"status": "failed", "task_type": "entity_canonical"}]
    return tasks.filter_any(a.tasks(spark, sf_dir), sets).select("id")


@query(f"""{_T} SELECT id FROM tasks WHERE (owner_id, status) IN (SELECT cast(c_custkey AS varchar), CASE WHEN c_custkey % 2 = 0 THEN 'completed' ELSE 'failed' END FROM customer WHERE c_nationkey < 5)""")
def filter_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = a.read(spark, sf_dir, "customer").filter("c_nationkey < 5").select(
        F.col("c_custkey").cast("string").alias("owner_id"), F.when(F.col("c_custkey") % 2 == 0, "completed").otherwise("failed").alias("status")
    )
    return tasks.filter_tuples(a.tasks(spark, sf_dir), keys).select("id")


@query("""SELECT count(*) total_requests, round(avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 3) success_rate, round(avg(floor(value)), 3) average_response_time,
 round(avg(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 3) cache_hit_rate,
 (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'rate_limit' ELSE 'timeout' END k, count(*) n FROM events WHERE event_type = 'error' GROUP BY 1)) errors FROM events""")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = scores.error_class(F.when(F.col("event_id") % 2 == 1, "TimeoutException"), F.when(F.col("event_id") % 2 == 0, 429), F.lit(None).cast("string"))
    log = a.read(spark, sf_dir, "events").select(
        (F.col("event_type") != "error").alias("success"), F.floor("value").cast("double").alias("response_time"), (F.col("event_type") == "view").alias("from_cache"), kind.alias("error_type")
    )
    pairs = F.transform(F.map_entries("errors_by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return tasks.request_metrics(log).withColumn("errors", F.array_join(pairs, ",")).drop("errors_by_type")


@query("""WITH r AS (SELECT event_id id, CASE event_id % 4 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'server_busy' WHEN 2 THEN 'timeout' ELSE 'unknown' END kind, cast(event_id % 7 AS int) attempt FROM events)
SELECT id, kind, round(least(30.0, 0.5 * pow(CASE kind WHEN 'rate_limit' THEN 3.0 WHEN 'server_busy' THEN 2.0 WHEN 'timeout' THEN 1.8 ELSE 1.5 END, attempt)), 6) delay,
 attempt < CASE kind WHEN 'rate_limit' THEN 5 WHEN 'server_busy' THEN 4 WHEN 'timeout' THEN 3 ELSE 2 END may_retry FROM r""")
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    status = F.when(k == 0, 429).when(k == 1, 503)
    kind = scores.error_class(F.when(k == 2, "ReadTimeout"), status, F.lit(None).cast("string"))
    rows = a.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("kind"), (F.col("event_id") % 7).cast("int").alias("attempt"))
    return rows.select("id", "kind", F.round(scores.retry_delay(F.col("kind"), F.col("attempt")), 6).alias("delay"), scores.may_retry(F.col("kind"), F.col("attempt")).alias("may_retry"))


_WIKI = "CASE page_id % 4 WHEN 0 THEN 'https://en.wikipedia.org/wiki?curid=' || page_id WHEN 1 THEN 'https://de.wikipedia.org/wiki/Title_' || page_id WHEN 2 THEN url ELSE 'https://www.wikinews.org/x?y=1&curid=' || page_id END"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = F.col("page_id") % 4, F.col("page_id").cast("string")
    made = (
        F.when(p == 0, F.concat(F.lit("https://en.wikipedia.org/wiki?curid="), i)).when(p == 1, F.concat(F.lit("https://de.wikipedia.org/wiki/Title_"), i))
        .when(p == 2, F.col("url")).otherwise(F.concat(F.lit("https://www.wikinews.org/x?y=1&curid="), i))
    )
    return a.read(spark, sf_dir, "pages").select("page_id", made.alias("url"))


@query(f"""WITH p AS (SELECT page_id, {_WIKI} u FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'https://de.wikipedia.org/wiki?curid=' || page_id ELSE u END normal, CASE WHEN page_id % 4 IN (0, 3) THEN cast(page_id AS varchar) END curid, page_id % 4 <> 3 AND contains(u, 'wikipedia.org') encyclopedia FROM p""")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    page = F.when(F.col("page_id") % 4 == 1, F.col("page_id").cast("string"))
    return _pages(spark, sf_dir).select(
        "page_id", urls.normalise_url(u, page).alias("normal"), urls.page_id_from_url(u).alias("curid"), urls.is_encyclopedia_source(F.lit("web"), u).alias("encyclopedia")
    )


@query(f"""WITH p AS (SELECT page_id, {_WIKI} u FROM pages), h AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1)), '^(.*?)www\\.', '\\1') d FROM p)
SELECT page_id, d AS domain, CASE WHEN contains(d, 'wikipedia.org') THEN 'Wikipedia' WHEN contains(d, 'wikinews.org') THEN 'Wikinews' ELSE '' END label,
 CASE WHEN page_id % 3 = 0 THEN 'Page ' || page_id ELSE 'View on ' || d END link_text FROM h""")
def source_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    title = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Page "), F.col("page_id").cast("string")))
    return _pages(spark, sf_dir).select(
        "page_id", urls.url_domain(u).alias("domain"), urls.source_label(u).alias("label"), urls.source_link_text(title, u).alias("link_text")
    )


@query("SELECT min(page_id) page_id, regexp_extract(url, '://([^/]*)', 1) host FROM pages GROUP BY 2")
def url_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]*)", 1).alias("host"))
    return tables.dedupe_first(rows, ["host"], ["page_id"])


@query("""SELECT doc_id, array_to_string([CASE trim(x) WHEN 'dataset_wikipedia_en' THEN 'Dataset Wikipedia (EN)' WHEN 'online_wikinews' THEN 'Online Wikinews' ELSE trim(x) END for x in string_split('dataset_wikipedia_en, ' || source || ',online_wikinews', ',')], '; ') shown FROM documents""")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pref = F.concat(F.lit("dataset_wikipedia_en, "), "source", F.lit(",online_wikinews"))
    return a.read(spark, sf_dir, "documents").select("doc_id", F.array_join(urls.source_display_names(pref), "; ").alias("shown"))


_RAW = f"raw AS (SELECT id, source_document_id, event_type || ' ' || (id % 40) description, event_date_str FROM ({a.EVENT_SQL}))"


@query(f"""WITH {_RAW} SELECT min(id) id, sha256(source_document_id || '-' || description || '-' || event_date_str) deduplication_signature FROM raw GROUP BY 2""")
def event_signature_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = a.events(spark, sf_dir)
    raw = own.select("id", "source_document_id", F.concat("event_type", F.lit(" "), (F.col("id") % 40).cast("string")).alias("description"), "event_date_str")
    return timeline.dedupe_by_signature(raw, "id").select("id", "deduplication_signature")


@query(f"""WITH base AS ({a.EVENT_SQL}) SELECT id, array_to_string([x for x in [description, 'Date: ' || nullif(event_date_str, ''), 'Entities: u' || (user_id % 50) || ' (' || event_type || ')', 'Context: ' || substring(repeat(description, 9), 1, 200)] if x IS NOT NULL], ' | ') embedding_text,
 substring(md5(description), 1, 8) short_hash FROM base""")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    made = text.embedding_text(c("description"), c("event_date_str"), c("entities"), F.repeat(c("description"), F.lit(9)))
    return a.events(spark, sf_dir).select("id", made.alias("embedding_text"), text.short_hash(c("description")).alias("short_hash"))


def _entity_world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Requests, documents, pages and entities made from customers."""
    c = a.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name, lang = F.col("c_name"), F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "fr")]), (k % 3).cast("int") + 1)
    requests = c.select(name.alias("name"), lang.alias("language"), F.when(k % 2 == 0, "PERSON").otherwise("PLACE").alias("entity_type"))
    documents = c.filter(k % 5 == 0).select(name.alias("title"), lang.alias("language"), F.concat(F.lit("x"), k.cast("string")).alias("entity_id"))
    pages = c.filter(k % 7 != 0).select(
        name.alias("title"), lang.alias("language"), F.concat(F.lit("Q"), (k - k % 2).cast("string")).alias("kb_id"), (k % 11 == 0).alias("is_disambiguation")
    )
    kind = F.when(k % 4 == 0, entities.UNKNOWN).otherwise("ORG").alias("entity_type")
    known = c.filter(k % 3 == 0).select(F.concat(F.lit("x"), k.cast("string")).alias("id"), name.alias("entity_name"), kind, F.concat(F.lit("Q"), k.cast("string")).alias("wikibase_item"))
    return requests, documents, pages, known


_WORLD = """
WITH c AS (SELECT c_custkey k, c_name name, ['en', 'de', 'fr'][cast(c_custkey % 3 + 1 AS int)] lang, CASE WHEN c_custkey % 2 = 0 THEN 'PERSON' ELSE 'PLACE' END et FROM customer),
known AS (SELECT 'x' || k id, CASE WHEN k % 4 = 0 THEN 'UNKNOWN' ELSE 'ORG' END kt, 'Q' || k kb FROM c WHERE k % 3 = 0),
found AS (SELECT c.*, CASE WHEN k % 5 = 0 THEN 'x' || k END by_title, CASE WHEN k % 7 <> 0 THEN 'Q' || (k - k % 2) END kb, k % 7 <> 0 AND k % 11 = 0 dis FROM c),
stat AS (SELECT f.*, n.id kb_entity, CASE WHEN by_title IS NOT NULL THEN 200 WHEN dis THEN 300 WHEN n.id IS NOT NULL THEN 202 WHEN f.kb IS NOT NULL THEN 201 ELSE 500 END status FROM found f LEFT JOIN known n ON n.kb = f.kb),
done AS (SELECT *, CASE status WHEN 200 THEN by_title WHEN 202 THEN kb_entity WHEN 201 THEN sha256('entity-' || kb) END entity_id FROM stat)
"""


@query(f"""{_WORLD} SELECT d.name, d.lang AS language, d.entity_id, d.status, coalesce(CASE WHEN n.kt <> 'UNKNOWN' THEN n.kt END, d.et) resolved_type FROM done d LEFT JOIN known n ON n.id = d.entity_id""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, documents, pages, known = _entity_world(spark, sf_dir)
    return entities.resolve_entities(requests, documents, pages, known).select("name", "language", "entity_id", "status", "resolved_type")


@query(f"{_WORLD} SELECT DISTINCT kb AS kb_id FROM found WHERE kb IS NOT NULL AND kb NOT IN (SELECT kb FROM known)")
def entity_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, pages, known = _entity_world(spark, sf_dir)
    return entities.unknown_kb_ids(pages, known)


@query(f"""{_WORLD}, first AS (SELECT kb, min(k) k FROM found WHERE kb IS NOT NULL GROUP BY 1)
SELECT f.kb AS wikibase_item, c.name AS entity_name, c.et AS entity_type, sha256('entity-' || f.kb) id FROM first f JOIN c USING (k) WHERE f.kb NOT IN (SELECT kb FROM known)""")
def new_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, known = _entity_world(spark, sf_dir)
    k = F.col("c_custkey")
    candidates = a.read(spark, sf_dir, "customer").filter(k % 7 != 0).select(
        F.col("c_name").alias("name"), F.when(k % 2 == 0, "PERSON").otherwise("PLACE").alias("entity_type"), F.concat(F.lit("Q"), (k - k % 2).cast("string")).alias("kb_id"),
        F.concat(F.lit("u"), k.cast("string")).alias("url"), F.lit("web").alias("source_type"), k.alias("seq"),
    )
    documents = candidates.filter("seq % 2 = 0").select(F.col("url").alias("wikipedia_url"), "source_type")
    return entities.get_or_create_entities(candidates, known, documents)[1].select("wikibase_item", "entity_name", "entity_type", "id")


@query(f"""{_WORLD}, e AS (SELECT event_id, list_distinct(['Customer#' || lpad(cast(user_id AS varchar), 9, '0'), 'Customer#' || lpad(cast(user_id + 3 AS varchar), 9, '0')]) names, ['en', 'de', 'fr'][cast(user_id % 3 + 1 AS int)] lang FROM events),
l AS (SELECT event_id, unnest(names) nm, lang FROM e)
SELECT e.event_id, coalesce((SELECT string_agg(entity_id, ',' ORDER BY entity_id) FROM (SELECT DISTINCT entity_id FROM l JOIN done d ON d.name = l.nm AND d.lang = l.lang WHERE l.event_id = e.event_id AND entity_id IS NOT NULL)), '') entity_ids FROM e""")
def link_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, documents, pages, known = _entity_world(spark, sf_dir)
    resolved = entities.resolve_entities(requests, documents, pages, known)
    name = lambda n: F.struct(F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") + n).cast("string"), 9, "0")).alias("name"), F.lit("PERSON").alias("type"))
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "fr")]), (F.col("user_id") % 3).cast("int") + 1)
    rows = a.read(spark, sf_dir, "events").select("event_id", lang.alias("language"), F.array(name(0), name(3)).alias("entities"))
    return entities.link_entities(rows, resolved).select("event_id", F.array_join("entity_ids", ",").alias("entity_ids"))


@query("""SELECT DISTINCT cast(l_orderkey AS varchar) viewpoint_id, cast(l_partkey AS varchar) event_id FROM lineitem WHERE l_linenumber > 2
EXCEPT SELECT cast(l_orderkey AS varchar), cast(l_partkey AS varchar) FROM lineitem WHERE l_linenumber <= 2""")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = a.viewpoint_links(spark, sf_dir)
    return tables.insert_ignore(links.filter("sequence_order <= 2"), links.filter("sequence_order > 2"), ["viewpoint_id", "event_id"]).select("viewpoint_id", "event_id")


@query("""SELECT o_orderkey id, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE o_orderstatus END status FROM orders WHERE o_orderkey % 10 <> 1""")
def apply_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    changed = tables.apply_updates(rows, rows.filter("id % 3 = 0").select("id", F.lit("done").alias("status")))
    return tables.delete_by_key(changed, rows.filter("id % 10 = 1"))


@query("""WITH d AS (SELECT doc_id, 'u' || (doc_id % 700) u, source, lang FROM documents), known AS (SELECT min('k' || doc_id) id, u, source FROM d WHERE doc_id % 3 = 0 GROUP BY 2, 3),
by_title AS (SELECT min('k' || doc_id) id, 't' || (doc_id % 50) t, lang, source FROM d WHERE doc_id % 3 = 0 GROUP BY 2, 3, 4)
SELECT d.doc_id, coalesce(k.id, b.id, sha256(d.u || chr(0) || d.source || chr(0) || 't' || (d.doc_id % 50) || chr(0) || d.lang)) document_id, coalesce(k.id, b.id) IS NULL is_new
FROM d LEFT JOIN known k ON k.u = d.u AND k.source = d.source LEFT JOIN by_title b ON b.t = 't' || (d.doc_id % 50) AND b.lang = d.lang AND b.source = d.source""")
def get_or_create_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = a.read(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("u"), (d % 700).cast("string")).alias("wikipedia_url"), F.col("source").alias("source_type"),
        F.concat(F.lit("t"), (d % 50).cast("string")).alias("title"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("entity_id"), F.col("text").alias("text_content"),
    )
    known = rows.filter("doc_id % 3 = 0").withColumn("id", F.concat(F.lit("k"), d.cast("string")))
    return corpus.get_or_create_documents(rows, known).select("doc_id", "document_id", "is_new")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'link_not_found' WHEN doc_id % 3 = 0 THEN 'text_extraction_failed' ELSE 'success' END overall_status FROM documents""")
def crosslingual_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, d = a.read(spark, sf_dir, "documents"), F.col("doc_id")
    asked = docs.select("doc_id", d.cast("string").alias("title"), F.lit("en").alias("language"), F.lit("de").alias("target_language"))
    links = asked.filter("doc_id % 4 <> 0").select("title", "language", "target_language", F.concat(F.lit("de-"), "title").alias("target_title"))
    texts = docs.select(F.concat(F.lit("de-"), d.cast("string")).alias("title"), F.lit("de").alias("language"), F.when(d % 3 == 0, " ").otherwise("text").alias("text_content"))
    found = corpus.crosslingual_articles(asked.drop("doc_id"), links, texts)
    return found.select(F.col("title").cast("long").alias("doc_id"), "overall_status")


@query("""SELECT page_id, 'https://en.wikipedia.org/wiki?curid=' || CASE WHEN page_id % 5 = 0 AND page_id > 0 THEN page_id - 1 ELSE page_id END url, page_id % 5 = 0 AND page_id > 0 is_redirect FROM pages""")
def lookup_page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth page redirects to the one before it."""
    p = F.col("page_id")
    rows = a.read(spark, sf_dir, "pages").select("page_id")
    info = rows.select(
        p.cast("string").alias("title"), F.lit("en").alias("language"), "page_id", F.concat(F.lit("https://en.wikipedia.org/wiki/"), p.cast("string")).alias("url"),
        F.lit("Q1").alias("kb_id"), F.lit(False).alias("is_disambiguation"), F.lit("").alias("extract"),
        F.when((p % 5 == 0) & (p > 0), (p - 1).cast("string")).alias("redirect_to"),
    )
    found = corpus.lookup_page_info(info.select("title", "language"), info)
    return found.select(F.col("title").cast("long").alias("page_id"), "url", "is_redirect")


@query("""WITH r AS (SELECT 0 s, doc_id, 'u' || (doc_id % 300) u FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 1, doc_id, 'u' || (doc_id % 300) FROM documents WHERE doc_id % 3 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY s, cast(doc_id AS varchar)) k FROM r) SELECT CASE s WHEN 0 THEN 'even' ELSE 'third' END source_name, u AS source_url, cast(doc_id AS varchar) source_identifier FROM f WHERE k = 1""")
def acquire_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = a.read(spark, sf_dir, "documents")

    def source(name: str, step: int):
        url = F.concat(F.lit("u"), (F.col("doc_id") % 300).cast("string")).alias("source_url")
        return lambda rows: rows.filter(F.col("doc_id") % step == 0).select(F.lit(name).alias("source_name"), url, F.col("doc_id").cast("string").alias("source_identifier"))

    return corpus.acquire_articles(docs, ["even", "missing", "third"], {"even": source("even", 2), "third": source("third", 3)})


@query("""SELECT 'even' AS source, 'ok' state, count(*) FILTER (doc_id % 2 = 0) n_articles FROM documents UNION ALL SELECT 'broken', 'failed', 0
UNION ALL SELECT 'missing', 'unknown', 0 UNION ALL SELECT 'all', 'ok', count(*) FROM documents""")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources over all documents, of which one raises an error in its tasks and one isn't known."""
    docs = a.read(spark, sf_dir, "documents")
    url, key = F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("source_url"), F.col("doc_id").cast("string").alias("source_identifier")
    broken = lambda rows: rows.select(url, F.raise_error(F.lit("no answer")).cast("string").alias("source_identifier"))
    sources = {"even": lambda rows: rows.filter("doc_id % 2 = 0").select(url, key), "broken": broken, "all": lambda rows: rows.select(url, key)}
    return corpus.acquire_with_status(docs, ["even", "broken", "missing", "all"], sources)[1].drop("error")


@query("""SELECT page_id, page_id % 3 = 0 is_disambiguation, CASE WHEN page_id % 3 = 0 THEN list_filter([trim(split_part(url, ',', 1)), 'Page ' || page_id], lambda x: x <> '' AND length(x) < 100) END options FROM pages""")
def disambiguation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page lists its url and a title as what may be meant, among lines that aren't options."""
    p = F.col("page_id").cast("string")
    extract = F.concat(F.lit("May mean:\n* "), F.coalesce("url", F.lit("")), F.lit(", the page\n no option\n** Page "), p, F.lit(" – a page"))
    info = a.read(spark, sf_dir, "pages").select(
        p.alias("title"), F.lit("en").alias("language"), "page_id", "url", F.lit("Q1").alias("kb_id"), (F.col("page_id") % 3 == 0).alias("is_disambiguation"),
        extract.alias("extract"), F.lit(None).cast("string").alias("redirect_to"),
    )
    return corpus.lookup_page_info(info.select("title", "language"), info).select("page_id", "is_disambiguation", "options")


@query(f"{_T} SELECT id, created_at FROM tasks WHERE status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 30")
def recent_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty tasks that were completed last."""
    return tasks.recent_completed(a.tasks(spark, sf_dir), 30).select("id", "created_at")


@query(f"WITH base AS ({a.EVENT_SQL}) SELECT id, event_date_str FROM base JOIN embeddings ON vec_id = id WHERE trim(event_date_str) <> '' AND embedding IS NOT NULL")
def timeline_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that have a date string and a vector."""
    vectors = a.vectors(spark, sf_dir).select("id", F.col("vector").alias("description_vector"))
    own = a.events(spark, sf_dir).join(vectors.hint("merge"), "id", "left")
    return tasks.check_timeline_inputs(own, 64).select("id", "event_date_str")


@query("SELECT event_id raw_event_id, cast(user_id AS varchar) entity_id, c_name entity_name FROM events JOIN customer ON c_custkey = user_id")
def raw_event_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of events as entities, where a customer of that number exists."""
    links = a.read(spark, sf_dir, "events").select(F.col("event_id").alias("raw_event_id"), F.col("user_id").cast("string").alias("entity_id"))
    known = a.users(spark, sf_dir).withColumnRenamed("username", "entity_name")
    return entities.raw_event_entities(links, known).select("raw_event_id", "entity_id", "entity_name")


@query(f"""WITH base AS ({a.EVENT_SQL}), s AS (SELECT id, event_date_str, description, CASE WHEN id % 6 = 0 THEN ' ' WHEN id % 7 = 0 THEN NULL ELSE 'said' END snippet FROM base)
SELECT id, coalesce(trim(event_date_str) <> '' AND trim(description) <> '' AND trim(snippet) <> '', false) is_valid FROM s""")
def raw_event_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which raw events have a date string, a description and a snippet."""
    snippet = F.when(F.col("id") % 6 == 0, " ").when(F.col("id") % 7 != 0, "said")
    valid, rejected = corpus.valid_raw_events(a.events(spark, sf_dir).withColumn("snippet", snippet))
    mark = lambda df, ok: df.select("id", F.lit(ok).alias("is_valid"))
    return mark(valid, True).union(mark(rejected, False))
