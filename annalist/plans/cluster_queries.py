"""Queries of pairs, neighbours and clusters.

The vectors of the test tables are far apart, so thresholds are lower than in production.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import scores
from annalist.functions.dates import ranges_overlap
from annalist.functions.scores import match_score, pair_key, quick_exclude, relevance_band
from annalist.operators import canonical, cluster, pairs, scoring, timeline
from annalist.plans.adapters import RANGE_SQL, SIDE_SQL, events, vectors
from annalist.plans.registry import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

THRESHOLD, HIGH = 0.30, 0.40

_VECTORS = """
v AS MATERIALIZED (SELECT vec_id id, embedding::DOUBLE[] vec FROM embeddings),
sims AS MATERIALIZED (SELECT a.id a, b.id b, list_cosine_similarity(a.vec, b.vec) similarity FROM v a JOIN v b ON a.id < b.id
  WHERE list_cosine_similarity(a.vec, b.vec) >= 0.3)
"""


@query(f"WITH {_VECTORS} SELECT a, b, round(similarity, 8) similarity FROM sims")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.similar_pairs(vectors(spark, sf_dir), THRESHOLD)
    return found.select("a", "b", F.round("similarity", 8).alias("similarity"))


@query()
def cosine_pairs_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.similar_pairs(vectors(spark, sf_dir), THRESHOLD, "lsh")
    return found.select("a", "b", F.round("similarity", 8).alias("similarity"))


@query("""WITH v AS MATERIALIZED (SELECT vec_id id, embedding::DOUBLE[] vec FROM embeddings),
s AS (SELECT q.id query_id, v.id, list_cosine_similarity(q.vec, v.vec) similarity FROM v q JOIN v ON q.id % 50 = 0 AND v.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) rank FROM s WHERE similarity > 0.2)
SELECT query_id, id, round(similarity, 8) similarity, cast(rank AS int) rank FROM r WHERE rank <= 5""")
def nearest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 as a query against all others, other queries included."""
    own = vectors(spark, sf_dir)
    asked = own.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    found = pairs.nearest_events(asked, own.select("id", "vector"), 6, 0.2).filter("id <> query_id")  # one more, as a query may find itself
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("rank", place).filter("rank <= 5").select("query_id", "id", F.round("similarity", 8).alias("similarity"), "rank")


_LEADERS = f"""
WITH RECURSIVE {_VECTORS},
near AS MATERIALIZED (SELECT id, (SELECT list(a) FROM sims WHERE b = v.id) before, row_number() OVER (ORDER BY id) n FROM v),
walk AS (SELECT 0::BIGINT n, []::BIGINT[] leaders UNION ALL
  SELECT w.n + 1, CASE WHEN k.before IS NOT NULL AND list_has_any(w.leaders, k.before) THEN w.leaders ELSE list_append(w.leaders, k.id) END
  FROM walk w JOIN near k ON k.n = w.n + 1),
lead AS MATERIALIZED (SELECT unnest(leaders) leader FROM walk WHERE n = (SELECT max(n) FROM walk)),
grouped AS MATERIALIZED (SELECT v.id, coalesce((SELECT min(leader) FROM lead WHERE leader = v.id), (SELECT min(s.a) FROM sims s JOIN lead l ON l.leader = s.a WHERE s.b = v.id)) leader FROM v)
"""


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = vectors(spark, sf_dir)
    return own, cluster.vector_leaders(own, THRESHOLD)


@query(f"{_LEADERS} SELECT id, leader FROM grouped")
def leader_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)[1]


@query(f"""{_LEADERS}, n AS (SELECT leader, count(*) n FROM grouped GROUP BY 1),
sure AS MATERIALIZED (SELECT id, (SELECT list(a) FROM sims WHERE b = v.id AND similarity >= {HIGH}) before, row_number() OVER (ORDER BY id) n FROM v),
sure_walk AS (SELECT 0::BIGINT n, []::BIGINT[] leaders UNION ALL
  SELECT w.n + 1, CASE WHEN k.before IS NOT NULL AND list_has_any(w.leaders, k.before) THEN w.leaders ELSE list_append(w.leaders, k.id) END
  FROM sure_walk w JOIN sure k ON k.n = w.n + 1),
sure_lead AS MATERIALIZED (SELECT unnest(leaders) leader FROM sure_walk WHERE n = (SELECT max(n) FROM sure_walk)),
sure_grouped AS MATERIALIZED (SELECT v.id, coalesce((SELECT min(leader) FROM sure_lead WHERE leader = v.id),
  (SELECT min(s.a) FROM sims s JOIN sure_lead l ON l.leader = s.a WHERE s.b = v.id AND s.similarity >= {HIGH})) leader FROM v),
uncertain AS (SELECT s.a, s.b FROM sims s JOIN sure_lead l ON l.leader = s.a JOIN sure_grouped g ON g.id = s.b WHERE s.similarity < {HIGH} AND g.leader > s.a)
SELECT cast(sum(n) AS bigint) n_events, count(*) n_groups, count(*) FILTER (n > 1) n_merged, (SELECT count(*) FROM uncertain) n_uncertain FROM n""")
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clusters, and the pairs that the hybrid form would have a verifier judge: those of a leader of the sure groups."""
    own, groups = _groups(spark, sf_dir)
    return cluster.merge_stats(groups, cluster.vector_uncertain(own, HIGH, THRESHOLD)[1].count())


_ITEMS = "items AS (SELECT vec_id id, vec_id rank, 'event ' || repeat('x', cast(vec_id % 90 AS int)) description, cast(vec_id % 4 AS int) n_entities FROM embeddings)"


def _items(own: DataFrame) -> DataFrame:
    text = F.concat(F.lit("event "), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")))
    return own.select("id", "rank", text.alias("description"), (F.col("id") % 4).cast("int").alias("n_entities"))


@query(f"""{_LEADERS}, {_ITEMS},
inside AS (SELECT g.id, sum(s.similarity) total FROM grouped g JOIN grouped h ON g.leader = h.leader AND g.id <> h.id
  JOIN sims s ON s.a = least(g.id, h.id) AND s.b = greatest(g.id, h.id) GROUP BY 1),
n AS (SELECT leader, count(*) n FROM grouped GROUP BY 1),
scored AS (SELECT g.leader, g.id, round(CASE WHEN n = 1 THEN 1.0 ELSE coalesce(total, 0) / greatest(n - 1, 1) END + least(length(description) / 1000, 0.1) + least(n_entities / 10, 0.05), 9) score
  FROM grouped g JOIN n USING (leader) LEFT JOIN inside USING (id) JOIN items USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY score DESC, id) k FROM scored)
SELECT leader, id representative, round(score, 6) score FROM r WHERE k = 1""")
def representative_by_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, groups = _groups(spark, sf_dir)
    total = pairs.similarities_inside(groups.join(own.select("id", "vector").hint("merge"), "id"), THRESHOLD)
    best = timeline.representative_by_similarity(groups, None, _items(own), total)
    return best.select("leader", "representative", F.round("score", 6).alias("score"))


def _verifier(spark: SparkSession, sf_dir: str):
    """Confirms pairs whose labels are equal: stands for stored answers of a model."""
    label = vectors(spark, sf_dir).select("id", "label")

    def verify(found: DataFrame) -> DataFrame:
        x, y = label.select(F.col("id").alias("a"), F.col("label").alias("la")), label.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        return found.join(x.hint("merge"), "a").join(y.hint("merge"), "b").filter("la = lb").select("a", "b")

    return verify


@query()
def hybrid_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.vector_hybrid(vectors(spark, sf_dir), _verifier(spark, sf_dir), HIGH, THRESHOLD)


@query()
def rule_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.rule_cluster(events(spark, sf_dir))


@query()
def canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd vectors enter a store of the even ones."""
    own = vectors(spark, sf_dir).withColumn("document_id", (F.col("id") % 20).cast("string"))
    store = own.filter("id % 2 = 0").select(F.col("id").alias("event_id"), "vector", F.array("document_id").alias("document_ids"))
    return canonical.canonicalise(own.filter("id % 2 = 1").select("id", "rank", "vector", "document_id"), store, THRESHOLD, 0.35, 0.45)


_ENTITY_PAIRS = f"""
WITH {SIDE_SQL}, keyed AS (SELECT id, unnest(entity_ids) k FROM sides),
pair AS (SELECT DISTINCT x.id a, y.id b FROM keyed x JOIN keyed y ON x.k = y.k AND x.id < y.id),
full_pair AS (SELECT p.a, p.b, x.entity_ids xe, y.entity_ids ye, x.entity_types xt, y.entity_types yt, x.year xy, y.year yy, x.language xl, y.language yl,
  x.description xd, y.description yd, x.start_date xs, x.end_date xn, y.start_date ys, y.end_date yn FROM pair p JOIN sides x ON x.id = p.a JOIN sides y ON y.id = p.b)
"""


def _entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.block_candidates(events(spark, sf_dir), ("entity",), sides=scores.SIDE)


@query(f"""WITH {SIDE_SQL}, keyed AS (SELECT id, unnest(entity_ids) k FROM sides)
SELECT x.id a, y.id b FROM keyed x JOIN keyed y ON x.k = y.k AND x.id < y.id UNION SELECT x.id, y.id FROM sides x JOIN sides y ON x.event_type = y.event_type AND x.id < y.id
UNION SELECT x.id, y.id FROM sides x JOIN sides y ON x.year BETWEEN y.year - 1 AND y.year + 1 AND x.id < y.id""")
def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that share an entity or a type, or lie within a year: as many as the data have, in the square of the events."""
    return pairs.block_candidates(events(spark, sf_dir))


@query(f"""WITH {SIDE_SQL} SELECT x.id a, y.id b FROM sides x JOIN sides y ON x.year BETWEEN y.year - 1 AND y.year + 1 AND x.id < y.id""")
def block_candidates_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.block_candidates(events(spark, sf_dir), ("year",))


@query(f"""WITH {SIDE_SQL}, pair AS (SELECT x.id a, y.id b, abs(x.year - y.year) apart, x.entity_ids xe, y.entity_ids ye, x.entity_types xt, y.entity_types yt FROM sides x JOIN sides y ON x.id < y.id
  AND (x.event_type = y.event_type OR x.year BETWEEN y.year - 1 AND y.year + 1))
SELECT a, b FROM pair WHERE 10 * len(list_intersect(xe, ye)) + 5 * len(list_intersect(xt, yt)) + CASE apart WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 0 END + 20 >= 55""")
def block_candidates_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by type or year whose score can still reach 55."""
    return pairs.block_candidates(events(spark, sf_dir), ("type", "year"), 55)


@query(f"WITH {RANGE_SQL} SELECT x.id a, y.id b FROM dated x JOIN dated y ON x.id < y.id AND x.start_date <= y.end_date AND y.start_date <= x.end_date")
def date_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of events whose dates overlap, whatever they are about."""
    return pairs.overlaps(events(spark, sf_dir))


@query(f"""{_ENTITY_PAIRS} SELECT a, b, cast(10 * len(list_intersect(xe, ye)) + 5 * len(list_intersect(xt, yt))
  + CASE abs(xy - yy) WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 0 END + CASE WHEN xl IS NOT DISTINCT FROM yl THEN 10 ELSE 0 END
  + CASE WHEN xd = yd THEN 10 ELSE 0 END AS int) score, a || '|' || b pair_key FROM full_pair""")
def match_score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _entity_pairs(spark, sf_dir)
    return both.select("a", "b", match_score(F.col("x"), F.col("y")).cast("int").alias("score"), pair_key(F.col("b"), F.col("a")).alias("pair_key"))


@query(f"""{_ENTITY_PAIRS} SELECT a, b, round(len(list_intersect(xe, ye)) / 2, 6) overlap FROM full_pair WHERE len(list_intersect(xe, ye)) / 2 >= 0.75
  AND CASE WHEN xs IS NOT NULL AND ys IS NOT NULL THEN greatest(xs, ys) <= least(xn, yn) ELSE xs IS NULL AND ys IS NULL END""")
def rule_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.rule_pairs(events(spark, sf_dir)).select("a", "b", F.round("overlap", 6).alias("overlap"))


@query(f"""{_ENTITY_PAIRS} SELECT a, b FROM full_pair WHERE coalesce(abs(xy - yy) > 2, false)
  OR (len(list_intersect(xe, ye)) = 0 AND len(list_intersect(xt, yt)) = 0) OR greatest(length(xd), length(yd)) > 5 * least(length(xd), length(yd))""")
def quick_exclude_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity_pairs(spark, sf_dir).filter(quick_exclude(F.col("x"), F.col("y"))).select("a", "b")


@query(f"{_ENTITY_PAIRS} SELECT a, b FROM full_pair WHERE greatest(xs, ys) <= least(xn, yn)")
def date_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairs.block_candidates(events(spark, sf_dir), ("entity",), sides=("date_range",))
    return both.filter(ranges_overlap(F.col("x.date_range"), F.col("y.date_range"))).select("a", "b")


def _user_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = events(spark, sf_dir)
    return own, own.select("id", F.floor(F.col("id") / 4).alias("leader"))


_QUALITY = f"""
WITH {RANGE_SQL},
scored AS (SELECT *, id // 4 leader, round(CASE WHEN language = 'de' THEN 100 WHEN language = 'en' THEN 50 ELSE 0 END + length(description) * 0.1
  + CASE WHEN start_date IS NULL THEN 0 WHEN precision = 'day' THEN 30 WHEN precision = 'month' THEN 20 WHEN precision = 'year' THEN 10 ELSE 0 END, 6) quality FROM dated),
ranked AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY quality DESC, id) k FROM scored),
firsts AS (SELECT leader, arg_min(start_year, id) FILTER (start_date IS NOT NULL) any_year, arg_min(year(start_date), id) FILTER (start_date IS NOT NULL) any_first,
  arg_min(event_date_str, id) FILTER (event_date_str <> '') any_text FROM scored GROUP BY 1),
best AS (SELECT r.leader, r.id representative, r.quality score, CASE WHEN r.start_date IS NULL AND any_first IS NOT NULL THEN any_year ELSE r.start_year END start_year,
  coalesce(nullif(r.event_date_str, ''), CASE WHEN coalesce(year(r.start_date), any_first) IS NOT NULL
    THEN coalesce(any_text, cast(coalesce(year(r.start_date), any_first) AS varchar)) END) event_date_str
  FROM ranked r JOIN firsts USING (leader) WHERE k = 1)
"""


@query(f"{_QUALITY} SELECT leader, representative, start_year, event_date_str, score FROM best")
def representative_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, groups = _user_groups(spark, sf_dir)
    best = timeline.representative_by_quality(groups, own, "de")
    return best.select("leader", "representative", "date_info.start_year", "event_date_str", "score")


@query(f"""{_QUALITY}, member AS (SELECT id, id // 4 leader, event_date_str, user_id, score AS relevance FROM dated),
together AS (SELECT leader, count(*) n_events, max(relevance) relevance_score, list_sort(list(DISTINCT 'e' || user_id)) users, arg_min(event_date_str, id) FILTER (event_date_str <> '') any_text FROM member GROUP BY 1)
SELECT t.leader, b.representative, d.description, CASE WHEN n_events > 1 THEN coalesce(nullif(d.event_date_str, ''), any_text, cast(year(d.start_date) AS varchar), 'Unknown') ELSE d.event_date_str END event_date_str,
  n_events > 1 is_merged, n_events, relevance_score, users FROM together t JOIN best b USING (leader) JOIN dated d ON d.id = b.representative""")
def assemble_merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, groups = _user_groups(spark, sf_dir)
    own = own.withColumn("raw_event_ids", F.array("id")).withColumn("entity_ids", F.array(F.concat(F.lit("e"), F.col("user_id").cast("string"))))
    merged = timeline.assemble_merged_events(groups, timeline.representative_by_quality(groups, own, "de"), own, own.select("id", "score"))
    return merged.select(
        "leader", "representative", "description", "event_date_str", "is_merged", "n_events", "relevance_score", F.col("entity_ids").alias("users")
    )


@query("""SELECT event_id id, CASE WHEN v >= 0.75 THEN 'high' WHEN v >= 0.5 THEN 'medium' ELSE 'low' END band
FROM (SELECT event_id, floor(value) / 100.0 v FROM events)""")
def relevance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.floor("value") / 100.0).alias("v"))
    return rows.select(F.col("event_id").alias("id"), relevance_band(F.col("v")).alias("band"))


@query("""WITH w AS (SELECT user_id % 20 topic_id, event_id, list_distinct([x for x in regexp_split_to_array(lower(event_type || ' ' || props), '[^\\p{L}\\p{N}]+') if x <> '']) own,
  list_distinct(['click', 'k', cast(user_id % 20 AS varchar)]) wanted FROM events)
SELECT topic_id, event_id item_id, round(len(list_intersect(own, wanted)) / len(wanted), 6) score FROM w""")
def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    items = rows.select((F.col("user_id") % 20).alias("topic_id"), F.col("event_id").alias("item_id"), F.concat_ws(" ", "event_type", "props").alias("text"))
    topics = items.select("topic_id").distinct().withColumn("topic_text", F.concat(F.lit("click k "), F.col("topic_id").cast("string")))
    return scoring.lexical_scores(items, topics).select("topic_id", "item_id", F.round("score", 6).alias("score"))


def _tfidf_sql(items: str, topics: str) -> str:
    """The cosine of each (topic_id, item_id, text) and its (topic_id, topic_text), for the other engine."""
    split = "unnest([x for x in regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+') if x <> ''])"
    return f"""WITH items AS ({items}), topics AS ({topics}),
tf AS (SELECT topic_id, item_id, term, count(*) tf FROM (SELECT topic_id, item_id, {split.format("text")} term FROM items SEMI JOIN topics USING (topic_id)) GROUP BY ALL),
df AS (SELECT term, count(*) df FROM tf GROUP BY 1),
size AS (SELECT count(*) n FROM (SELECT DISTINCT topic_id, item_id FROM items SEMI JOIN topics USING (topic_id))),
asked AS (SELECT topic_id, term, count(*) tf FROM (SELECT topic_id, {split.format("topic_text")} term FROM topics) GROUP BY ALL),
t AS (SELECT topic_id, term, tf * (1 + ln((1.0 + n) / (1 + coalesce(df, 0)))) w FROM asked LEFT JOIN df USING (term), size),
i AS (SELECT topic_id, item_id, term, tf * (1 + ln((1.0 + n) / (1 + df))) w FROM tf JOIN df USING (term), size),
length_t AS (SELECT topic_id, sqrt(sum(w * w)) lt FROM t GROUP BY 1),
length_i AS (SELECT topic_id, item_id, sqrt(sum(w * w)) li FROM i GROUP BY 1, 2),
dot AS (SELECT i.topic_id, i.item_id, sum(i.w * t.w) d FROM i JOIN t USING (topic_id, term) GROUP BY 1, 2)
SELECT topic_id, item_id, round(coalesce(d / (lt * li), 0), 9) score FROM (SELECT DISTINCT topic_id, item_id FROM items SEMI JOIN topics USING (topic_id))
 LEFT JOIN length_t USING (topic_id) LEFT JOIN length_i USING (topic_id, item_id) LEFT JOIN dot USING (topic_id, item_id)"""


@query(_tfidf_sql(
    "SELECT user_id % 20 topic_id, event_id item_id, event_type || ' ' || props AS text FROM events",
    "SELECT DISTINCT user_id % 20 topic_id, 'click k ' || (user_id % 20) topic_text FROM events",
))
def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event against its topic, by TF-IDF."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    items = rows.select((F.col("user_id") % 20).alias("topic_id"), F.col("event_id").alias("item_id"), F.concat_ws(" ", "event_type", "props").alias("text"))
    topics = items.select("topic_id").distinct().withColumn("topic_text", F.concat(F.lit("click k "), F.col("topic_id").cast("string")))
    return scoring.tfidf_scores(items, topics)


@query(_tfidf_sql(
    "SELECT doc_id % 20 topic_id, doc_id item_id, text FROM documents",
    "SELECT item_id % 20 topic_id, string_agg(text, ' ') topic_text FROM benchmark GROUP BY 1",
))
def article_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against a topic of benchmark texts, by TF-IDF."""
    items = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 20).alias("topic_id"), F.col("doc_id").alias("item_id"), "text")
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").groupBy((F.col("item_id") % 20).alias("topic_id"))
    topics = texts.agg(F.array_join(F.collect_list("text"), " ").alias("topic_text"))
    return scoring.tfidf_scores(items, topics)


@query("""SELECT DISTINCT event_type topic, props AS text, CASE WHEN length(props) % 3 <> 0 THEN (length(props) - length(replace(props, '1', '')))::DOUBLE / length(props) END score
FROM events""")
def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch scorer over distinct texts, which fails for some rows: those have no score, the others of their batch do."""

    def scorer(rows):
        if (rows["text"].str.len() % 3 == 0).any():
            raise ValueError("a text that can't be scored")
        return rows["text"].str.count("1") / rows["text"].str.len()

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("topic"), F.col("props").alias("text"))
    return scoring.score_rows(rows, ["topic", "text"], scorer)


@query()
def encode_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all benchmark texts and document texts."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scoring.encode_texts(rows, "text").select("doc_id", "vector")
