"""Queries of retrieval and of corpus jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.operators import search, timeline
from annalist.plans.adapters import CHUNK_SQL, QUERY_SQL, chunk_texts, chunks, queries, read
from annalist.plans.registry import Registry
from annalist.sources import corpus

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_BM25 = f"""
WITH {CHUNK_SQL}, {QUERY_SQL},
words AS (SELECT chunk_id, [x for x in regexp_split_to_array(lower(coalesce(chunk_text, '')), '[^\\p{{L}}\\p{{N}}]+') if x <> ''] ws FROM chunks),
stat AS (SELECT count(*)::DOUBLE n, sum(len(ws)) / count(*) mean FROM words),
wanted AS (SELECT DISTINCT query_id, unnest([x for x in regexp_split_to_array(lower(query_text), '[^\\p{{L}}\\p{{N}}]+') if x <> '']) term FROM asked),
tf AS (SELECT chunk_id, len, term, count(*) tf FROM (SELECT chunk_id, len(ws) len, unnest(ws) term FROM words) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
df AS (SELECT term, count(*) df FROM tf GROUP BY 1),
scored AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) score
  FROM tf JOIN df USING (term) JOIN wanted USING (term), stat GROUP BY 1, 2),
lexical AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) r FROM scored) WHERE r <= 100)
"""
_NEAR = """
dist AS (SELECT query_id, chunk_id, 1 - list_cosine_similarity(vector, query_vector) distance FROM chunks, asked),
near AS (SELECT query_id, chunk_id, distance, (2 - distance) / 2 similarity, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) r FROM dist) WHERE r <= 100)
"""


@query(f"{_BM25} SELECT query_id, chunk_id, round(score, 6) score FROM scored")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25_scores(chunk_texts(spark, sf_dir), queries(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {CHUNK_SQL}, {QUERY_SQL}, {_NEAR} SELECT query_id, chunk_id, round(distance, 8) distance, round(similarity, 8) similarity, cast(r AS int) rank FROM near")
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.semantic_chunks(chunks(spark, sf_dir), queries(spark, sf_dir), 100, chunk_texts(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("distance", 8).alias("distance"), F.round("similarity", 8).alias("similarity"), "rank")


@query(f"""WITH {CHUNK_SQL}, {QUERY_SQL}, {_NEAR},
best AS (SELECT query_id, doc_id, min(distance) distance FROM near JOIN chunks USING (chunk_id) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) r FROM best),
texts AS (SELECT doc_id, string_agg(chunk_text, '' ORDER BY chunk_index) t FROM chunks GROUP BY 1)
SELECT query_id, doc_id, round(distance, 8) distance, cast(r AS int) rank, md5(t) text_md5 FROM top JOIN texts USING (doc_id) WHERE r <= 10""")
def semantic_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.semantic_articles(chunks(spark, sf_dir), queries(spark, sf_dir), texts=chunk_texts(spark, sf_dir))
    return found.select("query_id", "doc_id", F.round("distance", 8).alias("distance"), "rank", F.md5("text").alias("text_md5"))


@query(f"""{_BM25}, {_NEAR},
fused AS (SELECT query_id, chunk_id, round(0.6 * coalesce(similarity, 0) + 0.4 * coalesce(bm25, 0), 9) fusion FROM near FULL JOIN lexical USING (query_id, chunk_id)),
articles AS (SELECT query_id, doc_id, max(fusion) score, string_agg(chunk_text, '' ORDER BY chunk_index) t FROM fused JOIN chunks USING (chunk_id) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) r FROM articles)
SELECT query_id, doc_id, cast(r AS int) rank, round(score, 6) score, md5(t) text_md5 FROM top WHERE r <= 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hybrid_search(chunks(spark, sf_dir), queries(spark, sf_dir), 10, texts=chunk_texts(spark, sf_dir))
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), F.md5("text").alias("text_md5"))


@query()
def assemble_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = search.semantic_chunks(chunks(spark, sf_dir), queries(spark, sf_dir), 20, chunk_texts(spark, sf_dir))
    return search.assemble_articles(ranked).select("query_id", "doc_id", "position", F.md5("text").alias("text_md5"))


_SPLIT = "[x for x in regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+') if x <> '']"


@query(f"""WITH kw AS (SELECT DISTINCT keyword FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) keyword FROM benchmark) WHERE keyword <> ''),
words AS (SELECT doc_id, {_SPLIT.format("text")} ws FROM documents WHERE trim(source) <> ''),
stat AS (SELECT count(*)::DOUBLE n, sum(len(ws)) / count(*) mean FROM words),
wanted AS (SELECT DISTINCT keyword, unnest({_SPLIT.format("keyword")}) term FROM kw),
tf AS (SELECT doc_id, len, term, count(*) tf FROM (SELECT doc_id, len(ws) len, unnest(ws) term FROM words) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
df AS (SELECT term, count(*) df FROM tf GROUP BY 1),
scored AS (SELECT keyword, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) score
  FROM tf JOIN df USING (term) JOIN wanted USING (term), stat GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, doc_id) r FROM scored)
SELECT keyword, doc_id article_id, cast(r AS int) rank, round(score, 6) score FROM ranked WHERE r <= 3""")
def search_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("title"), F.col("text").alias("text_content"))
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("keyword")).filter("keyword <> ''")
    return search.search_news(words, articles).select("keyword", "article_id", "rank", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT doc_id % 10 topic_id, doc_id item_id, quality * (doc_id % 100) / 100.0 score FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, item_id) rank FROM s JOIN documents d ON d.doc_id = s.item_id WHERE score >= 0.3)
SELECT topic_id, item_id, score, cast(rank AS int) rank FROM r WHERE rank <= 10""")
def filter_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = read(spark, sf_dir, "labels").select(
        (F.col("doc_id") % 10).alias("topic_id"), F.col("doc_id").alias("item_id"), (F.col("quality") * (F.col("doc_id") % 100) / 100.0).alias("score")
    )
    articles = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    return timeline.filter_articles(articles, scores, 0.3, 10).select("topic_id", "item_id", "score", "rank")


@query()
def pages_to_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pages_to_articles(read(spark, sf_dir, "pages"))


_CHUNKS = rf"""
own AS (SELECT doc_id, regexp_replace(text, '{corpus.EDGES}', '', 'g') t FROM documents),
parted AS (SELECT doc_id, t, regexp_extract_all(t, '{corpus.PARAGRAPHS}') p, regexp_extract_all(t, '{corpus.SENTENCES}') s FROM own WHERE length(t) > 3000),
sized AS (SELECT doc_id, t, flatten(list_transform(CASE WHEN len(p) > 1 THEN p ELSE s END, lambda u: list_transform(range(0, (length(u) - 1) // 1800 + 1), lambda k: least(1800, length(u) - k * 1800)))) n FROM parted),
ended AS (SELECT doc_id, t, list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i])) ends FROM sized),
cut AS (SELECT doc_id, t, ends, 0 k, 0::HUGEINT b, list_max(list_filter(ends, lambda x: x <= 2000)) e FROM ended
  UNION ALL SELECT doc_id, t, ends, k + 1, e - 200, list_max(list_filter(ends, lambda x: x <= e - 200 + 2000)) FROM cut WHERE e < length(t)),
chunked AS (SELECT doc_id, 0 chunk_index, t chunk_text FROM own WHERE t <> '' AND length(t) <= 3000
  UNION ALL SELECT doc_id, k, substring(t, cast(b + 1 AS int), cast(e - b AS int)) FROM cut)
"""


@query(f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunked")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk_documents(read(spark, sf_dir, "documents"), 2000, 200, 3000)


@query("""SELECT doc_id, cast(CASE WHEN length(trim(text)) = 0 THEN 0 WHEN length(trim(text)) <= 2000 THEN 1 ELSE length(trim(text)) // 2000 + 1 END AS int) n_estimated,
  CASE WHEN length(text) > 1500 THEN substring(text, 1, 1500) || '…' ELSE text END preview, substring(text, 1, 500) extract, CASE WHEN length(source) > 50 THEN substring(source, 1, 50) || '…' ELSE source END title FROM documents""")
def article_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", corpus.estimate_chunks(F.col("text"), 2000).alias("n_estimated"), text.article_preview(F.col("text")).alias("preview"),
        text.article_extract(F.col("text")).alias("extract"), text.title_preview(F.col("source")).alias("title"),
    )


@query(f"""WITH RECURSIVE {_CHUNKS} SELECT doc_id, count(*) n_chunks, min(length(chunk_text)) min_chars, max(length(chunk_text)) max_chars, round(avg(length(chunk_text)), 1) avg_chars
FROM chunked GROUP BY doc_id""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk_stats(corpus.chunk_documents(read(spark, sf_dir, "documents"), 2000, 200, 3000))


@query()
def extract_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all documents; each is given a date line from its id, as the test texts have none."""
    dated = F.concat(F.lit("On "), F.lpad((F.col("doc_id") % 2000 + 1).cast("string"), 4, "1"), F.lit("-05-07 the Board met Anna Smith. "), F.col("text"))
    return corpus.extract_events(read(spark, sf_dir, "documents").select("doc_id", dated.alias("text")))


@query("""WITH a AS (SELECT conv_id || '-' || turn response_id, text, (conv_id + turn) % 4 k FROM conversations WHERE role = 'assistant')
SELECT response_id, text description, '1999' date FROM a UNION ALL SELECT response_id, 'last', CASE WHEN k <> 3 THEN '2001' END FROM a""")
def records_from_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant texts as model answers: fenced, bare, with text around, or cut off in the last item."""
    rows = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    body = F.to_json(F.array(F.struct(F.col("text").alias("description"), F.lit("1999").alias("date")), F.struct(F.lit("last").alias("description"), F.lit("2001").alias("date"))))
    k = (F.col("conv_id") + F.col("turn")) % 4
    content = (
        F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, body)
        .when(k == 2, F.concat(F.lit("Here it is: "), body, F.lit(" done"))).otherwise(F.expr("substring(_b, 1, length(_b) - 12)"))
    )
    answers = rows.withColumn("_b", body).select(F.concat_ws("-", "conv_id", "turn").alias("response_id"), content.alias("content"))
    return corpus.records_from_responses(answers, "description:string,date:string")[0]


_STOPS = ", ".join(f"('{w}', '{lang}')" for lang, ws in corpus.STOP_WORDS.items() for w in ws)


@query(f"""WITH stop(word, language) AS (VALUES {_STOPS}),
hits AS (SELECT doc_id, language, count(*) n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) word FROM documents) JOIN stop USING (word) GROUP BY 1, 2),
best AS (SELECT doc_id, arg_max(language, (n, language)) language, max(n) hits FROM hits GROUP BY 1)
SELECT doc_id, coalesce(language, 'und') AS language, coalesce(hits, 0) hits FROM documents LEFT JOIN best USING (doc_id)""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.detect_language(read(spark, sf_dir, "documents").select("doc_id", "text"))


_TOLD = """concat('The Board met from March ', cast(doc_id % 900 + 1000 AS string), ' to June ', cast(doc_id % 900 + 1001 AS string), ' and on 7 May ', cast(doc_id % 90 + 1900 AS string),
 ' in Old Town. It fell in ', cast(doc_id % 500 + 1 AS string), ' BC and in the late 19th century. ', coalesce(text, ''))"""


@query(rf"""WITH d AS (SELECT doc_id, {_TOLD} AS text FROM documents),
s AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') parts FROM d),
p AS (SELECT doc_id, unnest(range(len(parts))) AS position, unnest(parts) AS sentence FROM s),
e AS (SELECT doc_id, position, sentence, regexp_extract_all(sentence, '{corpus.DATE_SPANS}') dates FROM p)
SELECT doc_id, cast(position AS int) AS position, cast(unnest(range(len(dates))) AS int) place, unnest(dates) event_date_str, trim(sentence) description, true is_read FROM e""".replace(" AS string)", " AS varchar)"))
def extract_dated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates of all documents, each behind two sentences with four dates of its own."""
    docs = read(spark, sf_dir, "documents").selectExpr("doc_id", f"{_TOLD} AS text")
    return corpus.extract_dated_events(docs).select(
        "doc_id", "position", "place", "event_date_str", "description", (F.col("date_info.precision") != "unknown").alias("is_read")
    )


@query(r"""WITH words AS (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) word FROM documents),
tf AS MATERIALIZED (SELECT doc_id, any_value(lang) lang, word, count(*) tf FROM words WHERE word <> '' GROUP BY doc_id, word),
padded AS (SELECT DISTINCT word, ' ' || word || ' ' p FROM tf),
grams AS MATERIALIZED (SELECT word, gram, count(*) k FROM (SELECT word, unnest(list_concat(list_transform(range(1, length(p)), lambda i: substring(p, i, 2)), list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3)))) gram FROM padded) GROUP BY 1, 2),
vocabulary AS (SELECT lang, word, sum(tf) tf FROM tf WHERE lang IS NOT NULL GROUP BY 1, 2),
counts AS MATERIALIZED (SELECT gram, lang, sum(tf * k) c FROM vocabulary JOIN grams USING (word) GROUP BY 1, 2),
bases AS (SELECT lang, cast(floor(1000 * ln((sum(c) + (SELECT count(DISTINCT gram) FROM counts))::DOUBLE)) AS bigint) base FROM counts GROUP BY 1),
per_word AS (SELECT word, lang, sum(k * cast(floor(1000 * ln((c + 1)::DOUBLE)) AS bigint)) s FROM grams JOIN counts USING (gram) GROUP BY 1, 2),
total AS (SELECT doc_id, sum(tf * n) total FROM tf JOIN (SELECT word, sum(k) n FROM grams GROUP BY 1) USING (word) GROUP BY 1),
sums AS (SELECT doc_id, per_word.lang, sum(tf * s) s FROM tf JOIN per_word USING (word) GROUP BY 1, 2),
scored AS (SELECT doc_id, lang, total, coalesce(s, 0) - total * base score FROM total CROSS JOIN bases LEFT JOIN sums USING (doc_id, lang)),
ranked AS (SELECT *, lead(score) OVER w AS other, row_number() OVER w AS r FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, lang))
SELECT doc_id, coalesce(ranked.lang, 'und') AS language, cast((score - other) // total AS bigint) margin FROM documents LEFT JOIN (SELECT * FROM ranked WHERE r = 1) ranked USING (doc_id)""")
def classify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of all labelled documents, read by every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return corpus.classify_languages(docs.select("doc_id", "text"), corpus.fit_languages(docs.select("lang", "text")))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) keyword FROM documents),
tf AS (SELECT doc_id, keyword, count(*) tf FROM t WHERE length(keyword) >= 4 GROUP BY 1, 2),
df AS (SELECT keyword, count(*) df FROM tf GROUP BY 1),
s AS (SELECT doc_id, keyword, round(tf * ln((SELECT count(*) FROM documents) / df), 6) score FROM tf JOIN df USING (keyword))
SELECT doc_id, cast(r AS int) rank, keyword, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword) r FROM s) WHERE r <= 10""")
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.top_keywords(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""WITH k AS (SELECT doc_id, cast(doc_id % 14 + 1 AS int) n, [source, lang, source || 'x'][1:cast(doc_id % 3 + 1 AS int)] o, [source, lang, 'b'][1:cast(doc_id % 2 + 2 AS int)] e FROM documents),
l AS (SELECT *, cast(least(10, greatest(2, CASE WHEN n <= 5 THEN least(n, 3) WHEN n <= 10 THEN least(n // 2, 6) ELSE 10 END)) AS int) lim FROM k)
SELECT doc_id, CASE WHEN n <= 5 THEN 'focused' WHEN n <= 10 THEN 'balanced' ELSE 'comprehensive' END strategy, lim AS n,
 CASE WHEN len(o) = len(e) THEN array_to_string(o[1:lim], ',') ELSE '' END original, CASE WHEN len(o) = len(e) THEN array_to_string(e[1:lim], ',') ELSE '' END english FROM l""")
def keyword_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    o = F.slice(F.array("source", "lang", F.concat("source", F.lit("x"))), F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))
    e = F.slice(F.array(F.col("source"), F.col("lang"), F.lit("b")), F.lit(1), (F.col("doc_id") % 2 + 2).cast("int"))
    plan = docs.select("doc_id", text.keyword_plan(o, e, (F.col("doc_id") % 14 + 1).cast("int")).alias("p"))
    return plan.select("doc_id", "p.strategy", "p.n", F.array_join("p.original", ",").alias("original"), F.array_join("p.english", ",").alias("english"))


@query("""SELECT DISTINCT keyword, lang FROM (SELECT unnest([source, 'k' || (doc_id % 50)]) keyword, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END lang FROM documents
UNION ALL SELECT unnest(['e' || (doc_id % 30)]) keyword, 'en' lang FROM documents) WHERE trim(keyword) <> ''""")
def keyword_fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    asked = docs.select(
        F.array(F.col("source"), F.concat(F.lit("k"), (F.col("doc_id") % 50).cast("string"))).alias("keywords"),
        F.array(F.concat(F.lit("e"), (F.col("doc_id") % 30).cast("string"))).alias("english_keywords"), F.when(F.col("doc_id") % 7 == 0, "und").otherwise(F.col("lang")).alias("language"),
    )
    return corpus.keyword_fetch_plan(asked)


@query("""SELECT item_id, coalesce(nullif(trim(regexp_replace(regexp_replace(text || ' (a: "b")', '[():"''\\\\]', ' ', 'g'), '\\s+', ' ', 'g')), ''), 'search') escaped,
 CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN 'translated' WHEN 2 THEN 'one, two' ELSE text END asked FROM benchmark""")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id") % 4
    words = F.when(k == 2, F.array(F.lit("one"), F.lit("two"))).otherwise(F.array().cast("array<string>"))
    asked = text.search_text(F.col("text"), F.when(k == 0, "en").otherwise("fr"), F.when(k == 1, "translated"), words)
    return read(spark, sf_dir, "benchmark").select("item_id", text.escape_query(F.concat("text", F.lit(' (a: "b")'))).alias("escaped"), asked.alias("asked"))
