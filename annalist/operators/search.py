"""Retrieval over a chunk corpus: BM25, vectors, both together, and articles made of chunks.

Every operator takes a table of queries and answers all of them in one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from annalist.operators.pairs import nearest
from annalist.scratch import sent, spool

K1, B = 1.2, 0.75
#: So many terms of queries are sent to all tasks, behind a count; more are merged.
BROADCAST_TERMS = 100_000
#: Texts whose words a task counts at a time.
ROWS = 1024


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def bm25_scores(chunks: DataFrame, queries: DataFrame, text: str = "chunk_text", key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score) of the published BM25, for chunks that hold a query term.

    Scores are rounded to nine digits, so that equal texts tie whatever the order of summing. A repeated query term counts once.

    Few query terms are sent to all tasks, where a chunk's scores are made as it is read: nothing is shuffled. Where terms are many,
    or a key repeats, terms that no query has are dropped before the counts of the others are shuffled.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query_text")))).alias("term")).distinct()
    own = chunks.select(key, terms(F.col(text)).alias("_terms"))
    asked = wanted.limit(BROADCAST_TERMS + 1).collect()
    if len(asked) <= BROADCAST_TERMS and chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return _scores_of_rows(own, asked, wanted, key)
    n, total = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_terms")), F.lit(0))).first()
    mean = max(total / n, 1e-9) if n else 1.0
    spread = own.select(key, F.size("_terms").alias("len"), F.explode("_terms").alias("term"))
    tf = spread.join(wanted.select("term").distinct().hint("merge"), "term", "left_semi").groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    scored = tf.join(df.hint("merge"), "term").select(key, "term", weight.alias("w"))
    return scored.join(wanted.hint("merge"), "term").groupBy("query_id", key).agg(F.round(F.sum("w"), 9).alias("score"))


def _term_counts(lists: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of words: their lengths, and by row and place in the vocabulary the number of times it is there (row, term, tf)."""
    length = lists.value_lengths().to_numpy()
    place = pa.compute.index_in(lists.flatten(), value_set=vocabulary)
    place = place.fill_null(-1).to_numpy().astype(np.int64)
    row, held = np.repeat(np.arange(len(length)), length), place >= 0
    both, tf = np.unique(row[held] * max(1, len(vocabulary)) + place[held], return_counts=True)
    return length, both // max(1, len(vocabulary)), both % max(1, len(vocabulary)), tf


def _scores_of_rows(own: DataFrame, asked: list[Row], wanted: DataFrame, key: str) -> DataFrame:
    """The scores of rows (key, _terms) of keys of their own, for few query terms (query_id, term); ``wanted`` has their types."""
    spark = own.sparkSession
    number = {q: k for k, q in enumerate(dict.fromkeys(r.query_id for r in asked))}
    words = {t: k for k, t in enumerate(dict.fromkeys(r.term for r in asked))}
    by_term = np.array(sorted((words[r.term], number[r.query_id]) for r in asked), np.int64).reshape(-1, 2)
    first = np.searchsorted(by_term[:, 0], np.arange(len(words) + 1))
    vocabulary = pa.array(list(words), pa.string())

    def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows, words, and rows with each term there are, under -2, -1 and the term."""
        n, total, df = 0, 0, np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for part in parts(b):
                length, _, term, _ = _term_counts(part.column(1), vocabulary)
                n, total = n + len(length), total + int(length.sum())
                df += np.bincount(term, minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(df)), pa.int32()), pa.array(np.concatenate([[n, total], df]), pa.int64())], ["term", "n"])

    found = dict(own.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
    n, total = found.get(-2, 0), found.get(-1, 0)
    mean = max(total / n, 1e-9) if n else 1.0
    df = np.array([found.get(k, 0) for k in range(len(words))], np.float64)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast((vocabulary, first, by_term[:, 1], idf))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, first, query, idf = shared.value
        for b in batches:
            for part in parts(b):
                length, row, term, tf = _term_counts(part.column(1), vocabulary)
                weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
                times = first[term + 1] - first[term]
                place = np.repeat(np.arange(len(term)), times)
                asks = query[np.repeat(first[term] - np.cumsum(times) + times, times) + np.arange(len(place))]
                both, of = np.unique(row[place] * max(1, len(number)) + asks, return_inverse=True)
                rows, asks = both // max(1, len(number)), both % max(1, len(number))
                total = np.bincount(of, weights=weight[place], minlength=len(both))
                yield pa.RecordBatch.from_arrays([pa.array(asks, pa.int32()), part.column(0).take(pa.array(rows)), pa.array(total, pa.float64())], ["_query", key, "score"])

    scored = own.mapInArrow(score, StructType([StructField("_query", IntegerType()), StructField(key, own.schema[key].dataType), StructField("score", DoubleType())]))
    ids = spark.createDataFrame([(k, q) for q, k in number.items()], StructType([StructField("_query", IntegerType()), StructField("query_id", wanted.schema["query_id"].dataType)]))
    return scored.join(F.broadcast(ids), "_query").select("query_id", key, F.round("score", 9).alias("score"))


def top_per_query(scored: DataFrame, n: int, order: list[Column], by: str = "query_id") -> DataFrame:
    """The first n rows of each query, with their ``rank`` from 1."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n)


def search_news(keywords: DataFrame, articles: DataFrame, k: int = 3) -> DataFrame:
    """(keyword, article_id, rank): the best k titled articles of each keyword."""
    titled = articles.filter(F.trim("title") != "")
    queries = keywords.select(F.col("keyword").alias("query_id"), F.col("keyword").alias("query_text")).distinct()
    scored = bm25_scores(titled, queries, "text_content", "article_id")
    return top_per_query(scored, k, [F.desc("score"), F.col("article_id")]).withColumnRenamed("query_id", "keyword")


def semantic_chunks(chunks: DataFrame, queries: DataFrame, n: int, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk columns, distance, similarity, rank): the nearest n chunks of each query.

    queries: query_id, query_vector. Blocks of queries meet all shards of the chunks. texts: the chunks without vectors, where
    they can be read without these; few found ones are sent to them, so that no text is shuffled.
    """
    asked = queries.select("query_id", F.col("query_vector").alias("vector"))
    best = nearest(asked, chunks.select(F.col("chunk_id").alias("id"), "vector"), n).withColumnRenamed("id", "chunk_id")
    distance = 1 - F.col("similarity")
    near = best.select("query_id", "chunk_id", "rank", distance.alias("distance"), ((2 - distance) / 2).alias("similarity"))
    return (chunks.drop("vector") if texts is None else texts).join(sent(spool(near, "near-chunks")), "chunk_id")


def semantic_articles(chunks: DataFrame, queries: DataFrame, article_limit: int = 10, pool: int = 100, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, distance, rank, text): articles of the nearest chunks, with all their chunks."""
    texts = chunks.drop("vector") if texts is None else texts
    near = semantic_chunks(chunks, queries, pool, texts)
    best = near.groupBy("query_id", "doc_id").agg(F.min("distance").alias("distance"))
    top = spool(top_per_query(best, article_limit, [F.round("distance", 12), F.col("doc_id")]), "top-articles")
    return top.join(article_texts(texts, top.select("doc_id").distinct()).hint("merge"), "doc_id")


def article_texts(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the wanted articles, chunks in order."""
    own = chunks.select("doc_id", "chunk_index", "chunk_text").join(sent(wanted), "doc_id", "left_semi")
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_text")))
    return own.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda c: c["chunk_text"]), "").alias("text"))


def hybrid_chunks(
    chunks: DataFrame, queries: DataFrame, vector_weight: float = 0.6, bm25_weight: float = 0.4, candidates: int = 100, texts: DataFrame | None = None
) -> DataFrame:
    """(query_id, chunk_id, similarity, bm25, fusion): both candidate lists, fused.

    texts: as in ``semantic_chunks``. BM25 is divided by the best score of its query. A weight of 0 leaves its search out.
    """
    vector = lexical = None
    if vector_weight > 0:
        vector = semantic_chunks(chunks, queries, candidates, texts).select("query_id", "chunk_id", "similarity")
    if bm25_weight > 0:
        scored = top_per_query(bm25_scores(chunks if texts is None else texts, queries), candidates, [F.desc("score"), F.col("chunk_id")])
        best = F.max("score").over(Window.partitionBy("query_id"))
        lexical = scored.select("query_id", "chunk_id", (F.col("score") / best).alias("bm25"))
    if vector is None and lexical is None:
        raise ValueError("both weights are zero")
    if vector is None:
        both = lexical.withColumn("similarity", F.lit(0.0))
    elif lexical is None:
        both = vector.withColumn("bm25", F.lit(0.0))
    else:
        both = vector.join(lexical.hint("merge"), ["query_id", "chunk_id"], "full_outer").fillna(0.0, ["similarity", "bm25"])
    fusion = vector_weight * F.col("similarity") + bm25_weight * F.col("bm25")
    return both.withColumn("fusion", F.round(fusion, 9))


def hybrid_search(
    chunks: DataFrame, queries: DataFrame, limit: int = 10, vector_weight: float = 0.6, bm25_weight: float = 0.4, texts: DataFrame | None = None
) -> DataFrame:
    """(query_id, doc_id, rank, score, text): articles by their best chunk, text of the found chunks.

    texts: as in ``semantic_chunks``.
    """
    fused = spool(hybrid_chunks(chunks, queries, vector_weight, bm25_weight, 10 * limit, texts), "fused-chunks")
    found = (chunks if texts is None else texts).select("chunk_id", "doc_id", "chunk_index", "chunk_text").join(sent(fused), "chunk_id")
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_text")))
    articles = found.groupBy("query_id", "doc_id").agg(
        F.max("fusion").alias("score"), F.array_join(F.transform(ordered, lambda c: c["chunk_text"]), "").alias("text")
    )
    return top_per_query(articles, limit, [F.desc("score"), F.col("doc_id")])


def assemble_articles(ranked: DataFrame, limit: int = 10, separator: str = "\n\n... ") -> DataFrame:
    """(query_id, doc_id, position, text) from ranked chunks (query_id, doc_id, rank, chunk_text).

    Articles come in the order of their first chunk, the first ``limit`` of each query; a chunk is
    added unless the text so far contains it.
    """
    first = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first_rank"), F.sort_array(F.collect_list(F.struct("rank", "chunk_text"))).alias("parts"))
    kept = first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank", "doc_id"))).filter(F.col("position") <= limit)
    texts = F.transform("parts", lambda p: F.coalesce(p["chunk_text"], F.lit("")))
    joined = F.aggregate(
        F.slice(texts, F.lit(2), F.size(texts)),
        F.get(texts, F.lit(0)),
        lambda acc, t: F.when((t == "") | acc.contains(t), acc).otherwise(F.concat(acc, F.lit(separator), t)),
    )
    return kept.select("query_id", "doc_id", "position", joined.alias("text"))
