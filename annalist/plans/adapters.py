"""Domain tables made from the test tables, in Spark and as SQL text for the comparison engine.

Plain columns are SQL expressions that both engines read alike; nested ones are added per engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.dates import to_date_range

PRECISIONS = ("day", "month", "year", "season", "decade", "century", "millennium", "era", "unknown")
_PRECISION = "CASE event_id % 9 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PRECISIONS)) + " END"
DATE_PARTS = ("start_year", "start_month", "start_day", "end_year", "end_month", "end_day")

#: Events with imprecise dates: BCE, far years, zero ends, missing parts, impossible days.
EVENT_COLUMNS = {
    "id": "event_id",
    "rank": "event_id",
    "user_id": "user_id",
    "description": "concat(event_type, ' ', props, ' by ', cast(user_id AS string))",
    "event_date_str": "CASE WHEN event_id % 10 = 0 THEN 'on some day (unclear)' WHEN event_id % 10 = 1 THEN ''"
    " ELSE concat('on ', substring(cast(ts AS string), 1, 10), ' (approx)') END",
    "precision": _PRECISION,
    "start_year": "cast(CASE WHEN event_id % 13 = 0 THEN -(event_id % 5000) * 7000 - 1 WHEN event_id % 17 = 0 THEN NULL"
    " WHEN event_id % 19 = 0 THEN 9000 + event_id % 90000 ELSE year(ts) - event_id % 900 END AS int)",
    "start_month": "cast(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 12 + 1 END AS int)",
    "start_day": "cast(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 31 + 1 END AS int)",
    "end_year": "cast(CASE WHEN event_id % 5 = 0 THEN year(ts) - event_id % 900 + 3 WHEN event_id % 7 = 0 THEN 0 ELSE NULL END AS int)",
    "end_month": "cast(CASE WHEN event_id % 6 = 0 THEN (event_id + 4) % 12 + 1 ELSE NULL END AS int)",
    "end_day": "cast(CASE WHEN event_id % 8 = 0 THEN event_id % 28 + 1 ELSE NULL END AS int)",
    "is_bce": "event_id % 13 = 0",
    "language": "CASE user_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END",
    "event_type": "event_type",
    "score": "CASE WHEN event_id % 23 = 0 THEN NULL ELSE cast(floor(value) AS double) / 100 END",
    "viewpoint_id": "user_id % 20",
    "source_document_id": "cast(user_id % 20 AS string)",
}
EVENT_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in EVENT_COLUMNS.items()) + " FROM events"
#: For the other engine, the interval of an event as start_date and end_date.
RANGE_SQL = f"""
base AS ({EVENT_SQL}),
parts AS (SELECT *, start_year y1, coalesce(nullif(start_month, 0), 1) m1, coalesce(nullif(start_day, 0), 1) d1,
  coalesce(nullif(end_year, 0), start_year) y2 FROM base),
more AS (SELECT *, coalesce(nullif(end_month, 0), m1) m2, coalesce(nullif(end_day, 0), d1) d2 FROM parts),
ends AS (SELECT *, CASE WHEN precision = 'decade' THEN y1 + 9 ELSE y2 END ey,
  CASE WHEN precision IN ('year', 'decade') THEN 12 WHEN precision = 'season' THEN coalesce(end_month, least(12, m1 + 2)) ELSE m2 END em FROM more),
months AS (SELECT *, try_cast(format('{{:04d}}-{{:02d}}-01', ey, em) AS date) month_start FROM ends),
days AS (SELECT *, CASE WHEN precision IN ('month', 'season') OR (end_day IS NULL AND end_month IS NOT NULL AND em <> m1)
  THEN day(last_day(month_start)) WHEN precision IN ('year', 'decade') THEN 31 ELSE d2 END ed FROM months),
raw_dates AS (SELECT *, CASE WHEN y1 BETWEEN 1 AND 9999 AND y2 BETWEEN 1 AND 9999 THEN try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', y1, m1, d1) AS date) END sd,
  CASE WHEN ey BETWEEN 1 AND 9999 THEN try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', ey, em, ed) AS date) END ld FROM days),
dated AS (SELECT *, CASE WHEN sd IS NOT NULL AND ld IS NOT NULL THEN least(sd, ld) END start_date,
  CASE WHEN sd IS NOT NULL AND ld IS NOT NULL THEN greatest(sd, ld) END end_date FROM raw_dates)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with date_info, entities and the sides of pairs."""
    flat = read(spark, sf_dir, "events").selectExpr(*[f"{v} AS {k}" for k, v in EVENT_COLUMNS.items()])
    info = F.struct(
        F.col("event_date_str").alias("original_text"), F.lit("").alias("display_text"), "precision", *DATE_PARTS, "is_bce"
    )
    entity = lambda n: F.concat(F.lit("u"), (F.col("user_id") % n).cast("string"))
    return (
        flat.withColumn("date_info", info)
        .drop("precision", *DATE_PARTS, "is_bce")
        .withColumn("date_range", to_date_range(F.col("date_info")))
        .withColumn("year", F.year("date_range.start_date"))
        .withColumn("entity_ids", F.array(F.concat(F.lit("e"), F.col("user_id").cast("string")), F.concat(F.lit("g"), F.floor(F.col("user_id") / 5).cast("string"))))
        .withColumn("entity_types", F.array("event_type"))
        .withColumn("entities", F.array(F.struct(entity(50).alias("name"), F.col("event_type").alias("type"))))
    )


#: The same entity columns for the other engine.
SIDE_SQL = f"""
{RANGE_SQL},
sides AS (SELECT *, year(start_date) AS year, ['e' || user_id, 'g' || (user_id // 5)] AS entity_ids, [event_type] AS entity_types FROM dated)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("rank"), F.col("embedding").alias("vector"), "label")


def _chunk_rows(docs: DataFrame, vec_id: Column) -> DataFrame:
    """Documents as chunks, three to an article."""
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 3).cast("string").alias("doc_id"), (F.col("doc_id") % 3).cast("int").alias("chunk_index"),
        F.concat(F.lit("Article "), F.floor(F.col("doc_id") / 3).cast("string")).alias("title"), F.col("text").alias("chunk_text"), vec_id.alias("vec_id"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, three to an article, with the vector of the id modulo the vectors."""
    docs, vecs = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    n = vecs.count()
    own = _chunk_rows(docs, F.col("doc_id") % n)
    return own.join(vecs.select("vec_id", F.col("embedding").alias("vector")).hint("merge"), "vec_id", "left").drop("vec_id")


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks without vectors. Texts needn't meet these, unless an id of them repeats, which repeats the chunk."""
    vecs = read(spark, sf_dir, "embeddings").select("vec_id")
    if not vecs.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and vec_id is not null").isEmpty():
        return chunks(spark, sf_dir).drop("vector")
    return _chunk_rows(read(spark, sf_dir, "documents"), F.lit(None)).drop("vec_id")


CHUNK_SQL = """
chunks AS (SELECT d.doc_id chunk_id, cast(d.doc_id // 3 AS varchar) doc_id, cast(d.doc_id % 3 AS int) chunk_index, d.text chunk_text,
  e.embedding::DOUBLE[] vector FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings))
"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query a benchmark item: its whole text, and the vector of the id modulo the vectors."""
    items, vecs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "embeddings")
    own = items.select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query_text"), (F.col("item_id") % vecs.count()).alias("vec_id"))
    return own.join(vecs.select("vec_id", F.col("embedding").alias("query_vector")).hint("merge"), "vec_id", "left").drop("vec_id")


QUERY_SQL = """
asked AS (SELECT cast(item_id AS varchar) query_id, text query_text, e.embedding::DOUBLE[] query_vector
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id % (SELECT count(*) FROM embeddings))
"""

TASK_COLUMNS = {
    "id": "cast(o_orderkey AS string)",
    "task_type": "CASE o_orderkey % 4 WHEN 0 THEN 'entity_canonical' WHEN 1 THEN 'document_canonical' WHEN 2 THEN 'synthetic_viewpoint' ELSE 'other' END",
    "topic_text": "CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE concat(' topic ', cast(o_custkey % 40 AS string)) END",
    "entity_id": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE cast(o_custkey AS string) END",
    "source_document_id": "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE cast(o_custkey AS string) END",
    "owner_id": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE cast(o_custkey AS string) END",
    "is_public": "substring(o_orderpriority, 1, 1) IN ('1', '2')",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END",
    "viewpoint_id": "cast(o_orderkey AS string)",
    "created_at": "o_orderdate",
}
TASK_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in TASK_COLUMNS.items()) + " FROM orders"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*[f"{v} AS {k}" for k, v in TASK_COLUMNS.items()])


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("username"))


def viewpoint_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as events of the viewpoint of their order."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("viewpoint_id"), F.col("l_partkey").cast("string").alias("event_id"),
        F.col("l_linenumber").alias("sequence_order"), F.round(F.col("l_discount") * 10, 2).alias("relevance_score"),
    )
