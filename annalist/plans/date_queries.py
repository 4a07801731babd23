"""Queries of dates, years and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import dates
from annalist.operators import timeline
from annalist.plans.adapters import EVENT_SQL, RANGE_SQL, events
from annalist.plans.registry import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query(f"WITH {RANGE_SQL} SELECT id, cast(start_date AS varchar) start_date, cast(end_date AS varchar) end_date, start_date = end_date AS single_day FROM dated")
def to_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("date_range")
    return events(spark, sf_dir).select(
        "id", r["start_date"].cast("string").alias("start_date"), r["end_date"].cast("string").alias("end_date"), dates.is_single_day(r).alias("single_day")
    )


_DISPLAY = f"""
WITH base AS ({EVENT_SQL}),
p AS (SELECT *, nullif(start_year, 0) y1, coalesce(nullif(start_month, 0), 1) m1, coalesce(nullif(start_day, 0), 1) d1,
  coalesce(nullif(end_year, 0), nullif(start_year, 0)) y2, coalesce(nullif(end_month, 0), nullif(start_month, 0), 1) m2,
  coalesce(nullif(end_day, 0), nullif(start_day, 0), 1) d2,
  CASE precision WHEN 'decade' THEN 9 WHEN 'century' THEN 99 WHEN 'millennium' THEN 999 END span FROM base),
q AS (SELECT *, coalesce(y1 + span, y2) ey, CASE WHEN span IS NOT NULL OR precision = 'year' THEN 12 ELSE m2 END em FROM p),
r AS (SELECT *, CASE WHEN span IS NOT NULL OR precision = 'year' THEN 31
  WHEN precision = 'month' AND nullif(end_day, 0) IS NULL THEN day(last_day(try_cast(format('{{:04d}}-{{:02d}}-01', ey, em) AS date))) ELSE d2 END ed FROM q)
SELECT id, CASE WHEN y1 BETWEEN 1 AND 9999 THEN cast(try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', y1, m1, d1) AS date) AS varchar) END display_start,
  CASE WHEN y1 IS NOT NULL AND ey BETWEEN 1 AND 9999 THEN cast(try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', ey, em, ed) AS date) AS varchar) END display_end FROM r
"""


@query(_DISPLAY)
def display_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("date_info")
    return events(spark, sf_dir).select(
        "id", dates.display_start_date(d).cast("string").alias("display_start"), dates.display_end_date(d).cast("string").alias("display_end")
    )


_YEAR = """
yeared AS (SELECT *, coalesce(start_year, end_year) y, abs(coalesce(start_year, end_year))::DOUBLE n, CASE WHEN is_bce THEN ' BCE' ELSE '' END bce FROM base),
shown AS (SELECT *, coalesce(
  CASE WHEN n >= 1e9 THEN printf('%.1f', n / 1e9) || 'B' || bce WHEN n >= 1e6 THEN printf('%.0f', n / 1e6) || 'M' || bce
    WHEN n >= 1e5 THEN cast(cast(round(n / 1000) AS bigint) AS varchar) || 'K' || bce
    WHEN n >= 1e4 THEN regexp_replace(printf('%.1f', round(n / 100) / 10), '\\.0$', '') || 'K' || bce
    WHEN n IS NOT NULL THEN cast(cast(n AS bigint) AS varchar) || bce END,
  nullif(regexp_extract(event_date_str, '(\\d{4})', 1), '') || bce,
  CASE WHEN event_date_str = 'on some day (unclear)' THEN 'some day' END,
  nullif(event_date_str, ''), 'Unknown Date') display_year FROM yeared)
"""


@query(f"WITH base AS ({EVENT_SQL}), {_YEAR} SELECT id, display_year FROM shown")
def display_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("id", dates.display_year(F.col("date_info"), F.col("event_date_str")).alias("display_year"))


@query(f"""WITH base AS ({EVENT_SQL}), {_YEAR},
valued AS (SELECT DISTINCT display_year, CASE WHEN contains(display_year, 'BCE') THEN -1 ELSE 1 END * coalesce(
  try_cast(nullif(regexp_extract(display_year, '^(\\d+(?:\\.\\d+)?)\\s*([KMB])?\\s*(BCE)?$', 1), '') AS double)
   * CASE regexp_extract(display_year, '^(\\d+(?:\\.\\d+)?)\\s*([KMB])?\\s*(BCE)?$', 2) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1.0 END,
  try_cast(nullif(regexp_extract(display_year, '(\\d+)', 1), '') AS double), 0.0) AS value FROM shown)
SELECT display_year, value FROM valued""")
def timeline_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.timeline_years(events(spark, sf_dir))


_SORTED = """
placed AS (SELECT *, CASE WHEN start_year BETWEEN 1 AND 9999 THEN try_cast(format('{:04d}-{:02d}-{:02d}', start_year, coalesce(nullif(start_month, 0), 1), coalesce(nullif(start_day, 0), 1)) AS date) END day1,
  coalesce(start_year, CASE WHEN is_bce THEN -1 ELSE 1 END * try_cast(nullif(regexp_extract(event_date_str, '(\\d{4})', 1), '') AS int), 0) cv
  FROM base WHERE precision <> 'unknown' AND (start_year IS NOT NULL OR end_year IS NOT NULL))
"""


@query(f"""WITH base AS ({EVENT_SQL}), {_SORTED}
SELECT viewpoint_id, id, cast(row_number() OVER (PARTITION BY viewpoint_id ORDER BY cv, day1 NULLS FIRST, id) - 1 AS int) sequence_order FROM placed""")
def chronological_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.sequence_events(events(spark, sf_dir)).select("viewpoint_id", "id", "sequence_order")


@query(f"""WITH {RANGE_SQL} SELECT id, cast(epoch(start_date) AS bigint) start_second, cast(start_date AS varchar) start_date_iso, cast(end_date AS varchar) end_date_iso,
  event_date_str display_text, precision FROM dated""")
def date_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of events as a client sees them, with the second that their first day begins."""
    d = F.col("date_info")
    return events(spark, sf_dir).select("id", dates.start_timestamp(d).cast("long").alias("start_second"), dates.date_api_struct(d).alias("d")).select("id", "start_second", "d.*")


@query(f"""WITH {RANGE_SQL} SELECT id, row_number() OVER (ORDER BY start_date NULLS FIRST, id) AS place FROM dated""")
def sort_by_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the order by timestamp, counted range by range."""
    from annalist.operators.cluster import rank_by

    own = events(spark, sf_dir).select("id", F.struct(F.col("date_range.start_date").isNotNull(), "date_range.start_date", "id").alias("key"))
    return rank_by(own, "key").withColumnRenamed("rank", "place")


@query(f"""WITH base AS ({EVENT_SQL}), best AS (SELECT *, CASE WHEN start_year BETWEEN 1 AND 9999 THEN try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', start_year, coalesce(nullif(start_month, 0), 1), coalesce(nullif(start_day, 0), 1)) AS date) END day1 FROM base)
SELECT id, cast(coalesce(year(day1), try_cast(nullif(regexp_extract(event_date_str, '(\\d{{4}})', 1), '') AS int), 0) AS int) event_year,
 CASE WHEN day1 IS NULL THEN event_date_str WHEN precision = 'day' THEN strftime(day1, '%B %-d, %Y') WHEN precision = 'month' THEN strftime(day1, '%B %Y') ELSE cast(year(day1) AS varchar) END shown FROM best""")
def format_event_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("date_info")
    return events(spark, sf_dir).select(
        "id", dates.event_year(d, F.col("event_date_str")).cast("int").alias("event_year"), dates.format_event_date(d).alias("shown")
    )


_MONTH_NAMES = "['" + "', '".join(m.title() for m in dates.MONTHS) + "']"
_NORMALISED = f"""
WITH base AS ({EVENT_SQL}),
made AS (SELECT id, id % 18 f, abs(start_year) % 2000 + 1 y, coalesce(start_month, 5) m, id % 20 + 1 n, {_MONTH_NAMES}[coalesce(start_month, 5)] mon FROM base WHERE start_year IS NOT NULL),
padded AS (SELECT *, lpad(cast(y AS varchar), 4, '1') y4, cast(lpad(cast(y AS varchar), 4, '1') AS int) v4, lpad(cast(y AS varchar), 3, '1') y3, cast(substring(lpad(cast(y AS varchar), 3, '1'), 1, 3) AS int) v3 FROM made),
texts AS (SELECT *, CASE f WHEN 0 THEN mon || ' 3, ' || y4 WHEN 1 THEN 'spring of ' || y4 WHEN 2 THEN n || 'th century BCE' WHEN 3 THEN substring(y3, 1, 3) || '0s' WHEN 4 THEN y4 || '-12-05'
  WHEN 5 THEN 'circa ' || y || ' BC' WHEN 6 THEN 'long ago' WHEN 7 THEN 'Q' || (n % 4 + 1) || ' ' || y4 WHEN 8 THEN 'late ' || y4 WHEN 9 THEN 'mid-' || mon || ' ' || y4
  WHEN 10 THEN 'the early ' || substring(y3, 1, 3) || '0s' WHEN 11 THEN 'before ' || y4 WHEN 12 THEN 'the week of Thanksgiving, ' || y4
  WHEN 13 THEN mon || ' ' || y4 || ' - June ' || (v4 + 1) WHEN 14 THEN v3 || '0s-' || (v3 + 1) || '0s' WHEN 15 THEN n || 'th century - ' || (n + 1) || 'th century'
  WHEN 16 THEN 10 * n || ' BC - ' || 5 * n || ' AD' ELSE 'the freedom movement in Toledo, Macedonia' END date_text FROM padded),
turkey AS (SELECT *, make_date(v4, 11, 1) + cast((11 - dayofweek(make_date(v4, 11, 1))) % 7 + 21 AS int) feast FROM texts)
SELECT id, date_text, date_text original_text, date_text display_text,
 ['day', 'season', 'century', 'decade', 'day', 'year', 'unknown', 'month', 'month', 'day', 'year', 'year', 'day', 'year', 'decade', 'century', 'year', 'unknown'][f + 1] AS precision,
 cast(CASE f WHEN 2 THEN -n * 100 WHEN 3 THEN v3 * 10 WHEN 5 THEN -y WHEN 6 THEN NULL WHEN 10 THEN v3 * 10 WHEN 11 THEN NULL WHEN 14 THEN v3 * 10 WHEN 15 THEN (n - 1) * 100 + 1 WHEN 16 THEN -10 * n WHEN 17 THEN NULL ELSE v4 END AS int) start_year,
 cast(CASE f WHEN 0 THEN m WHEN 1 THEN 3 WHEN 4 THEN 12 WHEN 7 THEN 3 * (n % 4 + 1) - 2 WHEN 8 THEN 9 WHEN 9 THEN m WHEN 12 THEN month(feast - 4) WHEN 13 THEN m END AS int) start_month,
 cast(CASE f WHEN 0 THEN 3 WHEN 4 THEN 5 WHEN 9 THEN 11 WHEN 12 THEN day(feast - 4) END AS int) start_day,
 cast(CASE f WHEN 1 THEN v4 WHEN 2 THEN -((n - 1) * 100 + 1) WHEN 3 THEN v3 * 10 + 9 WHEN 7 THEN v4 WHEN 8 THEN v4 WHEN 9 THEN v4 WHEN 10 THEN v3 * 10 + 3 WHEN 11 THEN v4 WHEN 12 THEN v4 WHEN 13 THEN v4 + 1 WHEN 14 THEN v3 * 10 + 19 WHEN 15 THEN (n + 1) * 100 WHEN 16 THEN 5 * n END AS int) end_year,
 cast(CASE f WHEN 1 THEN 5 WHEN 7 THEN 3 * (n % 4 + 1) WHEN 8 THEN 12 WHEN 9 THEN m WHEN 12 THEN month(feast + 2) WHEN 13 THEN 6 END AS int) end_month,
 cast(CASE f WHEN 9 THEN 20 WHEN 12 THEN day(feast + 2) END AS int) end_day, f IN (2, 5, 16) is_bce FROM turkey
"""


@query(_NORMALISED)
def normalise_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date strings of every form, made from the events, parsed once for each distinct string."""
    own = events(spark, sf_dir).filter("date_info.start_year is not null")
    y, m = F.abs(F.col("date_info.start_year")) % 2000 + 1, F.coalesce("date_info.start_month", F.lit(5))
    name = F.element_at(F.array(*[F.lit(x.title()) for x in dates.MONTHS]), m)
    y4, y3 = F.lpad(y.cast("string"), 4, "1"), F.lpad(y.cast("string"), 3, "1")
    n = F.col("id") % 20 + 1
    forms = [
        F.concat(name, F.lit(" 3, "), y4), F.concat(F.lit("spring of "), y4), F.concat(n.cast("string"), F.lit("th century BCE")), F.concat(y3, F.lit("0s")),
        F.concat(y4, F.lit("-12-05")), F.concat(F.lit("circa "), y.cast("string"), F.lit(" BC")), F.lit("long ago"),
        F.concat(F.lit("Q"), (n % 4 + 1).cast("string"), F.lit(" "), y4), F.concat(F.lit("late "), y4), F.concat(F.lit("mid-"), name, F.lit(" "), y4),
        F.concat(F.lit("the early "), y3, F.lit("0s")), F.concat(F.lit("before "), y4), F.concat(F.lit("the week of Thanksgiving, "), y4),
        F.concat(name, F.lit(" "), y4, F.lit(" - June "), (y4.cast("int") + 1).cast("string")), F.concat(y3, F.lit("0s-"), (y3.cast("int") + 1).cast("string"), F.lit("0s")),
        F.concat(n.cast("string"), F.lit("th century - "), (n + 1).cast("string"), F.lit("th century")),
        F.concat((10 * n).cast("string"), F.lit(" BC - "), (5 * n).cast("string"), F.lit(" AD")), F.lit("the freedom movement in Toledo, Macedonia"),
    ]
    text = F.element_at(F.array(*forms), (F.col("id") % len(forms)).cast("int") + 1)
    parsed = dates.normalise_dates(own.select("id", text.alias("date_text")), "date_text")
    return parsed.select("id", "date_text", "date_info.*")


@query(f"""WITH base AS ({EVENT_SQL}), t AS (SELECT viewpoint_id, max(id) last FROM base GROUP BY 1)
SELECT b.viewpoint_id, count(*) n_kept FROM base b JOIN t USING (viewpoint_id) JOIN events e ON e.event_id = b.id
WHERE e.ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 DAY GROUP BY 1""")
def expire_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annalist.sources.tables import expire_by_age as expire

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 20).alias("viewpoint_id"), "ts")
    return expire(rows, "ts", 10, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).groupBy("viewpoint_id").agg(F.count(F.lit(1)).alias("n_kept"))


