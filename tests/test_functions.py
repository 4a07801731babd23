"""Column functions on hand-made rows: dates, texts, urls, scores, vectors."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions import dates, scores, text, urls, vectors

FIELDS = ("original_text", "display_text", "precision", "start_year", "start_month", "start_day", "end_year", "end_month", "end_day", "is_bce")


def info(precision, y1=None, m1=None, d1=None, y2=None, m2=None, d2=None, bce=False, shown="", original="o"):
    return (original, shown, precision, y1, m1, d1, y2, m2, d2, bce)


def day(*ymd):
    return datetime.date(*ymd)


RANGES = [
    (info("day", 1999, 5, 7), (day(1999, 5, 7), day(1999, 5, 7))),
    (info("day", 2023, 2, 29), None),
    (info("day", 2024, 2, 29), (day(2024, 2, 29), day(2024, 2, 29))),
    (info("month", 2021, 2), (day(2021, 2, 1), day(2021, 2, 28))),
    (info("month", 2021, 2, None, None, 4), (day(2021, 2, 1), day(2021, 4, 30))),
    (info("year", 1900), (day(1900, 1, 1), day(1900, 12, 31))),
    (info("year", 1900, None, None, 0), (day(1900, 1, 1), day(1900, 12, 31))),
    (info("season", 2000, 12, None, None, 2), (day(2000, 2, 29), day(2000, 12, 1))),
    (info("season", 2000, 11), (day(2000, 11, 1), day(2000, 12, 31))),
    (info("decade", 1980, None, None, 1983), (day(1980, 1, 1), day(1989, 12, 31))),
    (info("decade", 9995), None),
    (info("century", 1801, None, None, 1900), (day(1801, 1, 1), day(1900, 1, 1))),
    (info("day", 2001, 5, 9, 2000, 1, 1), (day(2000, 1, 1), day(2001, 5, 9))),
    (info("century", -300, None, None, -201, bce=True), None),
    (info("year", 12000), None),
    (info("unknown"), None),
    (info("year", None, None, None, 1950), None),
]


@pytest.fixture(scope="module")
def ranges(spark):
    rows = [(k, r) for k, (r, _) in enumerate(RANGES)] + [(99, None)]
    table = spark.createDataFrame(rows, f"id int, d {schemas.DATE_INFO}")
    shown = table.select("id", dates.to_date_range(F.col("d")).alias("r"), dates.display_start_date(F.col("d")).alias("s"), dates.display_end_date(F.col("d")).alias("e"))
    return {r.id: r for r in shown.collect()}


def test_ranges(ranges):
    for k, (_, expected) in enumerate(RANGES):
        got = ranges[k].r
        assert (None if got is None else (got.start_date, got.end_date)) == expected, k
    assert ranges[99].r is None


def test_client_dates_widen_centuries_but_no_seasons(ranges):
    assert (ranges[11].s, ranges[11].e) == (day(1801, 1, 1), day(1900, 12, 31))
    assert ranges[8].e == day(2000, 11, 1) and ranges[13].s is None and ranges[3].e == day(2021, 2, 28)


def one(spark, column, **values):
    named = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return named.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "year,bce,shown",
    [(-4_500_000_000, True, "4.5B BCE"), (-66_000_000, True, "66M BCE"), (-12_000, True, "12K BCE"), (12_345, False, "12.3K"), (123_456, False, "123K"), (-44, True, "44 BCE"), (1999, False, "1999")],
)
def test_display_years_and_back(spark, year, bce, shown):
    got = spark.range(1).select(dates.scaled_year(F.lit(year), F.lit(bce)).alias("y")).select("y", dates.parse_display_year(F.col("y")).alias("v")).first()
    assert got.y == shown and abs(got.v - year) <= abs(year) * 0.05


PARSED = [
    ("around the summer of 1994", ("season", 1994, 6, None, 1994, 8, None, False)), ("the first quarter of 2023", ("month", 2023, 1, None, 2023, 3, None, False)),
    ("late 2021", ("month", 2021, 9, None, 2021, 12, None, False)), ("Mid-June 1815", ("day", 1815, 6, 11, 1815, 6, 20, False)),
    ("the early 2000s", ("year", 2000, None, None, 2003, None, None, False)), ("a decade after the fall of the Berlin Wall", ("year", 1999, None, None, None, None, None, False)),
    ("the week of Thanksgiving, 1963", ("day", 1963, 11, 24, 1963, 11, 30, False)), ("Circa 480 BC", ("year", -480, None, None, None, None, None, True)),
    ("the last day of the Heian period", ("day", 1185, 4, 25, None, None, None, False)), ("the beginning of the Meiji Restoration", ("day", 1868, 1, 3, None, None, None, False)),
    ("1950s", ("decade", 1950, None, None, 1959, None, None, False)), ("the Spring of '88", ("season", 1988, 3, None, 1988, 5, None, False)),
    ("the Christmas season of 1999", ("season", 1999, 12, None, 1999, 12, None, False)), ("Q3 2021", ("month", 2021, 7, None, 2021, 9, None, False)),
    ("late February 2024", ("day", 2024, 2, 21, 2024, 2, 29, False)), ("the Meiji era", ("era", 1868, None, None, 1912, None, None, False)),
    ("In Norse mythology", ("era", -200, None, None, 1300, None, None, True)), ("1st century BC", ("century", -100, None, None, -1, None, None, True)),
    ("late 1st century BC", ("year", -34, None, None, -1, None, None, True)), ("early 19th century", ("year", 1801, None, None, 1833, None, None, False)),
    ("late 1960s", ("year", 1967, None, None, 1969, None, None, False)), ("mid 1960s", ("year", 1964, None, None, 1966, None, None, False)),
    ("Thanksgiving 2023", ("day", 2023, 11, 23, None, None, None, False)), ("Christmas Eve 1914", ("day", 1914, 12, 24, None, None, None, False)),
    ("2nd millennium BC", ("millennium", -2000, None, None, -1001, None, None, True)), ("winter of '05", ("season", 2005, 12, None, 2006, 2, None, False)),
    ("1969-07-20", ("day", 1969, 7, 20, None, None, None, False)), ("July 20, 1969", ("day", 1969, 7, 20, None, None, None, False)),
    ("20th of July 1969", ("day", 1969, 7, 20, None, None, None, False)), ("July 1969", ("month", 1969, 7, None, None, None, None, False)),
    ("spring of 1848", ("season", 1848, 3, None, 1848, 5, None, False)), ("winter 1812", ("season", 1812, 12, None, 1813, 2, None, False)),
    ("1920s", ("decade", 1920, None, None, 1929, None, None, False)), ("3rd century BCE", ("century", -300, None, None, -201, None, None, True)),
    ("19th century", ("century", 1801, None, None, 1900, None, None, False)), ("1914-1918", ("year", 1914, None, None, 1918, None, None, False)),
    ("from 1939 to 1945", ("year", 1939, None, None, 1945, None, None, False)), ("44 BC", ("year", -44, None, None, None, None, None, True)),
    ("circa 1300", ("year", 1300, None, None, None, None, None, False)), ("before 1500", ("year", None, None, None, 1500, None, None, False)),
    ("September 2017 - June 2018", ("year", 2017, 9, None, 2018, 6, None, False)), ("March to May 1999", ("month", 1999, 3, None, 1999, 5, None, False)),
    ("June 3-7, 1950", ("day", 1950, 6, 3, 1950, 6, 7, False)), ("June 28 – July 2, 1950", ("month", 1950, 6, 28, 1950, 7, 2, False)),
    ("1960s-1970s", ("decade", 1960, None, None, 1979, None, None, False)), ("20th century - 21st century", ("century", 1901, None, None, 2100, None, None, False)),
    ("19th to 20th century", ("century", 1801, None, None, 2000, None, None, False)), ("100 BC - 50 AD", ("year", -100, None, None, 50, None, None, True)),
    ("500 - 300 BC", ("year", -500, None, None, -300, None, None, True)), ("between 1815 and 1848", ("year", 1815, None, None, 1848, None, None, False)),
    ("early 1990s - late 2000s", ("year", 1990, None, None, 2009, None, None, False)), ("2010-2015", ("year", 2010, None, None, 2015, None, None, False)),
    ("2010-05", ("month", 2010, 5, None, None, None, None, False)), ("the Edo period", ("era", 1603, None, None, 1868, None, None, False)),
    ("the Battle of Hastings", ("day", 1066, 10, 14, None, None, None, False)), ("the Ming dynasty", ("era", 1368, None, None, 1644, None, None, False)),
    *((place, ("unknown", None, None, None, None, None, None, False)) for place in (
        "the freedom movement", "Toledo", "Macedonia", "The Norseman hotel", "Algonquin Park", "the Showa district", "Middle Ages Village", "to be decided", "North - South",
    )),
    ("long ago", ("unknown", None, None, None, None, None, None, False)), ("2nd millennium", ("millennium", 1001, None, None, 2000, None, None, False)),
]


def test_date_texts(spark):
    rows = [(t,) for t, _ in PARSED] * 2 + [(None,)]
    got = dates.normalise_dates(spark.createDataFrame(rows, "t string"), "t")
    assert got.count() == len(rows)
    found = {r.t: tuple(r.date_info[f] for f in FIELDS[2:]) for r in got.filter("t is not null").collect()}
    assert found == dict(PARSED)


def test_timestamps_and_upgrades(spark):
    assert one(spark, dates.normalise_timestamp(F.col("t")), t="2024-05-01T10:00:00.123456+00:00Z") == "2024-05-01T10:00:00.123Z"
    assert one(spark, dates.format_progress_time(F.col("t")), t="2024-05-01T10:00:00.5+00:00") == "2024-05-01 10:00:00"
    assert one(spark, dates.format_progress_time(F.col("t")), t="soon") == "--:--:--"
    assert one(spark, dates.combined_date_text(F.col("a"), F.col("b")), a="May", b="May 1999") == "May(May 1999)"
    old = spark.createDataFrame([({"date_str": "1999"},), ({"original_text": "a", "display_text": "b", "precision": "year", "is_bce": "true", "start_year": "-5"},), ({},)], "m map<string,string>")
    first, second, third = [r.x for r in old.select(dates.upgrade_date_info(F.col("m"), F.lit("f")).alias("x")).collect()]
    assert (first.original_text, first.precision, second.start_year, second.is_bce, third) == ("1999", "unknown", -5, True, None)


def test_texts(spark):
    assert one(spark, text.escape_query(F.col("q")), q=' (a: "b")  \\c ') == "a b c" and one(spark, text.escape_query(F.col("q")), q='()"') == "search"
    options = text.disambiguation_options(F.lit("* Mercury, a planet\ntext\n* Mars – red\n*" + " x" * 60))
    assert spark.range(1).select(options.alias("x")).first().x == ["Mercury", "Mars"]
    plans = [(3, 3), (5, 3), (8, 4), (10, 5), (30, 10), (1, 2)]
    got = spark.createDataFrame(plans, "n int, e int").select(text.keyword_limit(F.col("n")).alias("x"), "e").collect()
    assert all(r.x == r.e for r in got)


def test_urls(spark):
    rows = [
        ("https://en.wikipedia.org/wiki?curid=7", None, None, "https://en.wikipedia.org/wiki?curid=7"), ("https://en.wikipedia.org/wiki/X", "9", None, "https://en.wikipedia.org/wiki?curid=9"),
        ("https://en.wikipedia.org/wiki/X", None, None, "https://en.wikipedia.org/wiki/X"), ("https://www.wikipedia.org/?curid=3", None, None, "https://www.wikipedia.org/wiki?curid=3"),
        ("x", "1", "de", "https://de.wikipedia.org/wiki?curid=1"), ("", "1", "de", ""), (None, "1", "de", None),
    ]
    table = spark.createDataFrame(rows, "u string, p string, l string, e string")
    assert all(r.x == r.e for r in table.select(urls.normalise_url(F.col("u"), F.col("p"), F.col("l")).alias("x"), "e").collect())
    assert one(spark, urls.url_domain(F.col("u")), u="https://www.Example.com:8080/x") == "example.com" and one(spark, urls.url_domain(F.col("u")), u="no url") == "External Source"
    assert one(spark, urls.source_label(F.col("u")), u="https://fr.wikinews.org/x") == "Wikinews"


def test_scores(spark):
    side = "struct<entity_ids:array<string>,entity_types:array<string>,year:int,date_range:struct<start_date:date,end_date:date>,language:string,description:string>"
    r = lambda a, b: (day(a, 1, 1), day(b, 1, 1))
    rows = [
        (1, (["a", "b"], ["T"], 2000, r(2000, 2001), "en", "text"), (["a", "b", "c"], ["T"], 2001, r(2001, 2003), "en", "text")),
        (2, (["a"], ["T"], 2000, None, "en", "text"), (["a"], ["U"], 2003, None, "de", "other")),
        (3, ([], [], None, None, None, "x"), ([], [], None, None, None, "x" * 9)),
    ]
    t = spark.createDataFrame(rows, f"id int, a {side}, b {side}")
    a, b = F.col("a"), F.col("b")
    got = {x.id: x for x in t.select("id", scores.match_score(a, b).alias("s"), scores.rule_match(a, b).alias("m"), scores.quick_exclude(a, b).alias("q")).collect()}
    assert (got[1].s, got[1].m, got[1].q) == (20 + 5 + 20 + 10 + 10, True, False)
    assert (got[2].s, got[2].m, got[2].q) == (10, True, True) and (got[3].m, got[3].q) == (False, True)


def test_vectors_never_match_nothing(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-2.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], None), (None, [1.0, 0.0], None)]
    t = spark.createDataFrame(rows, "a array<float>, b array<float>, e double")
    assert all(r.s == r.e for r in t.select(vectors.cosine_similarity(F.col("a"), F.col("b")).alias("s"), "e").collect())
    usable = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<float>")
    assert [r.x for r in usable.select(vectors.is_usable(F.col("v"), 2).alias("x")).collect()] == [True, False, False, False, False]


def test_decades_of_five_digits(spark):
    rows = spark.createDataFrame([(1, "9990s-10000s"), (2, "10000s"), (3, "1990s")], "id int, date_text string")
    got = {r.id: (r.date_info.start_year, r.date_info.end_year) for r in dates.normalise_dates(rows, "date_text").collect()}
    assert got == {1: (9990, 10009), 2: (10000, 10009), 3: (1990, 1999)}
