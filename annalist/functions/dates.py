"""Imprecise dates: intervals, display forms, years for sorting, and parsing of date strings.

``d`` is always a ``date_info`` struct column (see ``annalist.schemas.DATE_INFO``). Spark's dates
cover years 1 to 9999; anything else, BCE included, stays a number and has no interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST_YEAR = 9999


def _set(value: Column) -> Column:
    """The number, where zero counts as missing."""
    return F.when(value != 0, value)


def ymd(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    inside = year.between(1, LAST_YEAR) & month.between(1, 12) & day.between(1, 31)
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(inside, F.try_to_date(text, "yyyy-MM-dd"))


def days_in(year: Column, month: Column) -> Column:
    return F.day(F.last_day(ymd(year, month, F.lit(1))))


def _once(value: Column, body) -> Column:
    """body(value) with the value computed once, which keeps large expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(**named: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in named.items()])


def to_date_range(d: Column) -> Column:
    """struct<start_date, end_date>: the days an imprecise date covers, null if it has none.

    A missing end falls back to the start. Years, months, seasons (three months where no end is
    given) and decades are widened to their last day; centuries and longer are not. A start
    after its end is swapped with it.
    """

    def filled(d: Column) -> Column:
        one = F.lit(1)
        return _parts(
            precision=d["precision"], y1=d["start_year"], m1=F.coalesce(_set(d["start_month"]), one), d1=F.coalesce(_set(d["start_day"]), one),
            y2=F.coalesce(_set(d["end_year"]), d["start_year"]), m2=_set(d["end_month"]), d2=_set(d["end_day"]),
            has_month=d["end_month"].isNotNull(), season_month=d["end_month"], has_day=d["end_day"].isNotNull(),
        )

    def ended(p: Column) -> Column:
        season = F.coalesce(p["season_month"], F.least(F.lit(12), p["m1"] + 2))
        month = (
            F.when(p["precision"].isin("year", "decade"), F.lit(12))
            .when(p["precision"] == "season", season)
            .otherwise(F.coalesce(p["m2"], p["m1"]))
        )
        return _parts(p=p, year=F.when(p["precision"] == "decade", p["y1"] + 9).otherwise(p["y2"]), month=month)

    def days(e: Column) -> Column:
        p = e["p"]
        to_last = p["precision"].isin("month", "season") | (~p["has_day"] & p["has_month"] & (e["month"] != p["m1"]))
        day = (
            F.when(to_last, days_in(e["year"], e["month"]))
            .when(p["precision"].isin("year", "decade"), F.lit(31))
            .otherwise(F.coalesce(p["d2"], p["d1"]))
        )
        valid = p["y1"].between(1, LAST_YEAR) & p["y2"].between(1, LAST_YEAR)
        return F.when(valid, _parts(a=ymd(p["y1"], p["m1"], p["d1"]), b=ymd(e["year"], e["month"], day)))

    def ordered(r: Column) -> Column:
        both = r["a"].isNotNull() & r["b"].isNotNull()
        return F.when(both, _parts(start_date=F.least(r["a"], r["b"]), end_date=F.greatest(r["a"], r["b"])))

    return _once(d, lambda x: _once(filled(x), lambda p: _once(ended(p), lambda e: _once(days(e), ordered))))


def display_start_date(d: Column) -> Column:
    """First day as the client shows it, null without a start year."""
    one = F.lit(1)
    return _once(d, lambda x: ymd(_set(x["start_year"]), F.coalesce(_set(x["start_month"]), one), F.coalesce(_set(x["start_day"]), one)))


def display_end_date(d: Column) -> Column:
    """Last day as the client shows it: it widens centuries and millennia too, but no seasons."""

    def filled(x: Column) -> Column:
        precision = x["precision"]
        span = F.when(precision == "decade", 9).when(precision == "century", 99).when(precision == "millennium", 999)
        return _parts(
            precision=precision, span=span, whole=span.isNotNull() | (precision == "year"), y1=_set(x["start_year"]),
            y2=F.coalesce(_set(x["end_year"]), _set(x["start_year"])), m2=F.coalesce(_set(x["end_month"]), _set(x["start_month"]), F.lit(1)),
            d2=F.coalesce(_set(x["end_day"]), _set(x["start_day"]), F.lit(1)), has_day=_set(x["end_day"]).isNotNull(),
        )

    def ended(p: Column) -> Column:
        return _parts(p=p, year=F.coalesce(p["y1"] + p["span"], p["y2"]), month=F.when(p["whole"], F.lit(12)).otherwise(p["m2"]))

    def shown(e: Column) -> Column:
        p = e["p"]
        last = (p["precision"] == "month") & ~p["has_day"]
        day = F.when(p["whole"], F.lit(31)).when(last, days_in(e["year"], e["month"])).otherwise(p["d2"])
        return F.when(p["y1"].isNotNull(), ymd(e["year"], e["month"], day))

    return _once(d, lambda x: _once(filled(x), lambda p: _once(ended(p), shown)))


def ranges_overlap(a: Column, b: Column) -> Column:
    return F.greatest(a["start_date"], b["start_date"]) <= F.least(a["end_date"], b["end_date"])


def contains_date(range_: Column, day: Column) -> Column:
    return day.between(range_["start_date"], range_["end_date"])


def is_single_day(range_: Column) -> Column:
    return range_["start_date"] == range_["end_date"]


def start_timestamp(d: Column) -> Column:
    """Midnight UTC of the first day; null without an interval."""
    return to_date_range(d)["start_date"].cast("timestamp")


def date_api_struct(d: Column) -> Column:
    r = to_date_range(d)
    return F.struct(
        r["start_date"].cast("string").alias("start_date_iso"),
        r["end_date"].cast("string").alias("end_date_iso"),
        d["original_text"].alias("display_text"),
        d["precision"].alias("precision"),
    )


def upgrade_date_info(info: Column, date_text: Column) -> Column:
    """A date_info struct from a map of strings; older layouts keep their text, of unknown precision."""
    number = lambda k: info[k].try_cast("int")
    current = F.lit(True)
    for key in ("original_text", "display_text", "precision", "is_bce"):
        current = current & F.array_contains(F.map_keys(info), key)
    text = F.coalesce(info["date_str"], F.nullif(date_text, F.lit("")), F.lit("unknown"))
    pick = lambda new, old: F.when(current, new).otherwise(old)
    parts = [f"{side}_{part}" for side in ("start", "end") for part in ("year", "month", "day")]
    return F.when(
        F.size(info) > 0,
        F.struct(
            pick(info["original_text"], text).alias("original_text"),
            pick(info["display_text"], text).alias("display_text"),
            pick(info["precision"], F.lit("unknown")).alias("precision"),
            *[F.when(current, number(p)).alias(p) for p in parts],
            pick(F.lower(info["is_bce"]) == "true", F.lit(False)).alias("is_bce"),
        ),
    )


def first_year_in(text: Column) -> Column:
    """The first four digits in a row, as a number."""
    return F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit("")).cast("int")


def event_year(d: Column, date_text: Column | None = None) -> Column:
    """Year of the interval; with a text also its first four digits, then 0."""
    year = F.year(to_date_range(d)["start_date"])
    if date_text is None:
        return year
    return F.coalesce(F.year(display_start_date(d)), first_year_in(date_text), F.lit(0))


def chronological_value(d: Column, date_text: Column) -> Column:
    """Signed year for sorting; BCE years are stored negative."""
    parsed = first_year_in(date_text)
    signed = F.when(F.coalesce(d["is_bce"], F.lit(False)), -parsed).otherwise(parsed)
    return F.coalesce(d["start_year"], signed, F.lit(0))


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(F.format_string("%.1f", value), r"\.0$", "")


def scaled_year(year: Column, is_bce: Column) -> Column:
    """A year with K, M or B from 10,000 up."""
    n = F.abs(year.cast("double"))
    text = (
        F.when(n >= 1e9, F.concat(F.format_string("%.1f", n / 1e9), F.lit("B")))
        .when(n >= 1e6, F.concat(F.format_string("%.0f", n / 1e6), F.lit("M")))
        .when(n >= 1e5, F.concat(F.round(n / 1000).cast("long").cast("string"), F.lit("K")))
        .when(n >= 1e4, F.concat(_trimmed(F.round(n / 100) / 10), F.lit("K")))
        .otherwise(n.cast("long").cast("string"))
    )
    return F.concat(text, F.when(F.coalesce(is_bce, F.lit(False)), F.lit(" BCE")).otherwise(F.lit("")))


def display_year(d: Column, date_text: Column) -> Column:
    """Short year of an event, else its display text, else what its date string gives."""
    year = F.coalesce(d["start_year"], d["end_year"])
    found = F.nullif(F.regexp_extract(date_text, r"(\d{4})", 1), F.lit("")).cast("int").cast("string")
    bce = F.when(F.coalesce(d["is_bce"], F.lit(False)), " BCE").otherwise("")
    short = F.regexp_replace(date_text, r"(?i)\b\d{1,2}:\d{2}:\d{2}\s*(am|pm)?\s*(EST|PST|UTC|GMT)?\s*(\([^)]+\))?\s*", "")
    short = F.trim(F.regexp_replace(F.regexp_replace(short, r"\([^)]+\)", ""), r"(?i)^on\s+", ""))
    much = (F.length(short) < F.length(date_text) * 0.6) & (F.length(short) > 0)
    own = F.when((d["display_text"] != "") & (d["display_text"] != date_text), d["display_text"])
    return F.coalesce(
        F.when(year.isNotNull(), scaled_year(year, d["is_bce"])),
        own,
        F.concat(found, bce),
        F.when(much, short),
        F.nullif(date_text, F.lit("")),
        F.lit("Unknown Date"),
    )


def parse_display_year(text: Column) -> Column:
    """The number behind display_year, for ordering."""
    pattern = r"^(\d+(?:\.\d+)?)\s*([KMB])?\s*(BCE)?$"
    scale = F.regexp_extract(text, pattern, 2)
    factor = F.when(scale == "K", 1e3).when(scale == "M", 1e6).when(scale == "B", 1e9).otherwise(1.0)
    value = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double") * factor
    digits = F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).cast("double")
    found = F.coalesce(value, digits, F.lit(0.0))
    return F.when(text.contains("BCE"), -found).otherwise(found)


def format_event_date(d: Column) -> Column:
    """Display text, else the start by precision, else the original text."""
    day = display_start_date(d)
    shown = (
        F.when(d["precision"] == "day", F.date_format(day, "MMMM d, yyyy"))
        .when(d["precision"] == "month", F.date_format(day, "MMMM yyyy"))
        .otherwise(F.year(day).cast("string"))
    )
    own = F.when(F.trim(d["display_text"]) != "", d["display_text"])
    return F.coalesce(own, shown, d["original_text"], F.lit(""))


def normalise_timestamp(text: Column) -> Column:
    """ISO text with ``+00:00`` as ``Z`` and at most three digits of a second."""
    zulu = F.regexp_replace(text, r"\+00:00Z?$", "Z")
    return F.nullif(F.regexp_replace(zulu, r"^([^.]*\.\d{3})\d+([^.]*)$", "$1$2"), F.lit(""))


def format_progress_time(text: Column) -> Column:
    shown = F.date_format(F.try_to_timestamp(normalise_timestamp(text)), "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(shown, F.lit("--:--:--"))


def combined_date_text(original: Column, enhanced: Column) -> Column:
    """``original(enhanced)``, or the original where nothing was added."""
    return F.when(enhanced != "", F.concat(original, F.lit("("), enhanced, F.lit(")"))).otherwise(original)


#: Month names and season months.
MONTHS = "january february march april may june july august september october november december".split()
SEASONS = {"spring": (3, 5), "summer": (6, 8), "autumn": (9, 11), "fall": (9, 11), "winter": (12, 2)}


def _month_number(name: Column) -> Column:
    low = F.lower(name)
    number = F.lit(None).cast("int")
    for k, month in enumerate(MONTHS, 1):
        number = F.when(F.substring(low, 1, 3) == month[:3], k).otherwise(number)
    return number


#: Days of named events (year, month, day). Names are patterns between word borders.
EVENTS = {
    "fall of the berlin wall": (1989, 11, 9), "meiji restoration": (1868, 1, 3), "battle of hastings": (1066, 10, 14), "fall of constantinople": (1453, 5, 29),
    "storming of the bastille": (1789, 7, 14), "battle of waterloo": (1815, 6, 18), "attack on pearl harbou?r": (1941, 12, 7), "d-day": (1944, 6, 6),
    "moon landing": (1969, 7, 20), "september 11 attacks": (2001, 9, 11),
}
#: Named eras and the span of traditions, first and last year. Names are patterns between word borders.
ERAS = {
    "heian": (794, 1185), "edo": (1603, 1868), "meiji": (1868, 1912), "taisho": (1912, 1926), "showa": (1926, 1989),
    "algonquin": (-1000, 1600), "greek myth(?:s|ology|ological)?": (-800, 600), "norse": (-200, 1300), "chinese folklore": (-2000, 1000),
    "african myth(?:s|ology|ological)?": (-3000, 1000), "san people": (-20000, 1500), "roman empire": (-27, 476), "middle ages": (500, 1500),
    "tang dynasty": (618, 907), "song dynasty": (960, 1279), "ming dynasty": (1368, 1644), "qing dynasty": (1644, 1912), "victorian": (1837, 1901),
    "(?:world war i|first world war)": (1914, 1918), "(?:world war ii|second world war)": (1939, 1945),
}
#: A name with one of these words is that of a place.
PLACES = "bay city coast county desert district forest hotel island islands lake lakes mountain mountains park province region river state town valley village".split()
#: The last days of eras that ended on a known day.
LAST_DAYS = {"heian": (1185, 4, 25), "edo": (1868, 1, 3), "meiji": (1912, 7, 30), "taisho": (1926, 12, 25), "showa": (1989, 1, 7)}
ORDINALS = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3, "fourth": 4, "4th": 4, "last": 4}
COUNTS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
SPANS = {"year": 1, "decade": 10, "century": 100, "centurie": 100, "millennium": 1000, "millennia": 1000}
THIRDS = {"early": 0, "mid": 1, "middle": 1, "late": 2}


def _looked_up(value: Column, values: dict) -> Column:
    found = F.lit(None).cast("int")
    for name, number in values.items():
        found = F.when(value == name, number).otherwise(found)
    return found


def thanksgiving(year: Column) -> Column:
    """The fourth Thursday of November."""
    first = F.make_date(year, F.lit(11), F.lit(1))
    return F.date_add(first, F.pmod(5 - F.dayofweek(first), F.lit(7)) + 21)


_ORDINAL = r"\d{1,2}(?:st|nd|rd|th)"
_MARK = r"\b(?:bce?|b\.c\.e?\.?|ce|ad|a\.d\.)(?:\b|$)"
_YEARS = r"\d{3,4}(?:0'?s|s)?(?:\s*(?:bce?|ce|ad))?"
#: The two ends of a range: in words, around a dash, or years around a hyphen.
RANGES = (
    r"^between\s+(.+?)\s+and\s+(.+)$",
    r"^(?:from\s+)?(.+?)(?:\s+-\s+|\s*[–—]\s*|\s+(?:to|until|till|through)\s+)(.+)$",
    rf"^({_YEARS})-({_YEARS})$",
)
_DAYS = r"^([a-z]+\s+)(\d{1,2})\s*[-–—]\s*(\d{1,2})((?:,|\s).*\d{3,4})$"


def range_ends(text: Column) -> Column:
    """The ends of a date range as an array of two texts; empty if it is none.

    What the first end leaves out it takes from the second: the year, ``century`` or ``millennium``, BC.
    """
    t = F.trim(F.lower(text))
    left, right = F.lit(""), F.lit("")
    for pattern in reversed(RANGES):
        left = F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)).otherwise(left)
        right = F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 2)).otherwise(right)
    part = lambda k: F.regexp_extract(t, _DAYS, k)
    left = F.when(t.rlike(_DAYS), F.concat(part(1), part(2), part(4))).otherwise(left)
    right = F.when(t.rlike(_DAYS), F.concat(part(1), part(3), part(4))).otherwise(right)
    size, year = F.regexp_extract(right, "(century|millennium)", 1), F.regexp_extract(right, r"(\d{3,4})\D*$", 1)
    mark = F.regexp_extract(right, r"\b(bce?)\b", 1)
    whole = (
        F.when(left.rlike(rf"^(?:the\s+)?{_ORDINAL}$") & (size != ""), F.concat(left, F.lit(" "), size, F.lit(" "), mark))
        .when(left.rlike(r"^[\d,]+$|century|millennium") & ~left.rlike(_MARK) & (mark != ""), F.concat(left, F.lit(" "), mark))
        .when(~left.rlike(rf"\d{{3,4}}|'\d\d|century|millennium|{_MARK}") & (year != ""), F.concat(left, F.lit(" "), year))
        .otherwise(left)
    )
    return F.when((left != "") & (right != ""), F.array(whole, right)).otherwise(F.array().cast("array<string>"))


def _joined(whole: Column, first: Column, second: Column) -> Column:
    """One date of the two ends of a range: years if it spans several, else months or days; periods of a kind stay so."""
    has_end = second["end_year"].isNotNull()
    end = [F.when(has_end, second[f"end_{p}"]).otherwise(second[f"start_{p}"]) for p in ("year", "month", "day")]
    long = first["precision"].isin("decade", "century", "millennium", "era") & (first["precision"] == second["precision"])
    same_year = first["start_year"] == end[0]
    same_month = same_year & (first["start_month"] == end[1])
    precision = (
        F.when(long, first["precision"])
        .when(same_month & first["start_day"].isNotNull() & end[2].isNotNull(), "day")
        .when(same_year & first["start_month"].isNotNull() & end[1].isNotNull(), "month")
        .otherwise("year")
    )
    return F.struct(
        whole["original_text"].alias("original_text"), whole["display_text"].alias("display_text"), precision.alias("precision"),
        *[first[f"start_{p}"].alias(f"start_{p}") for p in ("year", "month", "day")], *[e.alias(f"end_{p}") for e, p in zip(end, ("year", "month", "day"), strict=True)],
        first["is_bce"].alias("is_bce"),
    )


def parse_date_text(text: Column) -> Column:
    """date_info of a date string: of one date, or of a range whose ends are both read by the rules for one date.

    See ``parse_single_date`` for what is read. A range of which one end is not read is taken as a single date.
    """
    # the rules are in the plan once, as the body of a lambda over the text and its ends
    read = F.transform(F.concat(F.array(text), range_ends(text)), parse_single_date)

    def one(dates: Column) -> Column:
        ends = F.filter(F.slice(dates, 2, 2), lambda d: d["precision"] != "unknown")
        whole = F.get(dates, F.lit(0))
        return F.when(F.size(ends) == 2, _joined(whole, F.get(ends, F.lit(0)), F.get(ends, F.lit(1)))).otherwise(whole)

    return F.get(F.transform(F.array(read), one), F.lit(0))


def parse_single_date(text: Column) -> Column:
    """date_info of a date string; the first rule that matches wins, and what no rule reads is ``unknown``.

    Read are days, months, years, ranges, quarters, decades, centuries, millennia, seasons, holidays, the
    early, middle or late third of a month, year, decade or century, "before" a year, named events and
    what is so many years before or after one, the first and last day of an era, eras, and BCE. A third of a
    year is four months, of a month ten days or what is left of it, of a decade four, three and three
    years. Two-digit years behind an apostrophe are those from 1930 to 2029. Names of events and eras are
    whole words, and none beside a word for a place.
    """
    t = F.trim(F.lower(text))
    bce = t.rlike(r"\b(bce?|b\.c\.e?\.?)(\b|$)")
    name = "(" + "|".join(m[:3] + "[a-z]*" for m in MONTHS) + ")"
    third = r"\b(early|mid|middle|late)[\s-]+(?:of\s+)?(?:the\s+)?"
    null = F.lit(None).cast("int")

    def group(pattern: str, k: int) -> Column:
        return F.regexp_extract(t, pattern, k)

    def number(pattern: str, k: int) -> Column:
        return group(pattern, k).try_cast("int")

    def info(precision, y1, m1=None, d1=None, y2=None, m2=None, d2=None, era: Column | None = None) -> Column:
        part = lambda v: null if v is None else v.cast("int")
        signed = lambda v: null if v is None else (v if era is not None else F.when(bce, -F.abs(v)).otherwise(v)).cast("int")
        return F.struct(
            text.alias("original_text"), text.alias("display_text"), (F.lit(precision) if isinstance(precision, str) else precision).alias("precision"),
            signed(y1).alias("start_year"), part(m1).alias("start_month"), part(d1).alias("start_day"),
            signed(y2).alias("end_year"), part(m2).alias("end_month"), part(d2).alias("end_day"), (bce if era is None else era).alias("is_bce"),
        )

    def day(y: Column, m: Column, d: Column) -> Column:
        return info("day", y, m, d)

    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    mdy = rf"{name}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{3,4}})"
    dmy = rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{name},?\s+(\d{{3,4}})"
    my = rf"{name},?\s+(?:of\s+)?(\d{{3,4}})"
    span = r"^(?:from\s+|between\s+)?(\d{3,4})\s*(?:-|–|to|and|until)\s*(\d{3,4})\b"
    decade = r"(?<!\d)(\d{3,4})0'?s\b"
    century = r"(\d{1,2})(?:st|nd|rd|th)\s+century"
    millennium = r"(\d{1,2})(?:st|nd|rd|th)\s+millennium"
    season = r"(spring|summer|autumn|fall|winter)\s+(?:of\s+)?(\d{3,4}|'\d\d)\b"
    ym = r"^(\d{4})-(0?[1-9]|1[0-2])$"
    before = r"\b(?:before|prior to)\s+(\d{3,4})\b"
    bare = r"(\d{1,4})\s*(?:bce?|b\.c\.|ce|ad|a\.d\.)|(\d{4})|^(?:c\.|ca\.|circa|about|around|after|in)?\s*(\d{3,4})$"
    short_quarter, long_quarter = r"\bq([1-4])\s+(?:of\s+)?(\d{4})", rf"\b({'|'.join(ORDINALS)})\s+quarter\s+(?:of\s+)?(\d{{4}})"
    holiday_week, holiday = r"\bweek of thanksgiving\D{0,5}(\d{4})", r"\bthanksgiving\D{0,9}(\d{4})"
    christmas_season, christmas = r"\bchristmas season\D{0,5}(\d{4})", r"\bchristmas(?: day| eve)?\D{0,5}(\d{4})"
    relative = rf"\b(\d+|{'|'.join(COUNTS)})\s+({'|'.join(SPANS)})s?\s+(after|before)\b"
    third_month, third_year = rf"{third}{name},?\s+(?:of\s+)?(\d{{3,4}})", rf"{third}(\d{{4}})$"
    third_decade, third_century = third + decade, third + century

    which = group(season, 1)
    season_year = F.when(group(season, 2).startswith("'"), F.pmod(F.substring(group(season, 2), 2, 2).try_cast("int") - 30, F.lit(100)) + 1930).otherwise(number(season, 2))
    first, last = _looked_up(which, {k: v[0] for k, v in SEASONS.items()}), _looked_up(which, {k: v[1] for k, v in SEASONS.items()})
    quarter = F.coalesce(number(short_quarter, 1), _looked_up(group(long_quarter, 1), ORDINALS))
    quarter_year = F.coalesce(number(short_quarter, 2), number(long_quarter, 2))

    def third_of(pattern: str) -> Column:
        return _looked_up(group(pattern, 1), THIRDS)

    def years(n: Column, size: int, precision: str) -> Column:
        # N-th before: from the far end to the near one
        return F.when(bce, info(precision, n * size, y2=(n - 1) * size + 1)).otherwise(info(precision, (n - 1) * size + 1, y2=n * size))

    def day_in(pattern: str) -> Column:
        k, y, m = third_of(pattern), number(pattern, 3), _month_number(group(pattern, 2))
        end = F.when(k == 2, F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))).otherwise(10 * k + 10)
        return info("day", y, m, 10 * k + 1, y, m, end)

    def years_in(pattern: str) -> Column:
        """A third of a decade: four years, three and three."""
        k, y = third_of(pattern), number(pattern, 2) * 10
        return info("year", y + F.when(k > 0, 3 * k + 1).otherwise(0), y2=y + 3 * k + 3)

    def century_in(pattern: str) -> Column:
        k, n = third_of(pattern), number(pattern, 2)
        a, z = F.element_at(F.array(*map(F.lit, (1, 34, 67))), k + 1), F.element_at(F.array(*map(F.lit, (33, 66, 100))), k + 1)
        before_christ = info("year", n * 100 - a + 1, y2=n * 100 - z + 1)
        return F.when(bce, before_christ).otherwise(info("year", (n - 1) * 100 + a, y2=(n - 1) * 100 + z))

    place = t.rlike(rf"\b(?:{'|'.join(PLACES)})\b")

    def named(pattern: str) -> Column:
        return t.rlike(rf"\b{pattern}\b") & ~place

    moment, era, last_day = F.lit(None), F.lit(None), F.lit(None)
    kind = "struct<y:int,m:int,d:int>"
    triple = lambda v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, "ymd", strict=True)]).cast(kind)
    moment, last_day = moment.cast(kind), last_day.cast(kind)
    era = era.cast("struct<a:int,z:int>")
    for word, value in EVENTS.items():
        moment = F.when(named(word), triple(value)).otherwise(moment)
    for word, value in LAST_DAYS.items():
        last_day = F.when(named(word), triple(value)).otherwise(last_day)
    for word, value in ERAS.items():
        era = F.when(named(word), F.struct(F.lit(value[0]).alias("a"), F.lit(value[1]).alias("z")).cast("struct<a:int,z:int>")).otherwise(era)
    amount = F.coalesce(number(relative, 1), _looked_up(group(relative, 1), COUNTS)) * _looked_up(group(relative, 2), SPANS)
    away = moment["y"] + F.when(group(relative, 3) == "after", amount).otherwise(-amount)
    week = thanksgiving(number(holiday_week, 1))
    week_start, week_end = F.date_sub(week, 4), F.date_add(week, 2)
    thursday = thanksgiving(number(holiday, 1))
    christmas_day = F.when(t.contains("christmas eve"), 24).otherwise(25)

    year = F.coalesce(number(bare, 1), number(bare, 2), number(bare, 3))
    return (
        F.when(t.rlike(iso), day(number(iso, 1), number(iso, 2), number(iso, 3)))
        .when(t.rlike(mdy), day(number(mdy, 3), _month_number(group(mdy, 1)), number(mdy, 2)))
        .when(t.rlike(dmy), day(number(dmy, 3), _month_number(group(dmy, 2)), number(dmy, 1)))
        .when(t.rlike(relative) & moment.isNotNull(), info("year", away))
        .when(t.rlike(holiday_week), info("day", F.year(week_start), F.month(week_start), F.dayofmonth(week_start), F.year(week_end), F.month(week_end), F.dayofmonth(week_end)))
        .when(t.rlike(holiday), day(number(holiday, 1), F.lit(11), F.dayofmonth(thursday)))
        .when(t.rlike(christmas_season), info("season", number(christmas_season, 1), F.lit(12), None, number(christmas_season, 1), F.lit(12)))
        .when(t.rlike(christmas), day(number(christmas, 1), F.lit(12), christmas_day))
        .when(quarter.isNotNull() & quarter_year.isNotNull(), info("month", quarter_year, 3 * quarter - 2, None, quarter_year, 3 * quarter))
        .when(t.rlike(season), info("season", season_year, first, None, season_year + (which == "winter").cast("int"), last))
        .when(t.rlike(third_month), day_in(third_month))
        .when(t.rlike(third_decade), years_in(third_decade))
        .when(t.rlike(third_century), century_in(third_century))
        .when(t.rlike(third_year), info("month", number(third_year, 2), 4 * third_of(third_year) + 1, None, number(third_year, 2), 4 * third_of(third_year) + 4))
        .when(t.rlike(my), info("month", number(my, 2), _month_number(group(my, 1))))
        .when(t.rlike(ym), info("month", number(ym, 1), number(ym, 2)))
        .when(t.rlike(century), years(number(century, 1), 100, "century"))
        .when(t.rlike(millennium), years(number(millennium, 1), 1000, "millennium"))
        .when(t.rlike(decade), info("decade", number(decade, 1) * 10, y2=number(decade, 1) * 10 + 9))
        .when(t.rlike(span), info("year", number(span, 1), y2=number(span, 2)))
        .when(t.rlike(before), info("year", None, y2=number(before, 1)))
        .when(year.isNotNull(), info("year", year))
        .when(moment.isNotNull(), day(moment["y"], moment["m"], moment["d"]))
        .when(t.rlike(r"\b(last day|end) of\b") & last_day.isNotNull(), day(last_day["y"], last_day["m"], last_day["d"]))
        .when(era.isNotNull(), info("era", era["a"], y2=era["z"], era=era["a"] < 0))
        .otherwise(info("unknown", None))
    )


def normalise_dates(df: DataFrame, column: str, into: str = "date_info") -> DataFrame:
    """Adds the parsed date of a text column; each distinct text is parsed once."""
    parsed = df.select(column).distinct().filter(F.col(column).isNotNull()).withColumn(into, parse_date_text(F.col(column)))
    return df.join(parsed.hint("merge"), column, "left")
