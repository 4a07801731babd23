"""Texts of events, queries and articles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def embedding_text(description: Column, date_text: Column, entities: Column, snippet: Column) -> Column:
    """``description | Date: .. | Entities: name (type), .. | Context: ..``, without empty parts.

    entities: array of structs with name and type. The context is the first 200 characters.
    """
    names = F.transform(
        F.filter(F.coalesce(entities, F.array().cast("array<struct<name:string,type:string>>")), lambda e: F.trim(e["name"]) != ""),
        lambda e: F.concat(
            F.trim(e["name"]),
            F.when(F.trim(F.coalesce(e["type"], F.lit(""))) != "", F.concat(F.lit(" ("), F.trim(e["type"]), F.lit(")"))).otherwise(""),
        ),
    )
    given = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(
        " | ",
        given(description),
        F.concat(F.lit("Date: "), given(date_text)),
        F.when(F.size(names) > 0, F.concat(F.lit("Entities: "), F.array_join(names, ", "))),
        F.concat(F.lit("Context: "), F.substring(given(snippet), 1, 200)),
    )


def event_signature(document_id: Column, description: Column, date_text: Column) -> Column:
    """SHA-256 of document, description and date, joined by ``-``."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (document_id, description, date_text)]
    return F.sha2(F.concat_ws("-", *parts), 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8)


def escape_query(query: Column, fallback: str = "search") -> Column:
    """A search query without operators, quotes and double spaces; a fallback word if none is left."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(query, r"""[():"'\\]""", " "), r"\s+", " "))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def search_text(original: Column, language: Column, translated: Column, keywords: Column) -> Column:
    """What to search an English corpus for: the text if English, its translation, keywords, the text."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    joined = given(F.array_join(keywords, ", "))
    return F.when(F.lower(language) == "en", original).otherwise(F.coalesce(given(translated), joined, original))


def disambiguation_options(extract: Column) -> Column:
    """Up to ten titles, each under 100 characters, from the bullet lines of an extract."""
    lines = F.filter(F.split(extract, "\n"), lambda x: x.startswith("*"))
    titles = F.transform(
        lines, lambda x: F.trim(F.split_part(F.split_part(F.regexp_replace(x, r"^[* ]+", ""), F.lit(","), F.lit(1)), F.lit(" – "), F.lit(1)))
    )
    return F.slice(F.filter(titles, lambda x: (x != "") & (F.length(x) < 100)), 1, 10)


def keyword_limit(article_limit: Column) -> Column:
    """Keywords for a number of articles: up to 3 for 5, half up to 6 for 10, else 10; 2 at least."""
    n = (
        F.when(article_limit <= 5, F.least(article_limit, F.lit(3)))
        .when(article_limit <= 10, F.least(F.floor(article_limit / 2).cast("int"), F.lit(6)))
        .otherwise(F.lit(10))
    )
    return F.least(F.lit(10), F.greatest(n, F.lit(2))).cast("int")


def keyword_plan(original: Column, english: Column, article_limit: Column) -> Column:
    """struct<strategy, n, original, english>: lists of different length are both emptied."""
    n = keyword_limit(article_limit)
    none = F.array().cast("array<string>")
    even = F.size(original) == F.size(english)
    cut = lambda c: F.when(even, F.slice(c, F.lit(1), n)).otherwise(none)
    strategy = F.when(article_limit <= 5, "focused").when(article_limit <= 10, "balanced").otherwise("comprehensive")
    return F.struct(strategy.alias("strategy"), n.alias("n"), cut(original).alias("original"), cut(english).alias("english"))


def shortened(text: Column, limit: int, mark: str = "…") -> Column:
    """The text, cut at the limit with a mark."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def article_preview(text: Column) -> Column:
    return shortened(text, 1500)


def article_extract(text: Column) -> Column:
    return F.substring(text, 1, 500)


def title_preview(title: Column) -> Column:
    return shortened(title, 50)


def format_progress(steps: Column) -> Column:
    """Progress rows (step_name, event_timestamp, message) as messages for the client."""
    return F.transform(
        steps,
        lambda s: F.struct(
            s["message"].alias("message"), s["step_name"].alias("step"),
            F.date_format(s["event_timestamp"], "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("event_timestamp"),
        ),
    )
