"""URL filters: fixed host/path rules first, then rules mined by FP-growth.

Token combinations of labelled urls that go with bad labels are mined with Spark's FP-growth,
pruned by support, confidence and redundancy, and matched through an inverted index that holds
each rule once, under its rarest token. A url meets only the rules whose rarest token it has.

Native: DataFrame functions and pyspark.ml only.

Defined results. Null url or one without ``://``: empty host and path, no tokens, no base rule;
such rows are allowed. Null page_id and repeated rows pass through one by one. No labels: no
mined rules. Urls that repeat are judged once per distinct url after map-side aggregation; the rows of
a hot url meet a broadcast answer. Very long urls are matched whole. Empty table: no rows. Other
columns are kept.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import join_groups, spool

#: (verdict, host, path prefix); a rule fits its host and all subdomains, the longest one wins.
BASE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.5
#: An index of at most so many rules is sent to every executor; a larger one is joined by shuffle.
BROADCAST_RULES = 20_000
BAD = "label=bad"


def host_of(url: Column) -> Column:
    return F.coalesce(
        F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        F.lit(""),
    )


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def base_rule(host: Column, path: Column, rules=BASE_RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does."""
    fits = []
    for verdict, h, p in rules:
        ok = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(
            F.when(ok, F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
        )
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path words (digits as one class), query keys, fragment."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"^(?s:.*?)://[^#]*#(.*)$", 1)

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))

    found = F.concat(
        tagged("scheme=", F.array(F.lower(F.regexp_extract(url, r"^((?s:.*?))://", 1)))),
        tagged("host=", F.split(host, r"\.")),
        tagged("path=", F.split(F.regexp_replace(F.lower(path), r"\d+", "0"), r"[/.]+")),
        tagged("query=", F.transform(F.split(F.lower(query), "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))),
        tagged("fragment=", F.array(F.lower(fragment))),
    )
    return F.coalesce(F.array_distinct(F.when(url.contains("://"), found)), F.array().cast("array<string>"))


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Rules (tokens, confidence, n_rule, n_bad, index_token) from rows (url, bad).

    A rule is dropped if a rule on a subset of its tokens is at least as confident.
    """
    spark = labelled.sparkSession
    # floor: a combination seen once is no rule, however few labels there are
    baskets = labelled.filter("bad is not null and url is not null").select(
        F.concat(tokens_of(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")
    )
    total = baskets.count()
    empty = "tokens array<string>, confidence double, n_rule long, n_bad long, index_token string"
    if total == 0:
        return spark.createDataFrame([], empty)
    least = max(3, int(-(-min_support * total // 1)))
    sets = FPGrowth(itemsCol="items", minSupport=least / total * (1 - 1e-12), minConfidence=1.0).fit(baskets).freqItemsets
    sets = sets.select(F.sort_array("items").alias("items"), "freq")
    with_bad = sets.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(
        F.array_remove("items", BAD).alias("items"), F.col("freq").alias("n_bad")
    )
    rules = (
        with_bad.join(sets.withColumnRenamed("freq", "n_rule").hint("merge"), "items")
        .select(F.col("items").alias("tokens"), (F.col("n_bad") / F.col("n_rule")).alias("confidence"), "n_rule", "n_bad")
        .filter(F.col("confidence") >= min_confidence)
    )
    single = sets.filter((F.size("items") == 1) & (F.col("items")[0] != BAD)).select(
        F.col("items")[0].alias("token"), F.col("freq").alias("n_token")
    )
    spread = rules.select("*", F.explode("tokens").alias("token")).join(single.hint("merge"), "token")
    rarest = F.min(F.struct("n_token", "token"))["token"].alias("index_token")
    indexed = spread.groupBy("tokens", "confidence", "n_rule", "n_bad").agg(rarest)
    small = indexed.select(F.col("tokens").alias("s_tokens"), F.col("confidence").alias("s_confidence"), F.col("index_token").alias("token"))
    redundant = (
        indexed.select("tokens", "confidence", F.explode("tokens").alias("token"))
        .join(small.hint("merge"), "token")
        .filter("size(s_tokens) < size(tokens) and s_confidence >= confidence and size(array_except(s_tokens, tokens)) = 0")
        .select("tokens")
        .distinct()
    )
    return indexed.join(redundant.hint("merge"), "tokens", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_rule, mined_confidence) of the urls that some rule matches; the surest rule wins."""
    index = rules.select(F.col("tokens").alias("rule"), "confidence", F.col("index_token").alias("token"))
    index = F.broadcast(index) if index.count() <= BROADCAST_RULES else index.hint("merge")
    return (
        urls.select("url", tokens_of(F.col("url")).alias("has"))
        .select("url", "has", F.explode("has").alias("token"))
        .join(index, "token")
        .filter(F.size(F.array_except("rule", "has")) == 0)
        .groupBy("url")
        .agg(F.max(F.struct("confidence", F.array_join("rule", " ").alias("rule"))).alias("best"))
        .select("url", F.col("best.rule").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"))
    )


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds host, path, rule, verdict, mined_rule, mined_confidence to rows with a url."""
    base = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    base = base.withColumn("_base", base_rule(F.col("host"), F.col("path")))
    # each distinct url is matched once; its rows, which may be a third of all, get the answer back
    urls = spool(pages.filter("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n")), "urls")
    answers = spool(urls.join(match_rules(urls, rules).hint("merge"), "url", "left"), "matched-urls")
    none = {"mined_rule": F.lit(None).cast("string"), "mined_confidence": F.lit(None).cast("double")}
    found = join_groups(base.filter("url is not null"), answers, ["url"]).unionByName(base.filter("url is null").withColumns(none))
    return found.withColumns(
        {
            "rule": F.col("_base.rule"),
            "verdict": F.coalesce(F.col("_base.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")),
        }
    ).drop("_base")
