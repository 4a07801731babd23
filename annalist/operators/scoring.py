"""Model calls as batch scorers: a table of results by key, or a function over batches of rows.

Each scorer sees distinct keys only, and has a default that needs no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.scores import rule_match
from annalist.operators.pairs import with_sides
from annalist.operators.search import terms
from annalist.scratch import BROADCAST_ROWS, FREQUENT_SHARE, join_groups, spool

BatchScorer = Callable[[pd.DataFrame], pd.Series]


def score_rows(rows: DataFrame, keys: list[str], scorer: BatchScorer, batch: int = 50, into: str = "score") -> DataFrame:
    """(keys, score) of the distinct rows, by a function of batches.

    A batch that fails is tried row by row; a row that fails has a null score.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    got = list(scorer(part))
                    if len(got) != len(part):
                        raise ValueError("a score a row is needed")
                except Exception:
                    got = []
                    for k in range(len(part)):
                        try:
                            got.append(float(next(iter(scorer(part.iloc[k : k + 1])))))
                        except Exception:
                            got.append(None)
                yield part.assign(**{into: pd.Series(got, index=part.index, dtype="float64")})

    return rows.select(*keys).distinct().mapInPandas(run, f"{fields}, `{into}` double")


def lexical_scores(items: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic_id, item_id, score): the share of a topic's distinct words that an item holds.

    items: topic_id, item_id, text; topics: topic_id, topic_text. A topic without words gives 1.
    """
    asked = topics.select("topic_id", F.array_distinct(terms(F.col("topic_text"))).alias("wanted"))
    joined = items.join(asked.hint("merge"), "topic_id")
    share = F.size(F.array_intersect("wanted", terms(F.col("text")))) / F.size("wanted")
    return joined.select("topic_id", "item_id", F.when(F.size("wanted") == 0, 1.0).otherwise(share).alias("score"))


def tfidf_scores(items: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic_id, item_id, score): the cosine of an item and its topic, as vectors of tf x idf of their words.

    The default of the event and article scorers. items: topic_id, item_id, text, of which rows of one topic
    and item make one text; topics: topic_id, topic_text, a row each. idf is 1 + ln((1 + n) / (1 + df)) over the
    n items. Items of no topic go; an item or topic without words scores 0. Scores have nine digits.

    Words are counted item by item before they meet frequencies and topics. Frequent words, and those of a
    topic with most of the items, are spread by ``join_groups``. Up to ``BROADCAST_ROWS`` topics, or words of topics, are sent
    to all tasks, so that no text and no count is sent to the task of its topic.
    """
    some = spool(topics.select("topic_id").distinct(), "topic-ids")
    if some.count() <= BROADCAST_ROWS:
        own = items.join(F.broadcast(some), "topic_id", "left_semi")
    else:
        sizes = items.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).join(some.hint("merge"), "topic_id")
        own = join_groups(items, spool(sizes, "topic-sizes"), ["topic_id"])
    words = own.select("topic_id", "item_id", F.explode_outer(terms(F.col("text"))).alias("term"))
    tf = spool(words.groupBy("topic_id", "item_id", "term").agg(F.count(F.lit(1)).alias("tf")), "item-words")
    n = tf.select("topic_id", "item_id").distinct().count()
    held = spool(tf.filter("term is not null").groupBy("topic_id", "term").agg(F.count(F.lit(1)).alias("n")), "topic-words")
    df = spool(held.groupBy("term").agg(F.sum("n").alias("df"), F.sum("n").alias("n")), "word-frequencies")
    idf = 1 + F.log((F.lit(1.0) + F.lit(n)) / (1 + F.coalesce("df", F.lit(0))))

    asked = topics.select("topic_id", F.explode(terms(F.col("topic_text"))).alias("term")).groupBy("topic_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = spool(asked.join(df.select("term", "df").hint("merge"), "term", "left").select("topic_id", "term", (F.col("tf") * idf).alias("w")), "topic-weights")
    length = weighed.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    wanted = weighed.join(length.hint("merge"), "topic_id").join(held.hint("merge"), ["topic_id", "term"])
    wanted = spool(wanted.select("topic_id", "term", "n", (F.col("w") / F.col("length")).alias("wanted")), "topic-vectors")

    weights = join_groups(tf, df, ["term"], "left", FREQUENT_SHARE).withColumn("w", F.col("tf") * idf).drop("df", "tf")
    if wanted.count() <= BROADCAST_ROWS:
        met = weights.join(F.broadcast(wanted.drop("n")), ["topic_id", "term"], "left")
    else:
        met = join_groups(weights, wanted, ["topic_id", "term"], "left")
    met = met.withColumn("w", F.when(F.col("term").isNotNull(), F.col("w")))
    dot, square = F.sum(F.col("w") * F.col("wanted")), F.sum(F.col("w") * F.col("w"))
    cosine = F.round(F.coalesce(F.try_divide(dot, F.sqrt(square)), F.lit(0.0)), 9)
    return met.groupBy("topic_id", "item_id").agg(cosine.alias("score"))


def rule_verifier(events: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The default pair verifier: pairs that match by rule."""

    def verify(pairs: DataFrame) -> DataFrame:
        return with_sides(pairs, events).filter(rule_match(F.col("x"), F.col("y"))).select("a", "b")

    return verify


def scored_verifier(answers: DataFrame, least: float = 0.75) -> Callable[[DataFrame], DataFrame]:
    """A verifier over stored answers (a, b, is_same, confidence), whatever the order of the pair."""
    key = lambda: [F.least("a", "b").alias("k1"), F.greatest("a", "b").alias("k2")]
    yes = answers.filter(F.col("is_same") & (F.col("confidence") >= least)).select(*key()).distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b", *key()).join(yes.hint("merge"), ["k1", "k2"], "left_semi").select("a", "b")

    return verify


def encode_texts(rows: DataFrame, text: str, into: str = "vector", dimension: int = 64) -> DataFrame:
    """Adds unit vectors of hashed word counts; each distinct text is encoded once.

    Texts without words have a null vector.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = []
            for t in frame[text]:
                v = np.zeros(dimension, np.float32)
                for w in t.lower().split():
                    h = xxhash.xxh3_64_intdigest(w)
                    v[h % dimension] += 1.0 if h >> 63 else -1.0
                size = float(np.linalg.norm(v))
                vectors.append(None if size == 0 else (v / size).tolist())
            yield pd.DataFrame({text: frame[text], into: vectors})

    distinct = rows.select(text).filter(F.col(text).isNotNull()).distinct()
    encoded = distinct.mapInPandas(run, f"`{text}` string, `{into}` array<float>")
    return rows.join(encoded.hint("merge"), text, "left")
