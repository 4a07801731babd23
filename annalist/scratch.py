"""Scratch tables that survive lost executors, and connected components built on them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Without it a session of one machine gets a folder made here, and a cluster an error: what its
    executors wrote to folders of their own would be lost.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spool(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage for good."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A group of more than one part in so many of all rows is hot; there are fewer than so many of them.
HOT_SHARE = 1000
#: Words of more than one part in so many of all are frequent; there are fewer than so many, so they fit into every task.
FREQUENT_SHARE = 200_000
#: Rows of a small table that are sent to all tasks at most, behind a count.
BROADCAST_ROWS = 100_000


def sent(rows: DataFrame) -> DataFrame:
    """Rows for a join: sent to all tasks if they are few, so that the other side isn't shuffled, else merged."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows.hint("merge")


def join_groups(rows: DataFrame, groups: DataFrame, by: list[str], how: str = "inner", share: int = HOT_SHARE) -> DataFrame:
    """Joins rows with one row a group, however many rows a group has; drops its column ``n``.

    groups holds the number of rows of each group as ``n`` and should be a written table. The rows of hot
    groups, fewer than ``share`` by their definition, meet a broadcast copy of them; all others are
    merged by key.
    """
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * share > F.lit(total)
    hot = F.broadcast(groups.filter(is_hot).drop("n"))
    rest = groups.filter(~is_hot).drop("n")
    return rows.join(hot, by).unionByName(rows.join(hot.select(*by), by, "left_anti").join(rest.hint("merge"), by, how))


def running_sum(rows: DataFrame, order: list[Column], value: str, into: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one, in a total order: range by range instead of in one task."""
    ordered = spool(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ordered.groupBy("_part").agg(F.sum(value).alias("_sum"))  # a row a partition
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    offsets = sums.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    added = ordered.withColumn(into, inside).join(offsets.hint("merge"), "_part")
    return added.withColumn(into, F.col(into) + F.col("_before")).drop("_part", "_before")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component = smallest id.

    Alternates the two star operations of Kiveris et al. (2014) on written tables until nothing changes,
    which takes a number of rounds in the square of the logarithm of the nodes at most. A hub is
    aggregated by min() and its links are spread over tasks, so no component is gathered in one.
    """

    def hang(links: DataFrame, only_larger: bool) -> DataFrame:
        """Hangs each neighbour of a below the smallest of a and its neighbours."""
        low = spool(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.lit(1)).alias("n")), "lows")
        hung = join_groups(links, low, ["a"])
        if only_larger:
            hung = hung.filter("b > a")
        hung = hung.select(F.col("b").alias("a"), F.col("low").alias("b"))
        if not only_larger:
            hung = hung.union(low.select("a", F.col("low").alias("b")))
        return hung.filter("a <> b").distinct()

    def settled(links: DataFrame) -> bool:
        """Every node hangs below one root, and no root hangs below another node."""
        up = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        down = links.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        ends = up.union(down).groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return ends.filter("up > 1 or (up > 0 and down > 0)").isEmpty()

    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = spool(ordered.filter("a <> b").distinct(), "edges")
    while not settled(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        grown = spool(hang(both, only_larger=True), "large-star")
        down = grown.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = spool(hang(down, only_larger=False), "small-star")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
