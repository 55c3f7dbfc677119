"""Votes: how often each text was read, and which stands for a track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_END, dedupe_lines_udf, merge_key, strip


def votes(rows: DataFrame) -> DataFrame:
    """(group, text, count, first_seen) of rows (group, text, ord)."""
    return rows.groupBy("group", "text").agg(F.count(F.lit(1)).alias("count"), F.min("ord").alias("first_seen"))


def representative(counted: DataFrame, share: float = 0.35) -> DataFrame:
    """(group, text): the text that stands for each group of votes.

    Texts are tidied and counted by key. The key with most votes wins, of equal
    ones the longer, then the first seen. Among keys that contain the winner and
    have at least two votes and ``share`` of the winner's, the longest takes its
    place, then the most frequent, then the first seen. Its most frequent text is shown.
    Groups without any key have no row.
    """
    # Few votes have several lines, and only those are searched for repeats.
    several = F.when(F.rlike("text", F.lit(LINE_END)), F.col("text"))
    tidy = counted.withColumn("text", F.coalesce(dedupe_lines_udf()(several), strip(F.col("text"))))
    tidy = tidy.withColumn("key", merge_key(F.col("text"))).filter("key <> ''")
    shown = tidy.groupBy("group", "key", "text").agg(F.sum("count").alias("n"), F.min("first_seen").alias("seen"))
    keys = shown.groupBy("group", "key").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    rank = F.struct(F.col("n"), F.length("key").alias("len"), (-F.col("seen")).alias("seen"), F.col("key"))
    best = keys.groupBy("group").agg(F.max(rank).alias("best"))
    rivals = keys.join(best, "group").filter(F.contains(F.col("key"), F.col("best.key")))
    strong = (F.col("key") == F.col("best.key")) | (F.col("n") >= F.greatest(F.lit(2.0), share * F.col("best.n")))
    by_length = F.struct(F.length("key").alias("len"), F.col("n"), (-F.col("seen")).alias("seen"), F.col("key"))
    chosen = rivals.filter(strong).groupBy("group").agg(F.max_by("key", by_length).alias("key"))
    order = F.struct(F.col("n"), (-F.col("seen")).alias("seen"), F.col("text"))
    return shown.join(chosen, ["group", "key"]).groupBy("group").agg(F.max_by("text", order).alias("text"))


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Order-preserving distinct: the first row of each key."""
    first = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
