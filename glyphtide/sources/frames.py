"""Frames: which ones a job needs, what part of each, and frame images from any file system.

Decoding video isn't part of this package; frames come as image files, one a
frame, and a decoder is any function that writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import frame_bound


def frame_spans(videos: DataFrame) -> DataFrame:
    """(stream, first, last, total, fps) of rows (stream, fps, frame_count, start_time, end_time).

    Times are cut to frames; a null end means all frames.
    """
    first = frame_bound(F.coalesce("start_time", F.lit(0.0)), F.col("fps"))
    last = F.when(F.col("end_time").isNull(), F.col("frame_count").cast("long")).otherwise(frame_bound(F.col("end_time"), F.col("fps")))
    return videos.select("stream", first.alias("first"), last.alias("last"), (last - first).alias("total"), "fps")


def working_area(full_screen: Column, x: Column, y: Column, width: Column, height: Column, frame_width: Column, frame_height: Column) -> Column:
    """Left, top, right, bottom (ends exclusive) of what is read of a frame."""
    crop = F.array(F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0)), F.least(x + width, frame_width), F.least(y + height, frame_height))
    return F.when(full_screen, F.array(F.lit(0), F.lit(0), frame_width, frame_height)).otherwise(crop)


def mask_area(full_screen: Column, x: Column, y: Column, width: Column, height: Column, frame_width: Column, frame_height: Column) -> Column:
    """The blacked-out part of a full-screen frame, clipped; null without one. A mask on a crop fails the query."""
    has = x.isNotNull() & y.isNotNull() & width.isNotNull() & height.isNotNull()
    box = F.array(F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0)), F.least(x + width, frame_width), F.least(y + height, frame_height))
    fine = has & (box[0] < box[2]) & (box[1] < box[3])
    return F.when(has & ~full_screen, F.raise_error(F.lit("a mask needs a full-screen frame")).cast("array<int>")).when(fine, box)


def image_frames(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """(stream, frame_number, image) of image files ``<stream>/<number>.<suffix>``, from a frame on.

    The number is taken from the path before contents are read, so earlier
    frames are skipped, not loaded.
    """
    files = spark.read.format("binaryFile").load(path)
    number = F.regexp_extract("path", r"([0-9]+)\.[^./]+$", 1).try_cast("bigint")
    named = files.select(F.element_at(F.split("path", "/"), -2).alias("stream"), number.alias("frame_number"), F.col("content").alias("image"))
    return named.filter(F.col("frame_number") > after)


def targets_found(targets: DataFrame, available: DataFrame) -> DataFrame:
    """(stream, saved, skipped): how many wanted frames there are to draw, and how many are missing."""
    have = available.select("stream", "frame_number").distinct().withColumn("_have", F.lit(1))
    met = targets.join(have, ["stream", "frame_number"], "left")
    return met.groupBy("stream").agg(F.count("_have").alias("saved"), F.count_if(F.col("_have").isNull()).alias("skipped"))
