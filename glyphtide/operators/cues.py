"""Cue metrics, lookup by time, and subtitle files."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import srt_timestamp, text_lines


def metrics(cues: DataFrame, by: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Count, total, mean, shortest and longest duration (3 digits), and cues of several lines."""
    length = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    rounded = lambda c: F.bround(F.coalesce(c, F.lit(0.0)), 3)
    shown = [F.count(F.lit(1)).alias("count"), rounded(F.sum(length)).alias("total_sec"), rounded(F.avg(length)).alias("mean_sec"), rounded(F.min(length)).alias("min_sec"), rounded(F.max(length)).alias("max_sec")]
    lines = F.size(F.filter(text_lines(F.col("text")), lambda x: F.trim(x) != ""))
    return cues.groupBy(*by).agg(*shown, F.count_if(lines > 1).alias("multi_line"))


def active_at(points: DataFrame, cues: DataFrame, slack: float = 0.001, width: float = 60.0) -> DataFrame:
    """(stream, t, text): the texts of the cues at each time, joined in cue order.

    Cues are dealt to buckets of ``width`` seconds, each to as many as it covers,
    so the range join is an equality join; points between cues have no row. A cue
    and its slack cover few buckets if the width is about the usual duration.
    """
    bucket = lambda t: F.floor(t / width).cast("long")
    dealt = cues.withColumn("_b", F.explode(F.sequence(bucket(F.col("start") - slack), bucket(F.greatest(F.col("start"), F.col("end")) + slack))))
    asked = points.select("stream", "t").distinct().withColumn("_b", bucket(F.col("t")))
    hit = asked.join(dealt, ["stream", "_b"]).filter((F.col("t") + slack >= F.col("start")) & (F.col("t") <= F.col("end") + slack))
    texts = F.array_sort(F.collect_list(F.struct("start", "end", "text")))
    return hit.groupBy("stream", "t").agg(F.array_join(texts["text"], "\n").alias("text"))


def srt_blocks(cues: DataFrame) -> DataFrame:
    """Add ``block`` to numbered cues: number, times and text, each line ended."""
    times = F.concat(srt_timestamp(F.col("start")), F.lit(" --> "), srt_timestamp(F.col("end")))
    return cues.withColumn("block", F.concat(F.col("index").cast("string"), F.lit("\n"), times, F.lit("\n"), F.col("text"), F.lit("\n")))


def srt_text(cues: DataFrame) -> DataFrame:
    """(stream, srt): the subtitle file of each stream, blocks parted by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "block")))
    return srt_blocks(cues).groupBy("stream").agg(F.array_join(ordered["block"], "\n").alias("srt"))


def write_srt(cues: DataFrame, path: str, languages: DataFrame | None = None, streams: DataFrame | None = None) -> None:
    """Write each stream's file ``stream.language.srt`` (``un`` if unknown) into the folder ``path``.

    Files end as the text of ``srt_text`` does, byte by byte. Streams of ``streams``
    without a cue get an empty file. Spark writes the files beside their place,
    and the driver, which sees their names alone, moves them.
    """
    spark = cues.sparkSession
    texts = srt_text(cues)
    if streams is not None:
        texts = streams.select("stream").distinct().join(texts, "stream", "left")
    if languages is not None:
        texts = texts.join(languages, "stream", "left")
    language = F.coalesce("language", F.lit("un")) if languages is not None else F.lit("un")
    named = texts.select(F.concat(F.col("stream").cast("string"), F.lit("."), language, F.lit(".srt")).alias("name"), (F.coalesce(F.length("srt"), F.lit(0)) == 0).alias("hollow"), F.regexp_replace(F.coalesce("srt", F.lit("")), r"\n\z", "").alias("srt"))
    made = f"{path.rstrip('/')}/_made-{uuid.uuid4().hex}"
    # The writer ends each row with a line end, which is the text's own last one.
    named.write.option("lineSep", "\n").partitionBy("name", "hollow").text(made)
    jvm = spark.sparkContext._jvm
    place = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    fs = place(made).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(place(made, "name=*", "hollow=*", "part-*")) or []
    for part in found:
        source = part.getPath()
        name = unquote(source.getParent().getParent().getName().removeprefix("name="))
        target = jvm.org.apache.hadoop.fs.Path(place(path), name)
        fs.delete(target, False)
        if source.getParent().getName() == "hollow=true":
            fs.create(target).close()
        else:
            fs.rename(source, target)
    fs.delete(place(made), True)


def languages(cues: DataFrame, detect, most: int = 100) -> DataFrame:
    """(stream, language): the commonest code among a stream's first texts.

    ``detect`` maps a text column to a code, or null where it can't tell. Ties go to
    the smallest code, and a stream without codes has ``un``.
    """
    codes = cues.filter(F.col("index") <= most).select("stream", detect(F.col("text")).alias("code"))
    counted = codes.groupBy("stream", "code").agg(F.count("code").alias("n"))
    best = counted.groupBy("stream").agg(F.min_by("code", F.struct((-F.col("n")).alias("n"), F.col("code"))).alias("code"))
    return best.select("stream", F.coalesce("code", F.lit("un")).alias("language"))
