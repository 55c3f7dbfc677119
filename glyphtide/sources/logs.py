"""Files: frame logs with line numbers, folder listings, and the newest of several results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import casefold

STEM = r"([^/]+?)(?:\.[^./]*)?$"


def log_lines(spark: SparkSession, path: str, missing_ok: bool = True) -> DataFrame:
    """(stream, line_no, value) of all log files below a path; the stream is the file's stem.

    A log is one file of one video and is read whole, so its line numbers don't
    depend on splits; files are spread over tasks. A missing path gives no rows,
    or is an error if ``missing_ok`` is false.
    """
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], "stream string, line_no int, value string")
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), STEM, 1).alias("stream"), "value")
    return whole.select("stream", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value")).filter("trim(value) <> ''")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def write_log(rows: DataFrame, path: str) -> None:
    """Append rows (stream, frame_number, value) as log lines, a folder for each stream, in frame order."""
    ordered = rows.repartition("stream").sortWithinPartitions("stream", "frame_number")
    ordered.select("stream", "value").write.mode("append").partitionBy("stream").text(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, is_dir) of a folder: folders first, then by case-folded name. Names that leave the folder are an error."""
    if ".." in path.split("/"):
        raise ValueError("a listing stays below its folder")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    rows = [(x.getPath().getName(), x.isDirectory()) for x in found]
    return sorted_listing(spark.createDataFrame(rows, "name string, is_dir boolean"))


def sorted_listing(names: DataFrame) -> DataFrame:
    return names.withColumn("_f", casefold(F.col("name"))).orderBy(F.desc("is_dir"), "_f", "name").drop("_f")


def newest(files: DataFrame, suffix: str = "srt") -> DataFrame:
    """(stem, path): of rows (path, modified), the newest ``stem.suffix`` or ``stem.<language>.suffix`` of each stem."""
    stem = F.regexp_extract("path", rf"([^/]+?)(?:\.[A-Za-z-]+)?\.{suffix}$", 1)
    return files.withColumn("stem", stem).filter("stem <> ''").groupBy("stem").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def sibling_videos(files: DataFrame) -> DataFrame:
    """(stem, path): the first file of each stem that is neither a log nor subtitles."""
    named = files.withColumn("stem", F.regexp_extract("path", STEM, 1)).filter(~F.rlike("path", F.lit(r"\.(jsonl|srt)$")) & F.rlike("path", F.lit(r"\.[^./]+$")))
    return named.groupBy("stem").agg(F.min("path").alias("path"))
