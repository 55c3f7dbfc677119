"""The task queue as a table: states, transitions, the next task, progress, and request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("waiting", "running", "completed", "fatal_error", "retryable_error", "stopping", "stopped")
ACTIVE = ("waiting", "running", "stopping")
#: Allowed changes: (action, from, to) (fixed values).
TRANSITIONS = (
    ("start", "waiting", "running"),
    ("finish", "running", "completed"),
    ("fail", "running", "fatal_error"),
    ("fail_retryable", "running", "retryable_error"),
    ("stop", "waiting", "stopped"),
    ("stop", "running", "stopping"),
    ("halt", "stopping", "stopped"),
    ("resume", "retryable_error", "waiting"),
    ("resume", "stopped", "waiting"),
)


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRANSITIONS), "action string, was string, becomes string")


def apply_actions(tasks: DataFrame, actions: DataFrame) -> DataFrame:
    """Tasks (task_id, status) after one action each at most; adds ``accepted`` (null without an action).

    An action that isn't allowed in a task's state leaves it as it is.
    """
    wanted = tasks.join(actions, "task_id", "left")
    allowed = F.broadcast(transitions(tasks.sparkSession).withColumnRenamed("was", "status").withColumnRenamed("action", "a"))
    moved = wanted.join(allowed.withColumnRenamed("status", "s"), (F.col("action") == F.col("a")) & (F.col("status") == F.col("s")), "left")
    return moved.select(*[c for c in tasks.columns if c != "status"], F.coalesce("becomes", "status").alias("status"), F.when(F.col("action").isNotNull(), F.col("becomes").isNotNull()).alias("accepted"))


def restored(tasks: DataFrame) -> DataFrame:
    """Tasks as they are after a restart: what was under way is stopped."""
    return tasks.withColumn("status", F.when(F.col("status").isin("running", "stopping", "waiting"), "stopped").otherwise(F.col("status")))


def next_task(tasks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, task_id): the first waiting task by ``seq`` of each queue in which none is running."""
    waits = F.min_by(F.when(F.col("status") == "waiting", F.col("task_id")), F.when(F.col("status") == "waiting", F.struct("seq", "task_id")))
    found = tasks.groupBy(*by).agg(F.bool_or(F.col("status") == "running").alias("busy"), waits.alias("task_id"))
    return found.filter("not busy and task_id is not null").drop("busy")


def duplicate_of(tasks: DataFrame) -> DataFrame:
    """(video, task_id): the first active task of each video."""
    return tasks.filter(F.col("status").isin(*ACTIVE)).groupBy("video").agg(F.min_by("task_id", F.struct("seq", "task_id")).alias("task_id"))


def without(tasks: DataFrame, gone: DataFrame) -> DataFrame:
    """Tasks but those that are deleted; unknown ids change nothing."""
    return tasks.join(gone.select("task_id").distinct(), "task_id", "left_anti")


def logs_of(tasks: DataFrame, gone: DataFrame) -> DataFrame:
    """(task_id, log): the log file that goes with each deleted task, beside its video (a file name)."""
    named = tasks.join(gone.select("task_id").distinct(), "task_id", "left_semi").filter("video is not null and video <> ''")
    return named.select("task_id", F.concat(F.regexp_replace("video", r"(?<=[^/])\.[^./]*\z", ""), F.lit(".jsonl")).alias("log"))


def error_status(error: Column) -> Column:
    """The status of a failed task: recognition errors may be tried again."""
    return F.when(error == "recognition", "retryable_error").otherwise("fatal_error")


def editable(tasks: DataFrame, videos: DataFrame, logs: DataFrame) -> DataFrame:
    """Tasks with ``missing``: the first thing an edit lacks (completed, video, log), or null."""
    have = tasks.join(videos.select("video", F.lit(True).alias("_v")).distinct(), "video", "left").join(logs.select("video", F.lit(True).alias("_l")).distinct(), "video", "left")
    return have.withColumn("missing", F.when(F.col("status") != "completed", "completed").when(F.col("_v").isNull(), "video").when(F.col("_l").isNull(), "log")).drop("_v", "_l")


def request_errors(requests: DataFrame) -> DataFrame:
    """Requests with ``error``: the first rule that they break, or null.

    Columns: full_screen, x, y, width, height, frame_width, frame_height, start_time,
    end_time, duration, mask_x, mask_y, mask_width, mask_height.
    """
    c = F.col
    crop = ~c("full_screen")
    masks = [c(f"mask_{k}") for k in ("x", "y", "width", "height")]
    some, every = F.lit(False), F.lit(True)
    for m in masks:
        some, every = some | m.isNotNull(), every & m.isNotNull()
    x, y = F.when(crop, c("x")).otherwise(0), F.when(crop, c("y")).otherwise(0)
    w, h = F.when(crop, c("width")).otherwise(c("frame_width")), F.when(crop, c("height")).otherwise(c("frame_height"))
    mx, my, mw, mh = masks
    rules = [
        (crop & ((w <= 0) | (h <= 0)), "crop_size"),
        (crop & ((x < 0) | (y < 0)), "crop_origin"),
        (crop & ((x + w > c("frame_width")) | (y + h > c("frame_height"))), "crop_outside"),
        (c("start_time") < 0, "start_negative"),
        (c("start_time") >= c("duration"), "start_after_end"),
        (c("end_time") > c("duration"), "end_after_end"),
        (c("end_time") <= c("start_time"), "end_before_start"),
        (some & ~every, "mask_incomplete"),
        (every & crop, "mask_without_full_screen"),
        (every & ((mw <= 0) | (mh <= 0)), "mask_size"),
        (every & ((mx < 0) | (my < 0)), "mask_origin"),
        (every & ((mx + mw > c("frame_width")) | (my + mh > c("frame_height"))), "mask_outside"),
        (every & ((mx < x) | (my < y) | (mx + mw > x + w) | (my + mh > y + h)), "mask_outside_crop"),
    ]
    error = F.lit(None).cast("string")
    for test, name in reversed(rules):
        error = F.when(F.coalesce(test, F.lit(False)), name).otherwise(error)
    return requests.withColumn("error", error)
