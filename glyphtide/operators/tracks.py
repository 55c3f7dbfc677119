"""Text followed across frames: the single-box tracker, the full-screen tracker, and track aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alike_udf, letter_count, merge_key

MAX_GAP_FRAMES, SAME_TEXT, LEAST_FRAMES_CROP, LEAST_FRAMES_FULL = 6, 0.86, 3, 8
#: Weights of the full-screen tracker's distance (fixed values).
TEXT_WEIGHT, DIFFERENT_TEXT, UNLIKE_TEXT, UNLIKE_PENALTY, MAX_DISTANCE, MAX_HITS = 0.24, 0.30, 0.35, 0.08, 0.7, 4


def keep_lettered(items: Column) -> Column:
    """Items but those with status ok and at most one letter."""
    return F.filter(items, lambda i: (i["text_status"] != "ok") | (letter_count(i["text"]) > 1))


def is_single_box(frames: DataFrame) -> DataFrame:
    """(stream, single_box): all frames in crop mode with at most one item, which fills the frame."""
    whole = lambda i: (F.array_min(F.transform(i["quad"], lambda p: F.array_min(p))) == 0) & (F.array_max(F.transform(i["quad"], lambda p: F.array_max(p))) == 1000)
    corners = lambda i: F.array_min(F.transform(i["quad"], lambda p: p[0])) == F.array_min(F.transform(i["quad"], lambda p: p[1]))
    fine = (F.col("ocr_mode") == "crop") & (F.size("spotting_items") <= 1) & F.forall("spotting_items", lambda i: whole(i) & corners(i))
    return frames.groupBy("stream").agg((F.bool_and(F.coalesce(fine, F.lit(False))) & (F.count_if(F.col("ocr_mode") == "crop") > 0)).alias("single_box"))


def crop_tracks(frames: DataFrame, same: Callable[[Column, Column], Column] | None = None, max_gap: int = MAX_GAP_FRAMES, ratio: float = SAME_TEXT) -> DataFrame:
    """Add ``track_id`` (from 1 in a stream, null for none) to rows (stream, ord, frame, text, status).

    ``text`` is null where a frame has no item. In order: no item, or an ok text
    without a key, ends the track. A truncated text stays in the track unless over
    ``max_gap`` frames have passed since the frame before; such a frame has no
    track, but the track may go on behind it. An ok text goes on if no such gap is
    before it and it is like the last ok text, else it starts a track. All of it is
    window functions over the stream; only unequal keys reach the similarity
    function, and ``same`` may replace it.
    """
    stream = Window.partitionBy("stream").orderBy("ord")
    upto = stream.rowsBetween(Window.unboundedPreceding, 0)
    ok = F.coalesce(F.col("status") == "ok", F.lit(True))
    rows = frames.withColumn("_key", merge_key(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_reset", F.col("text").isNull() | (ok & (F.col("_key") == ""))).withColumn("_valid", ~F.col("_reset") & ok)
    rows = rows.withColumn("_gap", F.coalesce(F.col("frame") - F.lag("frame").over(stream) > max_gap, F.lit(False)))
    rows = rows.withColumn("_run", F.sum(F.col("_reset").cast("int")).over(upto))
    run = Window.partitionBy("stream", "_run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.last(F.when(F.col("_valid"), F.col("_key")), ignorenulls=True).over(run))
    unequal = F.col("_valid") & (F.col("_key") != F.col("_last"))
    asked = F.when(unequal, F.col("_key")), F.when(unequal, F.col("_last"))
    like = same(*asked) >= ratio if same else alike_udf(ratio)(*asked)
    rows = rows.withColumn("_alike", F.when(F.col("_key") == F.col("_last"), True).otherwise(F.coalesce(like, F.lit(False))))
    rows = rows.withColumn("_new", F.col("_valid") & (F.col("_last").isNull() | F.col("_gap") | ~F.col("_alike")))
    rows = rows.withColumn("_id", F.sum(F.col("_new").cast("int")).over(upto))
    inherits = ~F.col("_reset") & F.col("_last").isNotNull() & ~F.col("_gap")
    return rows.select(*frames.columns, F.when(F.col("_valid") | inherits, F.col("_id")).alias("track_id"))


def iou_of(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = max(0, a[2] - a[0]) * max(0, a[3] - a[1]) + max(0, b[2] - b[0]) * max(0, b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def box_distance(box: tuple, key: str, old_box: tuple, old_key: str) -> float:
    """Distance of a box from a track's: overlap alone, or with text where both have some."""
    apart = 1.0 - iou_of(box, old_box)
    if not key or not old_key:
        return apart
    match = SequenceMatcher(None, key, old_key)
    # An upper bound of the ratio, in linear time, settles most unlike texts.
    if match.quick_ratio() <= DIFFERENT_TEXT or (ratio := match.ratio()) <= DIFFERENT_TEXT:
        return 1.0
    mixed = (1 - TEXT_WEIGHT) * apart + TEXT_WEIGHT * (1 - ratio)
    return min(1.0, mixed + UNLIKE_PENALTY) if ratio <= UNLIKE_TEXT else mixed


class LiveTracks:
    """The state of the full-screen tracker for one stream: the live tracks, and how many were made."""

    def __init__(self) -> None:
        self.live: list[dict] = []
        self.made = 0

    def match(self, boxes: list[tuple[tuple, str]]) -> list[int]:
        """Take a frame's (box, key) rows and give the track of each."""
        near = sorted((d, t["id"], i) for t in self.live for i, (box, k) in enumerate(boxes) if (d := box_distance(box, k, t["box"], t["key"])) < MAX_DISTANCE)
        by_id, taken, met = {t["id"]: t for t in self.live}, {}, set()
        for _, track, i in near:
            if track not in met and i not in taken:
                taken[i] = track
                met.add(track)
        for t in self.live:
            t["hits"] = min(MAX_HITS, t["hits"] + 2) - 1 if t["id"] in met else t["hits"] - 1
        for i, (box, k) in enumerate(boxes):
            if i in taken:
                by_id[taken[i]].update(box=box, key=k)
            else:
                self.made += 1
                taken[i] = self.made
                self.live.append({"id": self.made, "box": box, "key": k, "hits": 1})
        self.live = [t for t in self.live if t["hits"] >= 0]
        return [taken[i] for i in range(len(boxes))]


def full_tracks(frames: DataFrame) -> DataFrame:
    """(stream, frame, det_index, track_id) of rows (stream, frame, det_index, box, key).

    A frame without boxes has one row with a null det_index; it ages the tracks.
    A greedy tracker: in each frame the nearest (track, box) pairs below the
    greatest distance are matched first, a box left over starts a track, and a
    track that is missed more often than it was hit lately ends. Ids count
    from 1 in each stream. Frames are read in order, batch by batch, and only the
    live tracks and one frame are held; it matches its own rules, not another
    library's motion model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, boxes = None, LiveTracks(), []
        for batch in batches:
            out: list[tuple] = []

            def close() -> None:
                ids = state.match([(box, key) for _, box, key in boxes])  # noqa: B023
                out.extend((*now, index, i) for (index, _, _), i in zip(boxes, ids, strict=True))  # noqa: B023

            for stream, frame, index, box, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (stream, frame):
                    if now is not None:
                        close()
                        state = state if now[0] == stream else LiveTracks()
                    now, boxes = (stream, frame), []
                if index is not None:
                    boxes.append((index, tuple(box), key or ""))
            yield packed(out, batch)
            last = batch
        if now is not None:
            out = []
            close()
            yield packed(out, last)

    def packed(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        kinds = (like.schema.field(0).type, pa.int64(), pa.int32(), pa.int64())
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["stream", "frame", "det_index", "track_id"])

    kind = frames.schema["stream"].dataType.simpleString()
    rows = frames.select("stream", "frame", "det_index", "box", "key").repartition("stream").sortWithinPartitions("stream", "frame", "det_index")
    return rows.mapInArrow(run, f"stream {kind}, frame long, det_index int, track_id long")


def extents(tracked: DataFrame) -> DataFrame:
    """(stream, track_id, first_frame, first_time, last_frame, frames) of rows with frame and time."""
    seen = tracked.filter("track_id is not null").groupBy("stream", "track_id")
    return seen.agg(F.min("frame").alias("first_frame"), F.min_by("time", "frame").alias("first_time"), F.max("frame").alias("last_frame"), F.countDistinct("frame").alias("frames"))


def frame_texts(detections: DataFrame) -> DataFrame:
    """(stream, frame, track_id, text): each frame's boxes of a track, in reading order, one text.

    Boxes that together are at least as wide as high are read down, then right;
    else from right to left, then down. Equal places keep their order.
    """
    width, height = F.col("box")[2] - F.col("box")[0], F.col("box")[3] - F.col("box")[1]
    cx, cy = (F.col("box")[0] + F.col("box")[2]) / 2.0, (F.col("box")[1] + F.col("box")[3]) / 2.0
    entry = lambda a, b: F.array_sort(F.collect_list(F.struct(a.alias("a"), b.alias("b"), F.col("det_index"), F.col("text"))))
    grouped = detections.groupBy("stream", "frame", "track_id").agg(F.sum(width).alias("w"), F.sum(height).alias("h"), entry(cy, cx).alias("across"), entry(-cx, cy).alias("down"))
    order = F.when(F.col("w") >= F.col("h"), F.col("across")).otherwise(F.col("down"))
    return grouped.select("stream", "frame", "track_id", F.array_join(F.filter(order["text"], lambda t: t != ""), "\n").alias("text"))


def track_cues(texts: DataFrame, least_frames: int) -> DataFrame:
    """(stream, track_id, start, end, text) of rows (stream, track_id, frame, time, text).

    Frames count whether they have text or not; tracks with fewer than
    ``least_frames`` go, as do those without any text.
    """
    from .vote import representative, votes

    tracks = texts.filter("track_id is not null").groupBy("stream", "track_id").agg(F.countDistinct("frame").alias("n"), F.min("time").alias("start"), F.max("time").alias("end")).filter(F.col("n") >= least_frames)
    counted = votes(texts.filter("track_id is not null and text <> ''").select(F.struct("stream", "track_id").alias("group"), "text", F.col("frame").alias("ord")))
    chosen = representative(counted).select("group.stream", "group.track_id", "text").filter("text <> ''")
    return tracks.join(chosen, ["stream", "track_id"]).select("stream", "track_id", "start", "end", "text")
