"""From a frame log to numbered cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import quad_box
from ..functions.text import merge_key, valid_text
from ..operators import linking, segments, tracks
from ..params import MergeParams


def base_cues(records: DataFrame) -> DataFrame:
    """(stream, start, end, text) before merging, of records (stream, line_no, frame_number, time, spotting_items, ocr_mode).

    Streams of a single whole-frame box take the window tracker, others the full
    one with linking. Persist the result to post-process it under several
    parameter sets.
    """
    clean = records.withColumn("spotting_items", tracks.keep_lettered(F.col("spotting_items")))
    kinds = tracks.is_single_box(clean)
    # Both trackers, and all that follows a tracker, read tables that are written once.
    linking.ensure_checkpoints(records)
    clean = clean.join(kinds, "stream").checkpoint()
    item = F.get("spotting_items", F.lit(0))
    single = clean.filter("single_box").select("stream", F.col("line_no").alias("ord"), F.col("frame_number").alias("frame"), "time", item["text"].alias("text"), item["text_status"].alias("status"))
    followed = tracks.crop_tracks(single).withColumn("text", valid_text(F.coalesce("text", F.lit("")), F.coalesce("status", F.lit("ok")))).checkpoint()
    crop = tracks.track_cues(followed, tracks.LEAST_FRAMES_CROP).drop("track_id")

    boxes = clean.filter("not single_box").select("stream", F.col("frame_number").alias("frame"), "time", F.posexplode_outer("spotting_items").alias("det_index", "i"))
    boxes = boxes.select("stream", "frame", "time", "det_index", quad_box(F.col("i.quad")).alias("box"), valid_text(F.col("i.text"), F.col("i.text_status")).alias("text"))
    keyed = boxes.withColumn("key", merge_key(F.coalesce("text", F.lit(""))))
    ids = tracks.full_tracks(keyed.select("stream", "frame", "det_index", "box", "key"))
    tracked = boxes.join(ids, ["stream", "frame", "det_index"]).checkpoint()
    if tracked.isEmpty():
        return crop
    spans = tracks.extents(tracked)
    roots = linking.components(spans, linking.band_pairs(spans))
    linked = linking.relabel(tracked, roots)
    texts = tracks.frame_texts(linked).join(linked.select("stream", "frame", "time").distinct(), ["stream", "frame"])
    full = tracks.track_cues(texts, tracks.LEAST_FRAMES_FULL).drop("track_id")
    return crop.unionByName(full)


def captions(records: DataFrame, params: MergeParams | dict | None = None) -> DataFrame:
    """(stream, index, start, end, text) of a log's records."""
    return segments.postprocess(base_cues(records), params)
