"""The append-only frame log: parsing, last write wins, compaction, and what is left to do.

Log lines come as (stream, line_no, value); see ``sources.logs``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<text:string,quad:array<array<int>>,text_status:string>"
RECORD = f"frame_number bigint, time double, spotting_items array<{ITEM}>, raw_llm_output string, ocr_mode string, ocr_area array<int>, mask_area array<int>"


def whole(value: Column) -> Column:
    """A JSON scalar as a whole number, cut; null if it isn't one. Booleans aren't numbers here."""
    return value.try_cast("double").try_cast("bigint")


def parse_blocks(blocks: Column) -> Column:
    """Detector blocks of a JSON text; items without two boxes of four whole numbers are dropped."""
    raw = F.transform(F.from_json(blocks, "array<string>"), lambda b: F.from_json(b, "struct<normalized_bbox:array<string>,pixel_bbox:array<string>>"))
    numbers = lambda box: F.transform(box, lambda v: v.try_cast("double").try_cast("int"))
    rows = F.transform(raw, lambda b: F.struct(numbers(b["normalized_bbox"]).alias("normalized_bbox"), numbers(b["pixel_bbox"]).alias("pixel_bbox")))
    fine = lambda box: F.coalesce((F.size(box) == 4) & F.forall(box, lambda v: v.isNotNull()), F.lit(False))
    return F.coalesce(F.filter(rows, lambda b: fine(b["normalized_bbox"]) & fine(b["pixel_bbox"])), F.array().cast("array<struct<normalized_bbox:array<int>,pixel_bbox:array<int>>>"))


def parse_items(items: Column) -> Column:
    """Items with their defaults: no text is empty, no status is ok; a quad without four points is an error."""
    fixed = lambda i: F.struct(F.coalesce(i["text"], F.lit("")).alias("text"), F.when(F.size(i["quad"]) == 4, i["quad"]).otherwise(F.raise_error(F.lit("a quad has four points")).cast("array<array<int>>")).alias("quad"), F.coalesce(F.nullif(i["text_status"], F.lit("")), F.lit("ok")).alias("text_status"))
    return F.transform(items, fixed)


def _fields(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects with a frame number, as a map of JSON texts."""
    parsed = lines.withColumn("m", F.from_json("value", "map<string,string>"))
    return parsed.filter("m is not null").withColumn("frame_number", whole(F.col("m")["frame_number"])).filter("frame_number is not null")


def detector_state(lines: DataFrame) -> DataFrame:
    """(stream, frame_number, blocks): the last detector record of each frame.

    A record that lacks the key ``detector_blocks`` may have the older ``blocks``.
    """
    m = F.col("m")
    rows = _fields(lines).filter(m["record_type"] == "detector")
    blocks = F.when(F.map_contains_key(m, "detector_blocks"), m["detector_blocks"]).otherwise(m["blocks"])
    return latest(rows.select("stream", "frame_number", "line_no", parse_blocks(blocks).alias("blocks")), ["stream", "frame_number"], "line_no").drop("line_no")


def recognizer_state(lines: DataFrame) -> DataFrame:
    """The last text record of each frame, in the schema ``RECORD`` and its stream and line_no.

    A record says ``record_type`` ocr, or is a compacted one that lacks the key
    and has ``spotting_items``; a null record_type counts as unknown.
    """
    m = F.col("m")
    compacted = ~F.map_contains_key(m, "record_type") & F.map_contains_key(m, "spotting_items")
    rows = _fields(lines).filter(F.coalesce(m["record_type"] == "ocr", F.lit(False)) | compacted)
    last = latest(rows.select("stream", "frame_number", "line_no", "value"), ["stream", "frame_number"], "line_no")
    record = F.from_json("value", RECORD)
    return last.select("stream", "line_no", record.alias("r"), "frame_number").select("stream", "line_no", "frame_number", *[F.col(f"r.{c}").alias(c) for c in ("time", "spotting_items", "raw_llm_output", "ocr_mode", "ocr_area", "mask_area")])


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` for each key: last write wins, with map-side aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def strict_records(lines: DataFrame) -> DataFrame:
    """Every line as a record, in file order; a malformed line, or one that lacks a field, fails the query."""
    record = F.from_json("value", RECORD, {"mode": "FAILFAST"})
    rows = lines.select("stream", "line_no", record.alias("r"))
    has = F.col("r.frame_number").isNotNull() & F.col("r.time").isNotNull() & F.col("r.spotting_items").isNotNull()
    checked = rows.withColumn("_ok", F.when(has, True).otherwise(F.raise_error(F.concat(F.lit("a field is missing in line "), F.col("line_no").cast("string"))).cast("boolean")))
    return checked.filter("_ok").select("stream", "line_no", "r.*").withColumn("spotting_items", parse_items(F.col("spotting_items")))


def frame_time(frame: Column, fps: Column) -> Column:
    """Seconds, to whole milliseconds; halves go to the even one. In doubles, as in SQL: from 2^53 ms on the last digit may be off."""
    return F.rint(frame / fps * 1000) / 1000


def seconds_text(seconds: Column) -> Column:
    """Seconds of whole milliseconds as a JSON number: the fewest digits that give the double back, an exponent from 1e16 on.

    Spark itself has an exponent from 1e7 on, and at times a digit too many.
    Below 2^53 milliseconds three decimals are exact; what is above is left to
    a lambda, so that its many steps stay out of the generated code.
    """
    size = F.abs(seconds)
    decimals = F.regexp_replace(seconds.cast("decimal(16,3)").cast("string"), "0{1,2}$", "")
    return F.when(size < 1e7, seconds.cast("string")).when(size < 9e12, decimals).otherwise(F.get(F.transform(F.array(seconds), _far_seconds_text), F.lit(0)))


def _far_seconds_text(seconds: Column) -> Column:
    """The same from 9e12 on, by trying from few digits to many; from 2^63 on it is Spark's text."""
    size = F.abs(seconds)
    number = size.try_cast("bigint")
    exact = number.cast("decimal(20,0)") + (size - number).cast("decimal(11,10)")
    first = lambda tries: F.coalesce(*[F.when(d.cast("double") == size, d.cast("string")) for d in tries])
    plain = first(F.bround(exact, s) for s in range(4))
    digits = first(F.bround(number, -j) for j in range(4, -1, -1))
    mantissa = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"^(.)(.+)$", "$1.$2")
    text = F.when(size < 1e16, F.regexp_replace(plain, r"^(\d+)$", "$1.0")).otherwise(F.concat(mantissa, F.lit("e+"), (F.length(digits) - 1).cast("string")))
    return F.coalesce(F.concat(F.when(seconds < 0, "-").otherwise(""), text), seconds.cast("string"))


def detector_line(frame: Column, fps: Column, blocks: Column) -> Column:
    """A detector record as JSON; keys that are null are left out."""
    values = {"frame_number": frame.cast("string"), "time": seconds_text(frame_time(frame, fps)), "detector_blocks": F.to_json(blocks)}
    members = [F.concat(F.lit(f'"{k}":'), v) for k, v in values.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", F.lit('"record_type":"detector"'), *members), F.lit("}"))


def recognizer_line(row: Sequence[str] = ("frame_number", "time", "spotting_items", "raw_llm_output", "ocr_mode", "ocr_area", "mask_area"), record_type: str | None = "ocr") -> Column:
    """A text record as JSON; keys that are null are left out."""
    kind = [F.lit(record_type).alias("record_type")] if record_type else []
    return F.to_json(F.struct(*kind, *row))


def compact(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """(stream, frame_number, value): the latest text record of the listed frames, as log lines.

    Detector records and frames that aren't listed are left out. The lines of a
    stream are in one partition, ordered by frame; write them to a new place.
    """
    kept = recognizer_state(lines).join(frames.select("stream", "frame_number").distinct(), ["stream", "frame_number"], "left_semi")
    filled = kept.withColumn("time", F.coalesce("time", F.lit(0.0))).withColumn("spotting_items", F.coalesce("spotting_items", F.array().cast(f"array<{ITEM}>")))
    lined = filled.select("stream", "frame_number", recognizer_line(record_type=None).alias("value"))
    return lined.repartition("stream").sortWithinPartitions("stream", "frame_number")


def compatible(mode: Column, area: Column, mask: Column, context_mode: Column, context_area: Column, context_mask: Column) -> Column:
    """Whether a record was made in a context; an old record without a mode fits full screen alone."""
    same = (mode == context_mode) & area.eqNullSafe(context_area) & mask.eqNullSafe(context_mask)
    return F.coalesce(F.when(mode.isNull(), context_mode == "full_screen").otherwise(same), F.lit(False))


def is_full_screen(mode: Column) -> Column:
    return mode.isNull() | (mode == "full_screen")


def required_frames(spans: DataFrame) -> DataFrame:
    """(stream, frame_number) of each frame after ``first`` up to ``last``; none if the span is empty."""
    numbers = F.when(F.col("last") > F.col("first"), F.sequence(F.col("first") + 1, F.col("last"))).otherwise(F.array().cast("array<bigint>"))
    return spans.select("stream", F.explode(numbers).alias("frame_number"))


def pending(required: DataFrame, *done: DataFrame) -> DataFrame:
    """Required frames that are in none of ``done``."""
    for d in done:
        required = required.join(d.select("stream", "frame_number"), ["stream", "frame_number"], "left_anti")
    return required


def first_pending(required: DataFrame, *done: DataFrame) -> DataFrame:
    """(stream, first_pending): the first required frame that is in none of ``done``; complete streams have no row."""
    return pending(required, *done).groupBy("stream").agg(F.min("frame_number").alias("first_pending"))


def done_overlap(required: DataFrame, *done: DataFrame) -> DataFrame:
    """(stream, required, done): how many required frames are in the union of ``done``."""
    every = done[0].select("stream", "frame_number")
    for d in done[1:]:
        every = every.unionByName(d.select("stream", "frame_number"))
    hit = required.join(every.distinct().withColumn("hit", F.lit(1)), ["stream", "frame_number"], "left")
    return hit.groupBy("stream").agg(F.count(F.lit(1)).alias("required"), F.coalesce(F.sum("hit"), F.lit(0)).alias("done"))


def is_complete(required: DataFrame, *done: DataFrame) -> DataFrame:
    """(stream, complete): whether no required frame is missing."""
    return done_overlap(required, *done).select("stream", (F.col("required") == F.col("done")).alias("complete"))


def with_blocks(frames: DataFrame, detector: DataFrame) -> DataFrame:
    """Frames with their blocks, an empty array where there are none."""
    joined = frames.join(detector.select("stream", "frame_number", "blocks"), ["stream", "frame_number"], "left")
    return joined.withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<normalized_bbox:array<int>,pixel_bbox:array<int>>>")))


def frame_countdown(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """(stream, frame_number, remaining): blocks of a frame whose result isn't there yet."""
    want = blocks.groupBy("stream", "frame_number").agg(F.count(F.lit(1)).alias("want"))
    have = results.groupBy("stream", "frame_number").agg(F.countDistinct("block_index").alias("have"))
    return want.join(have, ["stream", "frame_number"], "left").select("stream", "frame_number", (F.col("want") - F.coalesce("have", F.lit(0))).alias("remaining"))


def frames_of(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Frame numbers first + 1 to last."""
    return spark.range(first + 1, max(first, last) + 1).withColumnRenamed("id", "frame_number")
