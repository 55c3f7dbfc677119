"""Boxes, quads and image coordinates as columns.

A box is ``array<...>`` of left, top, right, bottom; a quad is an array of four
points. Rounding to whole numbers is half to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_FRAME_MARGIN = 5
WHITE, WHITE_FRACTION, UNIFORM_STD = 245, 0.99, 8.0


def clamp(value: Column, low, high) -> Column:
    """Cut to a whole number, then kept within bounds."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.greatest(low, F.least(value.cast("long"), high)).cast("int")


def quad_box(quad: Column) -> Column:
    axis = lambda k: F.transform(quad, lambda p: p[k])
    return F.array(F.array_min(axis(0)), F.array_min(axis(1)), F.array_max(axis(0)), F.array_max(axis(1)))


def quad_center(quad: Column) -> Column:
    mean = lambda k: F.aggregate(quad, F.lit(0.0), lambda s, p: s + p[k], lambda s: s / F.size(quad))
    return F.array(mean(0), mean(1))


def box_quad(box: Column) -> Column:
    """Corners clockwise from the top left."""
    corner = lambda x, y: F.array(box[x], box[y])
    return F.array(corner(0, 1), corner(2, 1), corner(2, 3), corner(0, 3))


def coordinate_mode(box: Column) -> Column:
    """``unit``, ``normalized_1000`` or ``identity``, by the largest magnitude."""
    largest = F.array_max(F.transform(box, F.abs))
    return F.when(largest <= 1.2, "unit").when(largest <= 1000, "normalized_1000").otherwise("identity")


def _sized(width: Column, height: Column) -> list[Column]:
    return [width, height, width, height]


def to_pixels(box: Column, width: Column, height: Column, mode: Column) -> Column:
    out = []
    for k, size in enumerate(_sized(width, height)):
        scaled = F.when(mode == "unit", box[k] * (size - 1)).when(mode == "normalized_1000", box[k] / 1000.0 * (size - 1)).otherwise(box[k])
        out.append(clamp(F.rint(scaled), 0, size - 1))
    return F.array(*out)


def normalize_pixels(box: Column, width: Column, height: Column) -> Column:
    scaled = lambda v, size: F.when(size <= 1, 0).otherwise(clamp(F.rint(v / (size - 1) * 1000.0), 0, 1000))
    return F.array(*[scaled(box[k], size) for k, size in enumerate(_sized(width, height))])


def text_block(box: Column, width: Column, height: Column) -> Column:
    """struct(normalized_bbox, pixel_bbox) of four numbers in any order and scale; null if it has no area."""
    box = box.cast("array<double>")
    tidy = F.array(F.least(box[0], box[2]), F.least(box[1], box[3]), F.greatest(box[0], box[2]), F.greatest(box[1], box[3]))
    mode = coordinate_mode(tidy)
    pixels = to_pixels(tidy, width, height, mode)
    given = F.transform(tidy, lambda v: clamp(F.rint(v), 0, 1000))
    normal = F.when(mode == "normalized_1000", given).otherwise(normalize_pixels(pixels, width, height))
    return F.when((pixels[2] > pixels[0]) & (pixels[3] > pixels[1]), F.struct(normal.alias("normalized_bbox"), pixels.alias("pixel_bbox")))


def is_full_frame(box: Column, margin: int = FULL_FRAME_MARGIN) -> Column:
    return (box[0] <= margin) & (box[1] <= margin) & (box[2] >= 1000 - margin) & (box[3] >= 1000 - margin)


def padded_crop(box: Column, width: Column, height: Column) -> Column:
    """Crop rectangle (left, top, right, bottom; ends exclusive) with padding, or null if empty."""
    w, h = F.greatest(F.lit(0), box[2] - box[0]), F.greatest(F.lit(0), box[3] - box[1])
    pad = F.rint(F.greatest(F.lit(8.0), F.greatest(w, h) * 0.04)).cast("int")
    crop = F.array(clamp(box[0] - pad, 0, width), clamp(box[1] - pad, 0, height), clamp(box[2] + pad + 1, 0, width), clamp(box[3] + pad + 1, 0, height))
    return F.when((w > 0) & (h > 0) & (crop[2] > crop[0]) & (crop[3] > crop[1]), crop)


def region_crop(box: Column, width: Column, height: Column) -> Column:
    """Crop rectangle of a pixel box, its last row and column included."""
    crop = F.array(clamp(box[0], 0, width - 1), clamp(box[1], 0, height - 1), clamp(box[2] + 1, 0, width), clamp(box[3] + 1, 0, height))
    return F.when((crop[2] > crop[0]) & (crop[3] > crop[1]), crop)


def scaled_box(box: Column, width: Column, height: Column) -> Column:
    """A 0..1000 box in pixels, clipped and ordered; zeros where a side has at most one pixel."""
    px = [clamp(F.rint(box[k] / 1000.0 * (size - 1)), 0, size - 1) for k, size in enumerate(_sized(width, height))]
    out = F.array(F.least(px[0], px[2]), F.least(px[1], px[3]), F.greatest(px[0], px[2]), F.greatest(px[1], px[3]))
    return F.when((width <= 1) | (height <= 1), F.array(*[F.lit(0)] * 4)).otherwise(out)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 where they don't meet or have no area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def track_color(track_id: Column) -> Column:
    """Three channels of 64 to 191, the same for the same id."""
    h = F.pmod(track_id.cast("long") * 2654435761, F.lit(1 << 32))
    return F.array(*[(F.shiftright(h, s).bitwiseAND(F.lit(127)) + 64).cast("int") for s in (0, 8, 16)])


def full_frame_block(width: Column, height: Column) -> Column:
    return F.struct(F.array(*[F.lit(x) for x in (0, 0, 1000, 1000)]).alias("normalized_bbox"), F.array(F.lit(0), F.lit(0), F.greatest(F.lit(0), width - 1), F.greatest(F.lit(0), height - 1)).cast("array<int>").alias("pixel_bbox"))


def frame_bound(seconds: Column, fps: Column) -> Column:
    """Frame number of a time, cut to a whole number."""
    return (seconds * fps).cast("long")


def phase_progress(done: Column, total: Column, start: float, end: float, cap: float) -> Column:
    return F.bround(F.least(F.lit(cap), start + done / F.greatest(F.lit(1), total) * (end - start)), 2)


def time_left(progress: Column, elapsed: Column) -> Column:
    """``HH:MM:SS`` to go, modulo a day; TBD before any progress, 00:00:00 at 100."""
    rest = F.pmod(F.floor(elapsed * (100 - progress) / progress).cast("long"), F.lit(86_400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.pmod(F.floor(rest / 60), F.lit(60)), F.pmod(rest, F.lit(60)))
    return F.when((progress <= 0) | elapsed.isNull(), "TBD").when(progress == 100, "00:00:00").otherwise(clock)
