"""Cues: (stream, start, end, text), merged until stable, filtered and numbered.

Merging equal cues is a window job. Containment and similarity merges depend on
the order in which cues change each other, so they are a fold over the cues of a
chunk; chunks end where no later cue can reach back, which keeps long streams
parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alike, contained, dedupe_lines, key_of, merge_key, unrepeated
from ..params import MergeParams

ORDER = ("start", "end", "text")


def merge_equal(cues: DataFrame, max_gap: float = 1.0, key: str | None = None) -> DataFrame:
    """Join cues of a stream with the same key, at most ``max_gap`` apart.

    Gaps and islands: a cue starts a new island if it starts over ``max_gap``
    after the latest end so far among its key. The longest text stays, of equal
    lengths the first. Cues without a key never merge. Cues have start <= end.
    """
    keyed = cues.withColumn("_key", F.col(key) if key else merge_key(F.col("text")))
    # A cue without a key is its own partition.
    alone = F.when(F.col("_key") == "", F.struct(*ORDER)).otherwise(F.lit(None))
    keyed = keyed.withColumn("_alone", alone)
    part = Window.partitionBy("stream", "_key", "_alone")
    order = part.orderBy(*ORDER)
    latest = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = keyed.withColumn("_new", F.when(latest.isNull() | (F.col("start") - latest > max_gap) | (F.col("_key") == ""), 1).otherwise(0)).withColumn("_rn", F.row_number().over(order))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by("text", F.struct(F.length("text"), -F.col("_rn")))
    merged = marked.groupBy("stream", "_key", "_alone", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("text"))
    return merged.select("stream", *ORDER)


class _Cue:
    __slots__ = ("end", "key", "start", "text")

    def __init__(self, start: float, end: float, text: str):
        self.start, self.end, self.text = start, end, text
        self.key = key_of(text)

    def row(self) -> tuple[float, float, str]:
        return self.start, self.end, self.text

    def absorb(self, other: _Cue, take_text: bool) -> None:
        self.start, self.end = min(self.start, other.start), max(self.end, other.end)
        if take_text:
            self.text, self.key = other.text, other.key

    def near(self, later: _Cue, gap: float) -> bool:
        return later.start - self.end <= gap or min(later.end, self.end) > max(later.start, self.start)


def _fold(cues: list[_Cue], meets: Callable[[_Cue, _Cue], bool], longer: Callable[[_Cue], int]) -> list[_Cue]:
    """In order, give each cue to the latest kept one that it meets (kept, new); the longer text stays."""
    kept: list[_Cue] = []
    for cue in sorted(cues, key=_Cue.row):
        home = next((k for k in reversed(kept) if meets(k, cue)), None)
        if home is None:
            kept.append(cue)
        else:
            home.absorb(cue, longer(cue) > longer(home))
    return sorted(kept, key=_Cue.row)


def _equal(p: MergeParams) -> Callable[[_Cue, _Cue], bool]:
    return lambda old, new: bool(new.key) and new.key == old.key and new.start - old.end <= p.duplicate_gap_sec


def _contained(p: MergeParams) -> Callable[[_Cue, _Cue], bool]:
    return lambda old, new: bool(old.key and new.key) and old.key != new.key and old.near(new, p.contained_gap_sec) and contained(new.key, old.key, p.min_contained_key_len)


def _similar(p: MergeParams) -> Callable[[_Cue, _Cue], bool]:
    def meets(old: _Cue, new: _Cue) -> bool:
        a, b = len(new.key), len(old.key)
        if min(a, b) < p.min_similar_key_len or not old.near(new, p.contained_gap_sec) or min(a, b) / max(a, b) < p.similar_length_ratio:
            return False
        return alike(new.key, old.key, p.similar_threshold)

    return meets


def _tidy(cues: list[_Cue], least_key: int) -> list[_Cue]:
    texts = ((c.start, c.end, unrepeated(c.text, least_key)) for c in cues)
    return [_Cue(*t) for t in texts if t[2]]


def settle_cues(cues: list[tuple[float, float, str]], params: MergeParams) -> list[tuple[float, float, str]]:
    """All merges, again and again until nothing changes or the passes are used up."""
    now = _tidy([_Cue(*c) for c in cues], params.min_contained_key_len)
    for _ in range(params.postprocess_passes):
        before = [c.row() for c in now]
        now = _fold(now, _equal(params), lambda c: len(c.text))
        now = _fold(now, _contained(params), lambda c: len(c.key))
        now = _fold(now, _similar(params), lambda c: len(c.key))
        now = _tidy(now, params.min_contained_key_len)
        if [c.row() for c in now] == before:
            break
    return [c.row() for c in now]


def quiet_chunks(cues: DataFrame, gap: float, by: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Add ``chunk``: a new one starts where a cue starts over ``gap`` after all earlier ends."""
    order = Window.partitionBy(*by).orderBy(*ORDER)
    latest = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = cues.withColumn("_new", F.when(F.col("start") - latest > gap, 1).otherwise(0))
    return opened.withColumn("chunk", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _grouped(cues: DataFrame, run: Callable[[list[tuple[float, float, str]], tuple], list[tuple[float, float, str]]], gap: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """Apply a function of (sorted cues, key) to each chunk of each (stream, extra), one chunk in memory at a time."""
    by = ("stream", *extra)
    kinds = [f"{c} {cues.schema[c].dataType.simpleString()}" for c in by]
    rows = quiet_chunks(cues, gap, by).select(*by, "chunk", F.col("start").cast("double"), F.col("end").cast("double"), "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out, like = None, [], [], None

        def packed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * (len(by) + 3)
            types = [*(like.field(k).type for k in range(len(by))), pa.float64(), pa.float64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*by, *ORDER])

        for batch in batches:
            like = batch.schema
            for *key, start, end, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if held:
                        out.extend((*now[:-1], *r) for r in run(held, tuple(now)))
                    now, held = key, []
                held.append((start, end, text))
            yield packed()
            out = []
        if held:
            out.extend((*now[:-1], *r) for r in run(held, tuple(now)))
            yield packed()

    dealt = rows.repartition(*by, "chunk").sortWithinPartitions(*by, "chunk", *ORDER)
    return dealt.mapInArrow(apply, ", ".join([*kinds, "start double, end double, text string"]))


def merge_contained(cues: DataFrame, max_gap: float = 1.0, least_key: int = 4) -> DataFrame:
    """Give cues that another one near them safely contains to that one."""
    p = MergeParams(contained_gap_sec=max_gap, min_contained_key_len=least_key)
    return _grouped(cues, lambda rows, _: [c.row() for c in _fold([_Cue(*r) for r in rows], _contained(p), lambda c: len(c.key))], max(0.0, max_gap))


def merge_similar(cues: DataFrame, params: MergeParams | None = None) -> DataFrame:
    """Join cues near each other whose keys are nearly the same."""
    p = params or MergeParams()
    return _grouped(cues, lambda rows, _: [c.row() for c in _fold([_Cue(*r) for r in rows], _similar(p), lambda c: len(c.key))], max(0.0, p.contained_gap_sec))


def tidy_texts(cues: DataFrame, least_key: int = 4) -> DataFrame:
    """Take repeated lines out of each cue; cues left without text go."""
    return cues.withColumn("text", dedupe_lines(F.col("text"), least_key)).filter("text <> ''")


def drop_short(cues: DataFrame, least: float = 0.5) -> DataFrame:
    return cues.filter(F.col("end") - F.col("start") > least)


def number(cues: DataFrame, by: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Add ``index``, from 1 in each stream, by start, end and text."""
    return cues.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy(*ORDER)))


def postprocess(cues: DataFrame, params: MergeParams | dict | None = None) -> DataFrame:
    """Merge, drop backward and short cues, and number: (stream, index, start, end, text)."""
    p = MergeParams.of(params)
    gap = max(0.0, p.duplicate_gap_sec, p.contained_gap_sec)
    merged = _grouped(cues.select("stream", *ORDER), lambda rows, _: settle_cues(rows, p), gap)
    return number(drop_short(merged.filter("end >= start"), p.min_duration_sec)).select("stream", "index", *ORDER)


def sweep(cues: DataFrame, given: dict[str, MergeParams]) -> DataFrame:
    """``postprocess`` under several named parameter sets in one job: adds ``params``."""
    gap = max([0.0, *(max(p.duplicate_gap_sec, p.contained_gap_sec) for p in given.values())])
    names = cues.withColumn("params", F.explode(F.array(*[F.lit(n) for n in given])))
    merged = _grouped(names.select("stream", "params", *ORDER), lambda rows, key: settle_cues(rows, given[key[1]]), gap, ("params",))
    least = F.create_map(*[F.lit(x) for n, p in given.items() for x in (n, p.min_duration_sec)])[F.col("params")]
    return number(merged.filter((F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") > least)), ("stream", "params"))
