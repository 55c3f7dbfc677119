"""Load metrics, and the concurrency limit that follows them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, text_lines

#: A gauge line of running or waiting requests (a fixed pattern).
GAUGE = r"^(vllm(?::|_)num_requests_(running|waiting))(?:\{[^}]*\})?\s+([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"


def load_metrics(scrapes: DataFrame, key: str = "scrape_id") -> DataFrame:
    """(key, running, waiting) of metric texts (key, payload).

    Series of one name are added; names with a colon go before those with an
    underscore. A kind that isn't there is null; ``required`` makes that an error.
    """
    lines = scrapes.select(key, F.explode_outer(F.transform(text_lines(F.col("payload")), strip)).alias("line"))
    found = lines.select(key, *[F.regexp_extract("line", GAUGE, k).alias(n) for k, n in ((1, "name"), (2, "kind"), (3, "value"))])
    value = F.when(F.col("name") != "", F.col("value").try_cast("double"))
    total = lambda sep, kind: F.sum(F.when(F.col("name") == f"vllm{sep}num_requests_{kind}", value))
    whole = lambda kind: F.greatest(F.lit(0), F.rint(F.coalesce(total(":", kind), total("_", kind))).cast("int"))
    kinds = {k: F.when(F.coalesce(total(":", k), total("_", k)).isNotNull(), whole(k)) for k in ("running", "waiting")}
    return found.groupBy(key).agg(*[v.alias(k) for k, v in kinds.items()])


def required(metrics: DataFrame) -> DataFrame:
    out = metrics
    for kind in ("running", "waiting"):
        out = out.withColumn(kind, F.coalesce(kind, F.raise_error(F.lit(f"no {kind} metric")).cast("int")))
    return out


def next_limit(now: int, waiting: int | None, initial: int = 16, least: int = 1, most: int = 64, target: int = 2) -> int:
    """The limit after a sample.

    Below the target it rises by what is missing (1 at least), above it falls by
    what is over; a sample of None, a failed read, sets it back.
    """
    if waiting is None:
        return initial
    off = target - waiting
    return min(most, now + off) if off > 0 else max(least, now + off) if off < 0 else now


def limit_series(samples: DataFrame, initial: int = 16, least: int = 1, most: int = 64, target: int = 2, enabled: bool = True) -> DataFrame:
    """(stream, seq, waiting, limit) of rows (stream, seq, waiting), in the order of seq.

    A stream is read once, batch by batch, with its limit as the only state. If it
    isn't enabled, the limit stays as it begins.
    """
    initial = max(1, initial)
    least, most, target = max(1, min(least, initial)), max(initial, most), max(0, target)
    if not enabled:
        return samples.select("stream", "seq", "waiting", F.lit(initial).alias("limit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, now = object(), initial
        for batch in batches:
            out = []
            for own, waiting in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != stream:
                    stream, now = own, initial
                now = next_limit(now, waiting, initial, least, most, target)
                out.append(now)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=["stream", "seq", "waiting", "limit"])

    rows = samples.select("stream", "seq", F.col("waiting").cast("int").alias("waiting")).repartition("stream").sortWithinPartitions("stream", "seq")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"stream {kinds['stream']}, seq {kinds['seq']}, waiting int, limit int")
