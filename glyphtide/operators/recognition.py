"""Model calls as map operators: a client is any object with ``detect`` or ``recognize``.

No model is part of this package. Rows that fail carry their error in a column,
so one bad image doesn't end a job, and done work is left out by an anti join
before (``eventlog.pending``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class Recognizer(Protocol):
    def recognize(self, image: bytes) -> tuple[str, str]:
        """(text, finish reason) of an image; a reason of ``length`` means that the text was cut."""


RESULT = "stream string, frame_number long, block_index int, text string, text_status string, error string"


def recognize(crops: DataFrame, client: Callable[[], Recognizer], at_once: int = 16) -> DataFrame:
    """Texts of image crops (stream, frame_number, block_index, image).

    Each task makes one client and has at most ``at_once`` calls under way. A cut
    text has status truncated and no text, and keeps its box; errors go in ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = client()

        def one(image: bytes) -> tuple[str, str, str | None]:
            try:
                text, reason = made.recognize(image)
            except Exception as e:
                return "", "ok", f"{type(e).__name__}: {e}"
            return ("", "truncated", None) if reason == "length" else (text, "ok", None)

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                done = list(pool.map(one, (x.as_py() for x in batch.column(3))))
                cols = [pa.array([d[k] for d in done], pa.string()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["stream", "frame_number", "block_index", "text", "text_status", "error"])

    return crops.select("stream", "frame_number", "block_index", "image").mapInArrow(run, RESULT)
