"""Streaming twins: last write wins, and single-box tracks with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import alike, key_of
from ..operators.tracks import MAX_GAP_FRAMES, SAME_TEXT

STATE = "track int, made int, key string, frame long"
OUT = "stream string, frame long, text string, status string, track_id int"


class CropTracker(StatefulProcessor):
    """``operators.tracks.crop_tracks`` a micro-batch at a time.

    State for each stream: the current track, how many were made, the last valid
    key and the last frame. Frames of a batch are taken in frame order; a frame that
    comes after a later one was handled in an earlier batch is dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracker", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        track, made, last, before = self.state.get() if self.state.exists() else (None, 0, "", None)
        batch = pd.concat(list(rows)).sort_values("frame")
        out = []
        for r in batch.itertuples(index=False):
            if before is not None and r.frame <= before:
                continue
            gap = before is not None and r.frame - before > MAX_GAP_FRAMES
            text = None if pd.isna(r.text) else r.text
            own = key_of(text) if text is not None else ""
            shown = None
            if text is not None and r.status != "ok":
                shown = None if gap else track
            elif not own:
                track, last = None, ""
            else:
                like = last and (own == last or alike(own, last, SAME_TEXT))
                if track is None or gap or not like:
                    made += 1
                    track = made
                shown, last = track, own
            before = r.frame
            out.append((key[0], r.frame, text, r.status, shown))
        self.state.update((track, made, last, before))
        frame = pd.DataFrame(out, columns=["stream", "frame", "text", "status", "track_id"])
        frame["track_id"] = frame["track_id"].astype("Int32")
        yield frame

    def close(self) -> None:
        pass


def stream_tracks(frames: DataFrame) -> DataFrame:
    """Tracks of a streaming table (stream, frame, text, status).

    Needs the RocksDB state store provider.
    """
    return frames.groupBy("stream").transformWithStateInPandas(CropTracker(), outputStructType=OUT, outputMode="append", timeMode="none")


def append_compacted(lines: DataFrame, path: str, checkpoint: str):
    """Keep the latest record of each frame of a streaming log: each batch appends its own latest rows.

    Readers take the last by line number (``eventlog.latest``), so a batch that
    is written twice after a failure changes nothing.
    """
    from ..operators.eventlog import latest

    def write(batch: DataFrame, batch_id: int) -> None:
        latest(batch, ["stream", "frame_number"], "line_no").write.mode("append").parquet(path)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
