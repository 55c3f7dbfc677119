"""Tracks that belong together: pairs by a band join, and their connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_FRAMES, START_SECONDS = 6, 2.0


def band_pairs(tracks: DataFrame, end_frames: int = END_FRAMES, start_seconds: float = START_SECONDS) -> DataFrame:
    """(stream, a, b): tracks of a stream that end within some frames and start within some seconds.

    Both limits become buckets of their own width, and each track meets its own
    bucket and the next ones, so the band join is an equality join on (stream,
    end bucket, start bucket).
    """
    cell = tracks.select("stream", F.col("track_id").alias("a"), F.col("last_frame").alias("la"), F.col("first_time").alias("ta"))
    cell = cell.withColumn("eb", F.floor(F.col("la") / (end_frames + 1)).cast("long")).withColumn("sb", F.floor(F.col("ta") / (start_seconds + 1e-9)).cast("long"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = cell.withColumn("o", F.explode(around)).select("stream", F.col("a").alias("b"), F.col("la").alias("lb"), F.col("ta").alias("tb"), (F.col("eb") + F.col("o.i")).alias("eb"), (F.col("sb") + F.col("o.j")).alias("sb"))
    near = (F.abs(F.col("la") - F.col("lb")) <= end_frames) & (F.abs(F.col("ta") - F.col("tb")) <= start_seconds) & (F.col("a") < F.col("b"))
    return cell.join(other, ["stream", "eb", "sb"]).filter(near).select("stream", "a", "b")


def components(tracks: DataFrame, pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(stream, track_id, root): the member with the smallest (first_frame, id) of each component.

    Labels spread along the pairs and through their own labels (pointer jumping),
    so rounds grow with the logarithm of a chain; each round is cut by a checkpoint.
    """
    me = F.struct(F.col("first_frame").alias("f"), F.col("track_id").alias("i"))
    ensure_checkpoints(tracks)
    labels = tracks.select("stream", "track_id", me.alias("me"), me.alias("label")).checkpoint()
    edges = pairs.unionByName(pairs.select("stream", F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    for _ in range(rounds):
        heard = edges.join(labels.select("stream", F.col("track_id").alias("b"), "label"), ["stream", "b"]).groupBy("stream", F.col("a").alias("track_id")).agg(F.min("label").alias("heard"))
        spread = labels.join(heard, ["stream", "track_id"], "left").withColumn("near", F.least("label", "heard"))
        jump = spread.select("stream", F.col("track_id").alias("_t"), F.col("near").alias("_far"))
        after = spread.withColumn("_t", F.col("near.i")).join(jump, ["stream", "_t"]).select("stream", "track_id", "me", F.least("near", "_far").alias("label"), (F.least("near", "_far") != F.col("label")).alias("moved")).checkpoint()
        labels = after.drop("moved")
        if after.filter("moved").isEmpty():
            break
    return labels.select("stream", "track_id", F.col("label.i").alias("root"))


def ensure_checkpoints(df: DataFrame) -> None:
    """Use the session's checkpoint folder; only a local session without one gets a temporary one."""
    import tempfile

    context = df.sparkSession.sparkContext
    if context.getCheckpointDir():
        return
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="glyphtide-"))


def relabel(tracked: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with their track_id replaced by its component's root."""
    found = tracked.join(roots, ["stream", "track_id"], "left")
    return found.withColumn("track_id", F.coalesce("root", "track_id")).drop("root")
