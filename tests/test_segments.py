import random

import pytest
from pyspark.sql import functions as F

from glyphtide.functions.text import key_of
from glyphtide.operators import cues, segments
from glyphtide.params import MergeParams

SCHEMA = "stream int, start double, end double, text string"


def frame(spark, rows, stream=1):
    return spark.createDataFrame([(stream, *r) for r in rows], SCHEMA)


def rows_of(df):
    return sorted((r.start, r.end, r.text) for r in df.collect())


def simple_equal(rows, gap):
    """A plain sequential model of merging equal cues."""
    kept = []
    for start, end, text in sorted(rows):
        home = next((k for k in reversed(kept) if key_of(text) and key_of(k[2]) == key_of(text) and start - k[1] <= gap), None)
        if home:
            home[1] = max(home[1], end)
            home[2] = text if len(text) > len(home[2]) else home[2]
        else:
            kept.append([start, end, text])
    return sorted(map(tuple, kept))


def random_cues(rng, n):
    out = []
    for _ in range(n):
        start = rng.randint(0, 40) / 2
        out.append((start, start + rng.randint(0, 6) / 2, rng.choice(["Hi", "hi!", "Yes", "...", "no", "NO?", ""])))
    return out


def test_merge_equal_is_the_sequential_merge(spark):
    rng = random.Random(1)
    streams = {i: random_cues(rng, rng.randint(0, 12)) for i in range(150)}
    df = spark.createDataFrame([(i, *r) for i, rows in streams.items() for r in rows], SCHEMA)
    got = {}
    for r in segments.merge_equal(df, 1.0).collect():
        got.setdefault(r.stream, []).append((r.start, r.end, r.text))
    for i, rows in streams.items():
        assert sorted(got.get(i, [])) == simple_equal(rows, 1.0)


def test_duplicate_gap(spark):
    rows = [(0.0, 1.0, "Hello there"), (2.5, 3.0, "hello, THERE")]
    assert len(rows_of(segments.merge_equal(frame(spark, rows), 1.0))) == 2
    assert rows_of(segments.merge_equal(frame(spark, rows), 2.0)) == [(0.0, 3.0, "hello, THERE")]


def test_interleaved_equal_cues_merge(spark):
    rows = [(0.0, 1.0, "one"), (0.5, 2.5, "other"), (1.5, 2.0, "one")]
    assert rows_of(segments.merge_equal(frame(spark, rows), 1.0)) == [(0.0, 2.0, "one"), (0.5, 2.5, "other")]


def test_contained_cues(spark):
    rows = [(0.0, 1.0, "good morn"), (1.2, 2.0, "good morning all")]
    assert rows_of(segments.merge_contained(frame(spark, rows))) == [(0.0, 2.0, "good morning all")]
    short = [(0.0, 1.0, "go"), (1.2, 2.0, "good morning")]
    assert len(rows_of(segments.merge_contained(frame(spark, short), least_key=4))) == 2
    assert rows_of(segments.merge_contained(frame(spark, short), least_key=2)) == [(0.0, 2.0, "good morning")]
    assert len(rows_of(segments.merge_contained(frame(spark, [(0.0, 1.0, "good morn"), (2.5, 3.0, "good morning all")])))) == 2


def test_similar_cues(spark):
    a = "abcdefghijklmnopqrstuvwxyz0123"
    rows = [(0.0, 1.0, a), (1.5, 2.0, a[:10] + "X" + a[11:])]
    assert len(rows_of(segments.merge_similar(frame(spark, rows), MergeParams(similar_threshold=0.99)))) == 2
    assert len(rows_of(segments.merge_similar(frame(spark, rows), MergeParams(similar_threshold=0.95)))) == 1
    lengths = [(0.0, 1.0, "abcdefghijklmnopqrst"), (1.5, 2.0, "abcdefghijklmnopqrstuvwxy")]
    for ratio, n in ((0.95, 2), (0.75, 1)):
        assert len(rows_of(segments.merge_similar(frame(spark, lengths), MergeParams(similar_threshold=0.8, similar_length_ratio=ratio)))) == n


def test_passes_reach_a_fixed_point(spark):
    rows = [(0.0, 1.0, "good morn"), (1.5, 2.5, "good morning"), (3.0, 4.0, "good morning everyone")]
    got = segments.postprocess(frame(spark, rows)).collect()
    assert [(r["index"], r.start, r.end, r.text) for r in got] == [(1, 0.0, 4.0, "good morning everyone")]


def test_short_cues_go(spark):
    rows = [(0.0, 0.5, "exact"), (2.0, 2.49, "below"), (5.0, 5.51, "above")]
    assert [r.text for r in segments.postprocess(frame(spark, rows)).collect()] == ["above"]


def test_chunks_change_nothing(spark):
    rng = random.Random(9)
    words = ["good morning", "good morn", "good morning all", "nothing else here", "nothing else hera", "x", "..."]
    streams = {}
    for i in range(60):
        at, rows = 0.0, []
        for _ in range(rng.randint(1, 15)):
            at += rng.choice([0.5, 1.0, 2.0, 5.0])
            rows.append((at, at + rng.choice([0.5, 1.0, 3.0]), rng.choice(words)))
        streams[i] = rows
    p = MergeParams(similar_threshold=0.9)
    df = spark.createDataFrame([(i, *r) for i, rows in streams.items() for r in rows], SCHEMA)
    got = {}
    for r in segments.postprocess(df, p).collect():
        got.setdefault(r.stream, []).append((r.start, r.end, r.text))
    for i, rows in streams.items():
        whole = [c for c in segments.settle_cues(rows, p) if c[1] - c[0] > p.min_duration_sec]
        assert sorted(got.get(i, [])) == sorted(whole)


def test_sweep_equals_single_runs(spark):
    rows = [(0.0, 1.0, "good morn"), (1.5, 2.5, "good morning"), (4.0, 5.0, "good morning")]
    given = {"a": MergeParams(), "b": MergeParams(duplicate_gap_sec=0.5, contained_gap_sec=0.1)}
    got = segments.sweep(frame(spark, rows), given).collect()
    for name, p in given.items():
        one = segments.postprocess(frame(spark, rows), p).collect()
        assert sorted((r["index"], r.start, r.end, r.text) for r in got if r.params == name) == sorted((r["index"], r.start, r.end, r.text) for r in one)


def test_parameters():
    assert MergeParams.of(None) == MergeParams() and MergeParams.of({"min_duration_sec": 1.0}).min_duration_sec == 1.0
    with pytest.raises(ValueError, match="unknown"):
        MergeParams.of({"nope": 1})
    with pytest.raises(ValueError, match="similar_threshold"):
        MergeParams(similar_threshold=0.8).checked()
    assert MergeParams().checked() == MergeParams()


def test_metrics_and_lookup(spark):
    df = frame(spark, [(0.0, 1.5, "a\nb"), (1.0, 2.0, "c"), (5.0, 4.0, "back")])
    r = cues.metrics(df).first()
    assert (r["count"], r.total_sec, r.mean_sec, r.min_sec, r.max_sec, r.multi_line) == (3, 2.5, 0.833, 0.0, 1.5, 1)
    points = spark.createDataFrame([(1, t) for t in (0.0, 1.2, 2.0005, 2.5, 99.0)], "stream int, t double")
    for width in (0.5, 60.0):
        got = {r.t: r.text for r in cues.active_at(points, df, width=width).collect()}
        assert got == {0.0: "a\nb", 1.2: "a\nb\nc", 2.0005: "c"}


def test_srt_files(spark, tmp_path):
    df = segments.number(frame(spark, [(1.0, 2.0, "two\nlines"), (0.0, 1.0, "first")]))
    text = cues.srt_text(df).first().srt
    assert text == "1\n00:00:00,000 --> 00:00:01,000\nfirst\n\n2\n00:00:01,000 --> 00:00:02,000\ntwo\nlines\n"
    known = cues.languages(df, lambda c: F.when(F.contains(c, F.lit("first")), "en"))
    assert known.first().language == "en"
    streams = spark.createDataFrame([(1,), (2,)], "stream int")
    for _ in range(2):
        cues.write_srt(df, str(tmp_path / "srt"), known, streams)
        files = {p.name: p.read_bytes() for p in (tmp_path / "srt").iterdir() if not p.name.startswith(".")}
        assert files == {"1.en.srt": text.encode(), "2.un.srt": b""}
    named = segments.number(frame(spark, [(0.0, 1.0, "x\n")])).withColumn("stream", F.lit("a b%=ü"))
    cues.write_srt(named, str(tmp_path / "more"))
    assert (tmp_path / "more" / "a b%=ü.un.srt").read_bytes() == b"1\n00:00:00,000 --> 00:00:01,000\nx\n\n"
    assert cues.languages(df, lambda c: F.lit(None).cast("string")).first().language == "un"
