import json
import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphtide.functions.text import key_of
from glyphtide.operators import control, eventlog, layout, linking, tasks, tracks, vote
from glyphtide.operators.recognition import recognize
from glyphtide.plans import registry
from glyphtide.plans.captions import captions
from glyphtide.sources import logs

WORDS = ["good morning", "good morning!", "good mornin", "evening", "...", "", None]


def simple_tracks(rows):
    """A plain sequential model of the single-box tracker."""
    made, now, last, before, out = 0, None, "", None, []
    for frame, text, status in rows:
        gap = before is not None and frame - before > 6
        before = frame
        if text is None:
            now, last = None, ""
            out.append(None)
        elif status != "ok":
            out.append(now if now and not gap else None)
        elif not key_of(text):
            now, last = None, ""
            out.append(None)
        else:
            key = key_of(text)
            if now is None or gap or not last or SequenceMatcher(None, key, last).ratio() < 0.86:
                made += 1
                now = made
            last = key
            out.append(now)
    return out


def test_crop_tracks_are_the_sequential_tracker(spark):
    rng = random.Random(2)
    streams, rows = {}, []
    for s in range(150):
        frame, seq = 0, []
        for _ in range(rng.randint(1, 14)):
            frame += rng.choice([1, 1, 1, 6, 7, 9])
            seq.append((frame, rng.choice(WORDS), rng.choice(["ok", "ok", "ok", "truncated"])))
        streams[s] = seq
        rows += [(s, k, *r) for k, r in enumerate(seq)]
    df = spark.createDataFrame(rows, "stream int, ord int, frame long, text string, status string")
    got = {}
    for r in tracks.crop_tracks(df).orderBy("stream", "ord").collect():
        got.setdefault(r.stream, []).append(r.track_id)
    for s, seq in streams.items():
        assert got[s] == simple_tracks(seq), seq


def test_full_tracks_keep_two_boxes_apart(spark):
    rows = []
    for f in range(9):
        rows += [("v", f, 0, [100, 100 + f, 400, 200 + f], "upperline"), ("v", f, 1, [100, 700, 400, 800], "lowerline")]
    rows += [("v", 9, None, None, None), ("v", 30, 0, [100, 700, 400, 800], "other")]
    for f in range(10, 18):
        rows.append(("v", f, None, None, None))
    df = spark.createDataFrame(rows, "stream string, frame long, det_index int, box array<int>, key string")
    got = {(r.frame, r.det_index): r.track_id for r in tracks.full_tracks(df).collect()}
    assert len({got[f, 0] for f in range(9)}) == len({got[f, 1] for f in range(9)}) == 1
    assert got[0, 0] != got[0, 1] and got[30, 0] not in (got[0, 0], got[0, 1]) and len(got) == 19


def test_reading_order(spark):
    rows = [("v", 1, 1, 0, [0, 50, 100, 60], "below"), ("v", 1, 1, 1, [60, 0, 100, 10], "right"), ("v", 1, 1, 2, [0, 0, 50, 10], "left"), ("v", 2, 1, 0, [0, 0, 10, 100], "second"), ("v", 2, 1, 1, [50, 0, 60, 100], "first"), ("v", 2, 1, 2, [50, 200, 60, 300], "")]
    df = spark.createDataFrame(rows, "stream string, frame int, track_id int, det_index int, box array<int>, text string")
    assert {r.frame: r.text for r in tracks.frame_texts(df).collect()} == {1: "left\nright\nbelow", 2: "first\nsecond"}


def test_linking_is_the_transitive_closure(spark):
    rng = random.Random(3)
    rows = [(s, t, rng.randint(0, 30), rng.random() * 8, rng.randint(0, 60)) for s in range(20) for t in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "stream int, track_id long, first_frame int, first_time double, last_frame int")
    pairs = {(r.stream, r.a, r.b) for r in linking.band_pairs(df).collect()}
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and abs(a[4] - b[4]) <= 6 and abs(a[3] - b[3]) <= 2.0}
    assert pairs == want
    root = {(r[0], r[1]): (r[2], r[1]) for r in rows}
    for _ in rows:
        for s, a, b in want:
            root[s, a] = root[s, b] = min(root[s, a], root[s, b])
    got = {(r.stream, r.track_id): r.root for r in linking.components(df, linking.band_pairs(df)).collect()}
    assert got == {k: v[1] for k, v in root.items()}


def test_votes(spark):
    rows = [("a", "Hello", 3, 0), ("a", "hello!", 2, 1), ("a", "HELLO", 1, 2), ("a", "bye", 5, 3), ("b", "good", 10, 0), ("b", "good day", 4, 1), ("c", "good", 10, 0), ("c", "good day", 3, 1), ("d", "...", 9, 0)]
    df = spark.createDataFrame(rows, "group string, text string, count long, first_seen long")
    assert {r.group: r.text for r in vote.representative(df).collect()} == {"a": "Hello", "b": "good day", "c": "good"}


QUAD = [[0, 0], [1000, 0], [1000, 1000], [0, 1000]]


def write_log(path, records):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in records), encoding="utf-8")


def test_tolerant_log(spark, tmp_path):
    item = {"text": "x", "quad": QUAD}
    write_log(
        tmp_path / "v.jsonl",
        [
            {"record_type": "detector", "frame_number": 1, "blocks": [{"normalized_bbox": [1, 2, 3, 4], "pixel_bbox": [1, 2, 3, 4]}, {"normalized_bbox": [1]}, 5]},
            {"record_type": "detector", "frame_number": 2, "detector_blocks": None, "blocks": [{"normalized_bbox": [1, 2, 3, 4], "pixel_bbox": [1, 2, 3, 4]}]},
            {"record_type": "ocr", "frame_number": "3", "time": 0.1, "spotting_items": [item]},
            {"record_type": "ocr", "frame_number": 3, "time": 0.2, "spotting_items": [], "ocr_mode": "crop"},
            {"frame_number": 4, "spotting_items": [item]},
            {"record_type": None, "frame_number": 5, "spotting_items": [item]},
            {"record_type": "ocr", "frame_number": "x"}, {"record_type": "ocr"}, "", "{broken", "[1]", "7", {"record_type": "new", "frame_number": 9},
        ],
    )
    lines = logs.log_lines(spark, str(tmp_path))
    assert {(r.stream, r.frame_number): len(r.blocks) for r in eventlog.detector_state(lines).collect()} == {("v", 1): 1, ("v", 2): 0}
    got = {r.frame_number: r for r in eventlog.recognizer_state(lines).collect()}
    assert set(got) == {3, 4} and got[3].time == 0.2 and got[3].ocr_mode == "crop" and got[4].spotting_items[0].text == "x"
    kept = eventlog.compact(lines, spark.createDataFrame([("v", 4), ("v", 8)], "stream string, frame_number long")).collect()
    assert [json.loads(r.value) for r in kept] == [{"frame_number": 4, "time": 0.0, "spotting_items": [{"text": "x", "quad": QUAD}]}]
    assert logs.log_lines(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="."):
        eventlog.strict_records(lines).collect()


def test_detector_lines_of_far_frames(spark, tmp_path):
    # Seconds from 1e7, 9e12, 1e16 and 1e17 on, on both sides of each; texts that are empty or have no length.
    ids = [0, 1, -3, 79_999_999, 80_000_000, 80_000_001, -80_000_004, 60 * 10**9 + 5, 69_999_999_999_997]
    far = [76_263_673_800_609, 9_007_199_254_740_993, 56_865_130_178_914_472, 8 * 10**16 - 8, 8 * 10**16, 984_967_795_971_427_005, 2**63 - 1, 1 - 2**63]
    rows = [(i, 7) for i in ids + far] + [(10**9, 0), (10**9 + 1, 1), (10**9 + 2, None), (None, 7)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in registry.log_serialize(spark, str(tmp_path)).select("doc_id", "line").collect()]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(got, key=str) == sorted(con.sql(registry.SQL["log_serialize"]).fetchall(), key=str)
    lines = dict(got)
    for i in ids:
        block = {"normalized_bbox": [0, 0, 1000, 1000], "pixel_bbox": [0, 0, 6, 9]}
        want = {"record_type": "detector", "frame_number": i, "time": round(i / 8.0, 3), "detector_blocks": [block]}
        assert lines[i] == json.dumps(want, separators=(",", ":"))


def test_context(spark):
    rows = [(None, None, None, True), ("full_screen", [0, 0, 9, 9], None, True), ("full_screen", [0, 0, 9, 8], None, False), ("full_screen", [0, 0, 9, 9], [1, 1, 2, 2], False), ("crop", [0, 0, 9, 9], None, False)]
    df = spark.createDataFrame(rows, "mode string, area array<int>, mask array<int>, want boolean")
    got = df.select("want", eventlog.compatible(F.col("mode"), F.col("area"), F.col("mask"), F.lit("full_screen"), F.array(*map(F.lit, (0, 0, 9, 9))), F.lit(None).cast("array<int>")).alias("x"))
    assert all(r.want == r.x for r in got.collect())


def test_captions_from_a_log(spark, tmp_path):
    crop, full, n = [], [], 0
    for run, text in enumerate(["Hello there", "See you soon"]):
        for _ in range(7):
            n += 1
            status = {} if run else {"text_status": "ok"}
            crop.append({"frame_number": n + run * 20, "time": (n + run * 20) / 10, "spotting_items": [{"text": text, "quad": QUAD, **status}], "ocr_mode": "crop", "ocr_area": [0, 0, 9, 9]})
    top, low = [[100, 100], [900, 100], [900, 200], [100, 200]], [[100, 210], [900, 210], [900, 300], [100, 300]]
    for f in range(1, 11):
        cut = f == 5
        full.append({"frame_number": f, "time": f / 10, "spotting_items": [{"text": "upper text", "quad": top}, {"text": "" if cut else "lower words", "quad": low, "text_status": "truncated" if cut else "ok"}], "ocr_mode": "full_screen"})
    write_log(tmp_path / "crop.jsonl", crop)
    write_log(tmp_path / "full.jsonl", full)
    got = captions(eventlog.strict_records(logs.log_lines(spark, str(tmp_path)))).orderBy("stream", "index").collect()
    assert [(r.stream, r["index"], r.text) for r in got] == [("crop", 1, "Hello there"), ("crop", 2, "See you soon"), ("full", 1, "upper text\nlower words")]
    assert (got[0].start, got[0].end, got[2].start, got[2].end) == (0.1, 0.7, 0.1, 1.0)


def test_layout(spark):
    html = '<div data-label="Text" data-bbox="100 100 200 200"><div data-label="Text" data-bbox="1 1 9 9"></div></div><div data-label="Picture" data-bbox="5 5 50 50"></div><div><div data-label="Section-Header" data-bbox="300,300,400,400"></div></div>'
    answers = [
        (1, html, 2000, 1000), (2, json.dumps([{"label": "Table", "bbox": "10 20 30 40"}, {"label": "Image", "bbox": "1 2 3 4"}, {"label": "Text", "box": [50, 60, "70", 80]}, {"bbox": "10 20 30 40"}, [1, 2, 3, 4], {"label": "Text", "bbox": "0 0 1000 998"}]), 1001, 1001),
        (3, '[{"label": "Text", "bbox": "10 20 30 40"}, {"label": "Text", "bbox": [50, 60, 70', 1001, 1001), (4, "", 10, 10), (5, '```json\n{"label": "Text", "bbox": "10 20 30 40"}\n```', 1001, 1001), (6, None, 10, 10),
    ]
    got = {}
    for r in layout.parse_layout(spark.createDataFrame(answers, "id int, content string, width int, height int")).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.normalized_bbox)
    assert got == {1: [[100, 100, 200, 200], [300, 300, 400, 400]], 2: [[10, 20, 30, 40], [50, 60, 70, 80], [1, 2, 3, 4]], 3: [[10, 20, 30, 40]], 5: [[10, 20, 30, 40]]}
    with pytest.raises(Exception, match="positive size"):
        layout.parse_layout(spark.createDataFrame([(1, "[]", 0, 5)], "id int, content string, width int, height int")).collect()


def test_blank_regions(spark):
    rows = [(1, 255, 255, 255)] * 100 + [(2, 0, 0, 0)] * 50 + [(2, 255, 255, 255)] * 50 + [(3, 7, 7, 7)] * 20
    got = {r.id: r.blank for r in layout.blank_regions(spark.createDataFrame(rows, "id int, c0 int, c1 int, c2 int")).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_load_metrics_and_limits(spark):
    text = '# x\nvllm:num_requests_running{engine="0"} 3.0\nvllm:num_requests_running{engine="1"} 4\n vllm_num_requests_running 99\nvllm_num_requests_waiting 2.5e0\n'
    df = spark.createDataFrame([(1, text), (2, "nothing")], "scrape_id int, payload string")
    got = {r.scrape_id: (r.running, r.waiting) for r in control.load_metrics(df).collect()}
    assert got == {1: (7, 2), 2: (None, None)}
    with pytest.raises(Exception, match="no running metric"):
        control.required(control.load_metrics(df)).collect()
    waiting = [0, 5, 2, None, 0, 200]
    series = spark.createDataFrame([(s, k, w) for s in "ba" for k, w in enumerate(waiting)], "stream string, seq long, waiting int").repartition(3)
    limits = lambda **options: [(r.stream, r.limit) for r in sorted(control.limit_series(series, **options).collect())]
    assert limits() == [(s, x) for s in "ab" for x in (18, 15, 15, 16, 18, 1)]
    assert {x for _, x in limits(enabled=False)} == {16}
    assert control.limit_series(series.filter("false")).collect() == []


def test_a_long_stream_of_samples_takes_linear_time(spark):
    import time

    took = []
    for n in (50_000, 400_000):
        samples = spark.range(n).select(F.lit("s").alias("stream"), F.col("id").alias("seq"), (F.col("id") % 7).cast("int").alias("waiting"))
        began = time.perf_counter()
        assert control.limit_series(samples).agg(F.count("limit")).first()[0] == n
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * took[0] + 3


def test_first_pending_frame_and_deleted_tasks(spark):
    need = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 5), ("c", 1)], "stream string, frame_number long")
    done = spark.createDataFrame([("a", 1), ("b", 5), ("z", 1)], "stream string, frame_number long")
    assert {r.stream: r.first_pending for r in eventlog.first_pending(need, done, done.filter("stream = 'b'")).collect()} == {"a": 2, "c": 1}
    df = spark.createDataFrame([(1, "d/a.b.mp4"), (2, ".hidden"), (3, ""), (4, None), (5, "x")], "task_id int, video string")
    gone = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,), (9,)], "task_id int")
    assert [r.task_id for r in tasks.without(df, gone).collect()] == [5]
    assert {r.task_id: r.log for r in tasks.logs_of(df, gone).collect()} == {1: "d/a.b.jsonl", 2: ".hidden.jsonl"}


def test_tasks(spark):
    df = spark.createDataFrame([(1, 5, "q", "a", "waiting"), (2, 3, "q", "a", "waiting"), (3, 1, "q", "b", "stopping"), (4, 9, "r", "c", "running"), (5, 1, "r", "c", "waiting")], "task_id int, seq int, queue string, video string, status string")
    assert [(r.queue, r.task_id) for r in tasks.next_task(df, ("queue",)).collect()] == [("q", 2)]
    assert {r.video: r.task_id for r in tasks.duplicate_of(df).collect()} == {"a": 2, "b": 3, "c": 5}
    actions = spark.createDataFrame([(1, "stop"), (3, "resume"), (4, "stop")], "task_id int, action string")
    assert {r.task_id: (r.status, r.accepted) for r in tasks.apply_actions(df, actions).collect()} == {1: ("stopped", True), 2: ("waiting", None), 3: ("stopping", False), 4: ("stopping", True), 5: ("waiting", None)}
    assert {r.status for r in tasks.restored(df).collect()} == {"stopped"}


def test_recognition_keeps_going(spark):
    class Fake:
        def recognize(self, image):
            if image == b"bad":
                raise RuntimeError("no")
            return image.decode(), "length" if image == b"long" else "stop"

    df = spark.createDataFrame([("v", 1, 0, b"hi"), ("v", 1, 1, b"bad"), ("v", 2, 0, b"long")], "stream string, frame_number long, block_index int, image binary")
    got = {(r.frame_number, r.block_index): (r.text, r.text_status, r.error) for r in recognize(df, Fake, 2).collect()}
    assert got == {(1, 0): ("hi", "ok", None), (1, 1): ("", "ok", "RuntimeError: no"), (2, 0): ("", "truncated", None)}


def test_file_lookups(spark, tmp_path):
    (tmp_path / "Zed").mkdir()
    for name in ("b.mp4", "A.mp4", "b.jsonl", "b.en.srt"):
        (tmp_path / name).write_text("x")
    assert [r.name for r in logs.listing(spark, str(tmp_path)).collect()] == ["Zed", "A.mp4", "b.en.srt", "b.jsonl", "b.mp4"]
    with pytest.raises(ValueError, match="below"):
        logs.listing(spark, f"{tmp_path}/../x")
    files = spark.createDataFrame([("/x/b.mp4", 1), ("/x/b.jsonl", 2), ("/x/b.en.srt", 3), ("/x/b.srt", 9)], "path string, modified int")
    assert [(r.stem, r.path) for r in logs.newest(files).collect()] == [("b", "/x/b.srt")]
    assert [(r.stem, r.path) for r in logs.sibling_videos(files).collect()] == [("b", "/x/b.mp4")]


def test_streaming_twins(spark, tmp_path):
    from glyphtide.streaming.tracks import append_compacted, stream_tracks

    rng = random.Random(4)
    seq, frame = [], 0
    for _ in range(40):
        frame += rng.choice([1, 1, 1, 7])
        seq.append((frame, rng.choice(WORDS), rng.choice(["ok", "ok", "truncated"])))
    schema = "stream string, frame long, text string, status string"
    for k, part in enumerate((seq[:15], seq[15:28], seq[28:])):
        spark.createDataFrame([("v", *r) for r in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream_tracks(source).writeStream.format("memory").queryName("followed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.frame: r.track_id for r in spark.table("followed").collect()}
    assert [got[f] for f, _, _ in seq] == simple_tracks(seq)

    lines = "stream string, frame_number long, line_no long, value string"
    spark.createDataFrame([("v", 1, 0, "old"), ("v", 1, 1, "new"), ("v", 2, 2, "x")], lines).coalesce(1).write.parquet(f"{tmp_path}/log")
    append_compacted(spark.readStream.schema(lines).parquet(f"{tmp_path}/log"), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination(120)
    assert {(r.frame_number, r.value) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "new"), (2, "x")}
