import pytest
from pyspark.sql import functions as F

from glyphtide.sources import frames, sinks


def test_spans(spark):
    rows = [("a", 10.0, 95, 1.25, None), ("b", 29.97, 1000, None, 2.0)]
    got = frames.frame_spans(spark.createDataFrame(rows, "stream string, fps double, frame_count int, start_time double, end_time double")).collect()
    assert [(r.first, r.last, r.total) for r in got] == [(12, 95, 83), (0, 59, 59)]


def test_masks_need_full_screen(spark):
    one = spark.range(1)
    args = (F.lit(1), F.lit(1), F.lit(5), F.lit(5), F.lit(100), F.lit(100))
    assert one.select(frames.mask_area(F.lit(True), *args).alias("m")).first().m == [1, 1, 6, 6]
    with pytest.raises(Exception, match="full-screen"):
        one.select(frames.mask_area(F.lit(False), *args).alias("m")).collect()


def test_frames_from_files(spark, tmp_path):
    (tmp_path / "v").mkdir()
    for k in (1, 2, 10):
        (tmp_path / "v" / f"{k:06d}.png").write_bytes(bytes([k]))
    got = frames.image_frames(spark, f"{tmp_path}/*/*.png", after=1).collect()
    assert {(r.stream, r.frame_number, bytes(r.image)) for r in got} == {("v", 2, b"\x02"), ("v", 10, b"\n")}
    wanted = spark.createDataFrame([("v", 2), ("v", 3)], "stream string, frame_number long")
    assert [(r.saved, r.skipped) for r in frames.targets_found(wanted, frames.image_frames(spark, f"{tmp_path}/*/*.png")).collect()] == [(1, 1)]


def test_settings():
    s = sinks.Settings.load('{"llm_base_url": " http://h/ ", "recognizer_llm_base_url": "http://r/v1", "unknown": 1}')
    assert (s.detector_llm_base_url, s.recognizer_llm_base_url) == ("http://h/v1", "http://r/v1")
    assert sinks.Settings.load("{broken") == sinks.Settings() == sinks.Settings.load(None) == sinks.Settings.load("[1]")
    assert sinks.Settings.load(s.dump()) == s and s.changed(docker_url=" x ").docker_url == "x"
    with pytest.raises(ValueError, match="unknown"):
        s.changed(nope=1)
    assert [sinks.number_setting(v, 16, 1) for v in (None, "x", "0", "5")] == [16, 16, 1, 5]
    assert [sinks.flag_setting(v, True) for v in (None, "no", "OFF", "1")] == [True, False, False, True]


def test_tasks_outlive_a_job(spark, tmp_path):
    sinks.save_tasks(spark.createDataFrame([(1, "running"), (2, "completed")], "task_id int, status string"), f"{tmp_path}/t")
    assert {r.task_id: r.status for r in sinks.load_tasks(spark, f"{tmp_path}/t").collect()} == {1: "stopped", 2: "completed"}
