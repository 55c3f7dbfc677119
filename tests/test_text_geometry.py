import json
import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphtide.functions import geometry as G
from glyphtide.functions import text as T

ODD = ["", " ", "a  b", "Ａｂｃ　１２３", "ﬁne", "Straße ẞ ς", "改造 人間!", "é é", "\x1cx\x1f y z\x85", "İı", "²³½", "a​b", "한국어 자막", "퟿", "x" * 5000]


def column(spark, values, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").repartition(2)
    return [r.x for r in frame.select("i", make(F.col("s")).alias("x")).orderBy("i").collect()]


def test_clean_text_and_key_match_python(spark):
    clean = [" ".join(unicodedata.normalize("NFKC", s).split()) for s in ODD]
    assert column(spark, [*ODD, None], T.clean_text) == [*clean, ""]
    assert column(spark, [*ODD, None], T.merge_key) == [*map(T.key_of, ODD), None]


TEXTS = st.text(alphabet="abAB12 !\n\r\x0b éßＡ", max_size=40)


def test_lines_and_dedupe_match_their_python_twins(spark):
    import random

    rng = random.Random(5)
    pieces = ["abcd", "abcdef", "xxabcdefyy", "Ab-cd!", "", "...", "12", "1234 5678", "zz", "改造人間", "人間"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 7))) for _ in range(300)] + ["a\r\nb\x0bc d", "\n\na\n", "x"]
    assert column(spark, texts, lambda c: T.dedupe_lines(c)) == [T.unrepeated(t) for t in texts]
    assert column(spark, texts, T.dedupe_lines_udf(2)) == [T.unrepeated(t, 2) for t in texts]
    assert column(spark, texts, T.text_lines) == [t.splitlines() for t in texts]


def test_repeated_and_contained_lines():
    assert T.unrepeated("Hello there\n\nhello THERE!\nHello there, friend\n--\nthere") == "Hello there, friend\n--\nthere"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=9), st.text(alphabet="abc", min_size=1, max_size=9))
def test_containment_twin(a, b):
    short, long = sorted((a, b), key=len)
    want = len(short) >= 2 and short in long and (len(short) >= 6 or long.startswith(short) or long.endswith(short))
    assert T.contained(a, b, 2) == want


def test_safe_containment_of_japanese(spark):
    pairs = [("造人", "改造人間"), ("改造人間", "改造人間の話"), ("人間の話", "改造人間の話"), ("abcdef", "xxabcdefyy"), ("abcde", "xxabcdeyy")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    assert [r.x for r in frame.select(T.is_safe_containment(F.col("a"), F.col("b")).alias("x")).collect()] == [False, True, True, True, False]


def test_similarity_is_difflibs(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("ab" * 150, "ab" * 149 + "c"), (None, "x"), ("x", None)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    want = [None if None in p else SequenceMatcher(None, *p).ratio() for p in pairs]
    assert [r.x for r in frame.select(T.similarity(F.col("a"), F.col("b")).alias("x")).collect()] == want


def test_time_stamps(spark):
    values = [-1.0, 0.0, 0.0005, 0.0015, 1.2345, 59.9996, 3599.9999, 360000.0, 362439.5]
    frame = spark.createDataFrame([(v,) for v in values], "s double")
    got = frame.select(T.srt_timestamp(F.col("s")).alias("a"), T.display_timestamp(F.col("s")).alias("b")).collect()

    def shown(ms):
        return f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"

    assert [r.a for r in got] == [shown(round(max(v, 0) * 1000)) for v in values]
    assert [r.b for r in got] == [shown(int(max(v, 0) * 1000 + 0.5)) for v in values]
    assert column(spark, ["01:30", "2:05", "x", "1:2:3", "", None], T.parse_clock) == [90.0, 125.0, 0.0, 0.0, 0.0, 0.0]


def test_model_answers(spark):
    values = ["<think>a\nb</think>  x", "```json\n[1]\n``` tail", "a <think>open", None, "```\nx```", "OCR: Hi\nyou", "ocr:x", "see OCR: y"]
    assert column(spark, values, T.clean_model_text) == ["x", "[1]", "a <think>open", "", "x", "OCR: Hi\nyou", "ocr:x", "see OCR: y"]
    assert column(spark, values[5:], T.clean_plain_text) == ["Hi you", "x", "see OCR: y"]
    answers = [json.dumps("plain"), json.dumps(["a", {"text": "b"}, {"content": "c"}, {"z": 1}, 5]), "{}", "broken", None]
    assert column(spark, answers, T.response_text) == ["plain", "abc", "", "", ""]

    def wanted(items):
        out = []
        for x in items:
            named = (x.get("text") or x.get("content") or "") if isinstance(x, dict) else x
            out.append(named if isinstance(named, str) else "")
        return "".join(out)

    hollow = ["", None, 0, 0.0, False, [], {}]
    lists = [[{"text": a, "content": b}, "|"] for a in [*hollow, "t", "0", 5, True, ["x"], {"k": 1}] for b in [*hollow, "c", "false", 7]] + [[{"content": "c"}, {"text": "t"}, {}, 3, None, ["no"], "s"]]
    assert column(spark, [json.dumps(x) for x in lists], T.response_text) == [wanted(x) for x in lists]


def test_addresses(spark):
    values = [" http://h:1/v1/ ", "http://h", "", None, "http://h/api/v1", "http://h/v1?x=1#y"]
    assert column(spark, values, T.base_url) == ["http://h:1/v1", "http://h/v1", None, None, "http://h/api/v1", "http://h/v1?x=1#y/v1"]
    assert column(spark, values[:2] + values[4:], T.metrics_url) == ["http://h:1/metrics", "http://h/metrics", "http://h/api/metrics", "http://h/metrics"]
    assert column(spark, ["a b/ü*.mp4"], T.media_url) == ["a%20b/%C3%BC%2A.mp4"]
    names = ["x.MP4", "x.avi", "x.mov", "x.mkv", "x.webm", "x.mpg", "x.mpeg", "x.wmv", "x.srt", "mp4", "x.flv", "x.m4v", "x.mp4\n"]
    assert column(spark, names, T.is_video_file) == [True] * 8 + [False] * 5


def test_text_blocks(spark):
    rows = [
        ([0.1, 0.2, 0.5, 0.6], 2000, 1000), ([100.0, 200.0, 500.0, 600.0], 1001, 501), ([1500.0, 700.0, 1200.0, 300.0], 1920, 1080), ([10.0, 10.0, 10.0, 20.0], 100, 100), ([-5.0, 0.0, 2000.0, 2000.0], 100, 100),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b array<double>, w int, h int")
    got = [r.x and (r.x.normalized_bbox, r.x.pixel_bbox) for r in frame.select("i", G.text_block(F.col("b"), F.col("w"), F.col("h")).alias("x")).orderBy("i").collect()]
    assert got[0] == ([100, 200, 500, 601], [200, 200, 1000, 599]) or got[0][1] == [round(0.1 * 1999), round(0.2 * 999), round(0.5 * 1999), round(0.6 * 999)]
    assert got[1] == ([100, 200, 500, 600], [100, 100, 500, 300])
    assert got[2][1] == [1200, 300, 1500, 700]
    assert got[3] is None and got[4][1] == [0, 0, 99, 99]


def test_boxes(spark):
    frame = spark.createDataFrame([([10.0, 10.0, 20.0, 20.0], [15.0, 15.0, 25.0, 25.0]), ([0.0, 0.0, 5.0, 5.0], [6.0, 6.0, 9.0, 9.0]), ([1.0] * 4, [1.0] * 4)], "a array<double>, b array<double>")
    assert [r.x for r in frame.select(G.iou(F.col("a"), F.col("b")).alias("x")).collect()] == pytest.approx([25 / 175, 0, 0])
    crops = spark.createDataFrame([([2, 3, 12, 33],), ([90, 90, 99, 99],), ([5, 5, 5, 9],)], "b array<int>")
    got = [r.x for r in crops.select(G.padded_crop(F.col("b"), F.lit(100), F.lit(100)).alias("x")).collect()]
    assert got == [[0, 0, 21, 42], [82, 82, 100, 100], None]
    full = spark.createDataFrame([([0, 0, 1000, 1000],), ([5, 5, 995, 995],), ([6, 0, 1000, 1000],)], "b array<int>")
    assert [r.x for r in full.select(G.is_full_frame(F.col("b")).alias("x")).collect()] == [True, True, False]


def test_progress(spark):
    frame = spark.createDataFrame([(0.0, 5.0), (100.0, 5.0), (50.0, 90.0), (1.0, 3600.0), (10.0, None)], "p double, e double")
    got = [r.x for r in frame.select(G.time_left(F.col("p"), F.col("e")).alias("x")).collect()]
    assert got == ["TBD", "00:00:00", "00:01:30", "03:00:00", "TBD"]
