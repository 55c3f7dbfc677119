import gzip
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from glyphtide.llm import urls, warc

PAGES = "page_id long, url string, html string, size long, h1 long, offset long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], PAGES).repartition(3)


def awkward():
    same = "<p>" + "x" * 200
    return [
        (1, "https://a.example.org/1", same), (2, "https://b.example.org/2", same), (3, "http://c.example.com/\r\n x?y", "short"), (4, None, "short"), (5, "", None), (6, "nothing", ""),
        (7, "https://a.example.org/1", "line\r\n\r\nWARC/1.1\r\n\r\n" * 20), (8, "https://ü.example/ä", "ü" * 60_000), (None, "https://a.example.org/1", same + "!"), (9, "https://a.example.org/1", same),
    ]


def test_archives_round_trip(spark):
    got = {r.page_id: r for r in warc.archive_pages(pages(spark, awkward())).collect()}
    assert len(got) == 10
    for page_id, _, html in awkward():
        payload = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert {i: got[i].refers_to for i in got if got[i].record_type == "revisit"} == {2: 1, 9: 1}
    assert warc.archive_pages(pages(spark, [])).collect() == []


def test_index_is_ordered_across_ranges(spark):
    rng = random.Random(3)
    rows = [(i, f"https://{'hot' if i % 3 == 0 else rng.choice('abcde')}.example/{rng.randint(0, 3) if i % 3 else 0}", f"page {i}") for i in range(600)]
    runs = warc.read_runs(spark, _written(spark, pages(spark, rows)))
    got = warc.merge_index(runs, range_rows=50).orderBy("range_no", "position").collect()
    keys = [(r.url_key, r.captured_at, r.page_id) for r in got]
    assert keys == sorted(keys) and len(keys) == 600 and len({r.range_no for r in got}) > 5
    assert all(r.offset >= 0 and r.length > 0 for r in got)


def _written(spark, frame):
    from glyphtide.llm.common import scratch_path

    path = scratch_path(spark, "test-warc")
    warc.write_archives(warc.plan_records(frame), path)
    return path


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=12), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_reader_takes_gzip_members():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    blocks = [b"a" * n for n in (0, 5, 300_000)]
    data = b"".join(gzip.compress(record % (len(b), b)) for b in blocks)
    assert [b for _, b, _, _ in warc.parse_records(data)] == blocks
    assert list(warc.parse_records(gzip.compress(b""))) == []


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    cut = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return host, path[:cut]


def verdict_of(url, listed):
    host, path = parts_of(url)
    fits = [(len(h) + len(p), h + p, kind) for kind, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, kind = max(fits)[1:] if fits else (None, None)
    return host, path, rule, kind or ("block" if listed else "allow"), listed


def test_url_filter(spark):
    given_urls = [
        None, "", "no scheme", "https://A.B.example.org/es/1", "https://example.org/en/12", "https://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/1", "HTTP://X.COM/de?x", "https://bad.net/p/?utm_source=1&b=2&a=1#f",
        "http://www.bad.net:80/p?a=1&b=2", "https://bad.net/p", "https://bad.net/q", "://", "a://b://c/d", "https://org/", "https://org", "https://xorg/", "https://É.net/", "https://bad.net/p?a=1&b=2&ref=z", "x" * 100_000,
    ]
    rows = [(i, u, "h") for i, u in enumerate(given_urls)] + [(0, None, "h"), (12, "https://bad.net/q", "h")]
    listed = spark.createDataFrame([("https://bad.net/p?b=2&a=1", 1), ("https://bad.net/p?b=2&a=1", 2), (None, 3), ("junk", 4)], "url string, page_id int")
    got = sorted(urls.judge_urls(pages(spark, rows), listed).collect(), key=str)
    hits = {9, 10, 19}
    want = sorted(((i, *verdict_of(u, i in hits)) for i, u, _ in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert urls.judge_urls(pages(spark, []), listed).collect() == []
    none = urls.judge_urls(pages(spark, rows), listed.filter("false"))
    assert none.filter("listed").count() == 0 and none.count() == len(rows)


def test_bloom_filter_passes_every_listed_url(spark):
    listed = spark.range(5000).selectExpr("concat('https://s', id, '.net/', id) as url")
    rows = spark.range(20_000).selectExpr("id as page_id", "concat('https://s', id, '.net/', id) as url")
    got = urls.judge_urls(rows, listed)
    assert got.filter("listed").count() == 5000 and got.filter("listed and page_id >= 5000").count() == 0
    assert got.filter("verdict = 'block'").count() == 5000


def test_a_query_with_a_line_break_is_whole(spark):
    pages = spark.createDataFrame([(1, "http://bad.net/p?a=1\nb=2"), (2, "http://bad.net/p"), (3, "http://BAD.net/p?b=3&a=1\nb=2")], "page_id long, url string")
    listed = spark.createDataFrame([("http://bad.net/p",), ("http://bad.net/p?a=1\nb=2&b=3",)], "url string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(pages, listed).collect()} == {1: "allow", 2: "block", 3: "block"}


def test_archives_are_cut_by_records_and_a_common_payload_is_not_dealt_by_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = [(i, f"http://h{i}.net/", "x" * 500 if i % 3 else f"<p>{i}</p>" * 30, "d", 1, "a") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, refers_to long, archive string").repartition(2)
    got = {r.page_id: r for r in warc.archive_pages(pages, f"{tmp_path}/a").collect()}
    assert len(list((tmp_path / "a").glob("*.gz"))) > 8 and len({r.archive for r in got.values()}) > 8
    assert all((r.record_type, r.refers_to) == (("revisit", 1) if i % 3 and i != 1 else ("response", None)) for i, r in got.items())
    assert all(r.payload_bytes == len(rows[i][2]) for i, r in got.items())
