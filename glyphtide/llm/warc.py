"""WARC archives and their external index.

Archives are written by Spark's text writer (one row a record, records end in
two line breaks, gzip a file), so they reach any file system Spark knows and
commit whole. Each archive is read back into a capture run sorted by URL key and
time. The runs are cut at the same key boundaries, and every range is merged
from its k run slices by a loser tree, so the index is ordered across ranges
as well as within them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, scratch_path, settle
from .urls import canonical

#: Payloads below so many bytes are always stored whole.
REVISIT_BYTES = 100
#: Plain bytes of an archive, about: an archive is read whole by one task.
ARCHIVE_BYTES = 64 << 20
#: Payloads with this share of all pages and more are so few that they are sent to every executor.
HOT_SHARE = 1e-4
#: Captures of one merged range, about.
RANGE_ROWS = 100_000
#: Time of the first capture, where the table has no column captured_at; a row's is so many seconds later as its page_id says.
FIRST_CAPTURE = 1_704_067_200

ENTRY = "url_key string, captured_at string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long, length long"


def _digests(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, payload_bytes) of each page; a null html is an empty payload."""
    require(pages, "page_id", "url", "html")
    html = F.coalesce(F.col("html"), F.lit(""))
    return settle(pages.select("page_id", F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes")), "warc-digests")


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, digests: DataFrame | None = None) -> DataFrame:
    """Digest each page and decide response or revisit; keeps the html.

    Of equal payloads of at least ``revisit_bytes``, the row with the smallest
    page_id is the response and the others revisit it. A null html is an empty
    payload. Rows that repeat a page_id and its payload are responses each.
    """
    digests = _digests(pages) if digests is None else digests
    long = digests.filter(F.col("payload_bytes") >= revisit_bytes)
    # One row for each page that shares a payload with an earlier one.
    first = long.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = settle(first, "warc-shared")
    # Pages of a very common payload aren't dealt by it: such payloads are at most 1 / HOT_SHARE.
    common = F.col("n") >= max(2, int(digests.count() * HOT_SHARE))
    hot = F.broadcast(first.filter(common))
    shared = long.join(hot, "payload_digest").unionByName(long.join(hot.select("payload_digest"), "payload_digest", "left_anti").join(first.filter(~common), "payload_digest"))
    later = shared.filter("page_id > refers_to").select("page_id", "refers_to", "payload_digest").distinct()
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    return keyed.join(later, ["page_id", "payload_digest"], "left")


def record_text(url: Column, payload: Column) -> Column:
    """The WARC record of a planned row, without the two line breaks that end it."""
    crlf = F.lit("\r\n")
    md5 = F.md5(F.concat_ws("|", F.lit("capture"), F.col("page_id").cast("string"), F.col("payload_digest")))
    uuid = F.concat_ws("-", *[F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")
    )
    block = F.when(revisit, head).otherwise(F.concat(head, payload))
    clean_url = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n\t ]", "")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), clean_url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Url-Key: "), F.coalesce(canonical(clean_url), F.lit(""))),
        F.concat(F.lit("WARC-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To-Page: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), crlf, crlf, block)


def write_archives(planned: DataFrame, path: str, records: int = 0) -> None:
    """Write planned rows as gzipped WARC files, of so many records at most (0: one file a task)."""
    planned.select(record_text(F.col("url"), F.col("html")).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def _inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Plain bytes of a file of one or more gzip members, piece by piece."""
    while data:
        d = zlib.decompressobj(31)
        piece = d.decompress(data, step)
        while piece or d.unconsumed_tail:
            yield piece
            piece = d.decompress(d.unconsumed_tail, step) if d.unconsumed_tail else d.flush()
            if not piece and not d.unconsumed_tail:
                break
        data = d.unused_data


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record; offsets are in the plain bytes."""
    pieces, buffer, base = _inflate(data), b"", 0

    def need(n: int) -> bool:
        nonlocal buffer
        if len(buffer) < n:
            got = [buffer]
            have = len(buffer)
            for piece in pieces:
                got.append(piece)
                have += len(piece)
                if have >= n:
                    break
            buffer = b"".join(got)
        return len(buffer) >= n

    while need(1):
        size = 1 << 12
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not need(len(buffer) + size):
                end = buffer.find(b"\r\n\r\n")
                break
        if end < 0:
            raise ValueError("a record's headers don't end")
        lines = buffer[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {base}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        total = end + 4 + length + 4
        if not need(total):
            raise ValueError("a record is cut off")
        yield headers, buffer[end + 4 : end + 4 + length], base, total
        buffer, base = buffer[total:], base + total


def read_runs(spark, path: str) -> DataFrame:
    """One locally sorted capture run an archive, in the schema ``ENTRY``.

    A response's digest and size come from its stored payload, and a digest that
    differs from its header is an error. A revisit has no payload; its digest
    and size are those its headers give.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ENTRY.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                archive, rows = name.as_py(), []
                for headers, block, offset, length in parse_records(content.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    size = len(payload)
                    if headers["warc-type"] == "revisit":
                        size = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    elif hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{archive}: the payload at {offset} doesn't have the digest that its header gives")
                    page, refers = headers["warc-page-id"], headers.get("warc-refers-to-page")
                    stamp = headers["warc-date"]
                    rows.append((headers["warc-url-key"], stamp, int(page) if page else None, headers["warc-type"], digest, size, int(refers) if refers else None, archive, offset, length))
                rows.sort(key=_order)
                for at in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[at : at + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k in (2, 5, 6, 8, 9) else pa.string()) for k, c in enumerate(cols)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").mapInArrow(run, ENTRY)


def _order(entry: Sequence) -> tuple:
    return entry[0], entry[1], -1 if entry[2] is None else entry[2]


class LoserTree:
    """Merge k sorted sequences with about log2(k) comparisons a row.

    Inner nodes hold the run that lost there; the overall winner is at node 0.
    """

    def __init__(self, runs: Sequence[Sequence], key=_order):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [self._head(r) for r in range(self.k)]
        self.tree = [-1] * max(1, self.k)
        for r in range(self.k):
            self._play(r)

    def _head(self, r: int):
        return (0, self.key(self.runs[r][self.at[r]]), r) if self.at[r] < len(self.runs[r]) else (1, (), r)

    def _play(self, r: int) -> None:
        """Send run r up from its leaf; losers stay behind."""
        node = (r + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = r
                return
            if self.heads[other] < self.heads[r]:
                self.tree[node], r = r, other
            node //= 2
        self.tree[0] = r

    def __iter__(self):
        while self.k:
            r = self.tree[0]
            if self.heads[r][0]:
                return
            yield self.runs[r][self.at[r]]
            self.at[r] += 1
            self.heads[r] = self._head(r)
            self._play(r)


def merge_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Merge sorted runs into one index ordered by url_key, captured_at, page_id.

    Adds range_no and position (from 0 in the range); ranges follow each other
    in key order. A single hot URL is cut by time and page as well, so no range
    outgrows ``range_rows`` by much, except for rows equal in all three.
    """
    n = max(1, -(-runs.count() // range_rows))
    names = runs.columns
    cut = runs.repartitionByRange(n, "url_key", "captured_at", "page_id", "archive", "offset")
    cut = cut.withColumn("range_no", F.spark_partition_id()).sortWithinPartitions("archive", "url_key", "captured_at", "page_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        where = 0
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols, strict=True):
                slices.setdefault(row[7], []).append(row[:-1])
                where = row[-1]
        out: list[tuple] = []
        position = 0

        def packed() -> pa.RecordBatch:
            arrays = [pa.array(c, pa.int64() if k in (2, 5, 6, 8, 9) else pa.string()) for k, c in enumerate(zip(*out, strict=True))]
            arrays += [pa.array([where] * len(out), pa.int32()), pa.array(range(position - len(out), position), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=[*names, "range_no", "position"])

        for row in LoserTree(list(slices.values())):
            out.append(row)
            position += 1
            if len(out) == 10_000:
                yield packed()
                out = []
        if out:
            yield packed()

    return cut.mapInArrow(run, f"{ENTRY}, range_no int, position long")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC archives, read them back, and return the merged index.

    Null html is an empty payload, null url an empty target; an empty table
    gives an empty index; other columns are ignored. Texts go through whole.
    An archive holds as many records as come to ``ARCHIVE_BYTES`` at their mean
    size; records are dealt by hash, so archives come near it.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    digests = _digests(pages)
    mean = digests.agg(F.avg("payload_bytes")).first()[0] or 0.0
    write_archives(plan_records(pages, digests=digests), path, max(1, int(ARCHIVE_BYTES / (mean + 1000))))
    return merge_index(settle(read_runs(spark, path), "warc-runs"))
