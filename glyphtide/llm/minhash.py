"""Near duplicates by improved consistent weighted sampling (ICWS).

A text is the weighted set of its five-word shingles, weighed by TF-IDF. ICWS
draws one (shingle, level) of each hash so that two texts draw the same one with
the probability of their weighted Jaccard similarity. Bands of draws name
candidates, whose similarity is then computed in full; links join into classes.

A small bucket's texts are compared all with all; those of a crowded one with its
first. Where some don't link to that, texts of crowded buckets also meet by the
rarest shingles of each (prefix filtering): two texts share nothing before their
first common shingle, so each has to have enough weight from there on for the
overlap of similar texts. So each two of these that share a bucket end in one class.

Document frequencies come from all distinct texts, in a table of hashed counters
of fixed size: counters are shared by shingles, so a frequency is never too low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, pick, require, settle, two_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 9, 3
#: Bits of a shingle's hash.
HASH_BITS = 44
#: Counters of document frequency.
COUNTERS = 1 << 18
#: Characters that are cut into shingles at once; each takes some 50 bytes meanwhile.
CHUNK_CHARS = 1 << 19
#: Stands for a null doc_id.
NO_ID = -(1 << 62)
#: Values in each table of random variates.
TABLE = 1 << 16
#: Texts of a bucket that are compared all with all, at most.
FULL = 16
#: Texts that a task joins with all others of a shingle, about.
SLICE = 256
#: Rows of a table that is sent to every executor, at most (some 10 MB).
BROADCAST_ROWS = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_SEP = np.ones(256, dtype=bool)
for _c in (*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)):
    _SEP[_c] = False
#: Powers of an odd number, mod 2**64: the place of a byte in its word.
_POWER = np.ones(256, dtype=np.uint64)
for _c in range(1, 256):
    with np.errstate(over="ignore"):
        _POWER[_c] = _POWER[_c - 1] * np.uint64(0x100000001B3)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


def shingle_batch(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct five-word shingles of many texts: hashes, counts, and where each text starts.

    Words are runs of ASCII letters and digits and of all characters beyond
    ASCII, lower-cased. A text of one to four words is one shingle; a text
    without words has none. Work is linear in the texts but for one sort.
    """
    coded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join(coded) + b" ", dtype=np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(c) + 1 for c in coded])))
    sep = _SEP[raw]
    inside = ~sep
    starts = np.flatnonzero(inside & np.concatenate(([True], sep[:-1])))
    n_texts = len(coded)
    if not starts.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n_texts + 1, np.int64)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    place = np.arange(at.size) - np.repeat(first, np.diff(np.append(first, at.size)))
    owner = np.searchsorted(begins, starts, "right") - 1
    with np.errstate(over="ignore"):
        words = _stir(np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * _POWER[place & 255], first))
        found, whose = [], []
        if words.size >= SHINGLE:
            n = words.size - SHINGLE + 1
            out = np.zeros(n, dtype=np.uint64)
            for k in range(SHINGLE):
                out = out * np.uint64(0x100000001B3) + words[k : n + k]
            same = owner[:n] == owner[SHINGLE - 1 :]
            found, whose = [_stir(out[same] + np.uint64(SHINGLE))], [owner[:n][same]]
        have = np.bincount(owner, minlength=n_texts)
        edges = np.concatenate(([0], np.cumsum(have)))
        for t in np.flatnonzero((have > 0) & (have < SHINGLE)):
            x = np.zeros(1, dtype=np.uint64)
            for w in words[edges[t] : edges[t + 1]]:
                x = x * np.uint64(0x100000001B3) + w
            found.append(_stir(x + np.uint64(have[t])))
            whose.append(np.array([t]))
        keyed = (np.concatenate(whose).astype(np.uint64) << np.uint64(HASH_BITS)) | (np.concatenate(found) >> np.uint64(64 - HASH_BITS))
    keyed.sort()
    new = np.flatnonzero(np.concatenate(([True], keyed[1:] != keyed[:-1])))
    counts = np.diff(np.append(new, keyed.size))
    keyed = keyed[new]
    offsets = np.searchsorted(keyed >> np.uint64(HASH_BITS), np.arange(n_texts + 1, dtype=np.uint64))
    return keyed & np.uint64((1 << HASH_BITS) - 1), counts, offsets


def chunks(column: pa.Array, most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts of a column, some ``most`` characters at a time."""
    held, size, start = [], 0, 0
    for k, value in enumerate(column):
        t = value.as_py()
        held.append(t)
        size += len(t or "") + 1
        if size >= most or len(held) == 1 << 14:
            yield start, held
            held, size, start = [], 0, k + 1
    if held:
        yield start, held


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of one text."""
    return shingle_batch([text])[:2]


class Sampler:
    """ICWS draws for one table of inverse document frequencies."""

    def __init__(self, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS):
        self.idf, self.bands, self.rows = idf.astype(np.float32), bands, rows
        rng = np.random.default_rng(2010)
        # r and c are Gamma(2, 1), beta uniform; a hash of (shingle, draw) picks each.
        r = rng.gamma(2.0, size=TABLE)
        self.r, self.inverse = r.astype(np.float32), (1.0 / r).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, size=TABLE)).astype(np.float32)
        self.beta = rng.random(TABLE).astype(np.float32)
        self.keys = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)

    def idf_of(self, hashes: np.ndarray) -> np.ndarray:
        return self.idf[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]

    def weights(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * self.idf_of(hashes)

    def band_keys(self, hashes: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A signed 64-bit key of each band, for each text of a batch that has shingles."""
        sizes = np.diff(offsets)
        starts, sizes = offsets[:-1][sizes > 0], sizes[sizes > 0]
        keys = np.zeros((starts.size, self.bands), dtype=np.uint64)
        if not starts.size:
            return keys.view(np.int64)
        log_w = np.log(self.weights(hashes, counts)).astype(np.float32)
        with np.errstate(over="ignore"):
            for j, key in enumerate(self.keys):
                h = (hashes + np.uint64(1)) * key
                h ^= h >> np.uint64(32)
                h *= _MIX
                one = (h >> np.uint64(48)).astype(np.int64)
                two = ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)
                three = ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)
                beta, r = self.beta[three], self.r[one]
                level = np.floor(log_w * self.inverse[one] + beta)
                # ln a = ln c - ln y - r, with ln y = r * (level - beta); the smallest is drawn.
                log_a = self.log_c[two] - r * (level - beta) - r
                least = np.minimum.reduceat(log_a, starts)
                ties = np.flatnonzero(log_a == np.repeat(least, sizes))
                best = ties[np.searchsorted(ties, starts)]
                drawn = _stir(hashes[best] * _MIX2 + level[best].astype(np.int64).astype(np.uint64))
                band = j // self.rows
                keys[:, band] = _stir(keys[:, band] * np.uint64(0x100000001B3) + drawn + np.uint64(band + 1))
        return keys.view(np.int64)

    def similarity(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
        """Weighted Jaccard: the sum of smaller weights over the sum of larger ones."""
        wa, wb = self.weights(*a).astype(np.float64), self.weights(*b).astype(np.float64)
        _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        low = np.minimum(wa[ia], wb[ib]).sum()
        union = wa.sum() + wb.sum() - low
        return float(low / union) if union > 0 else 0.0


def inverse_frequencies(counters: np.ndarray, texts: int) -> np.ndarray:
    """Smoothed idf of each counter, in float32; never zero."""
    return (np.log((1.0 + texts) / (1.0 + np.minimum(counters, texts))) + 1.0).astype(np.float32)


def _count_shingles(texts: DataFrame) -> np.ndarray:
    """How many of the texts each counter has seen a shingle of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                hashes, _, offsets = shingle_batch(texts)
                owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(offsets))
                once = np.unique((owner << np.uint64(32)) | (hashes & np.uint64(COUNTERS - 1)))
                seen += np.bincount((once & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        pa.default_memory_pool().release_unused()
        at = np.flatnonzero(seen)
        for k in range(0, at.size, 10_000):
            part = at[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(seen[part], pa.int64())], names=["at", "n"])

    rows = texts.filter("text is not null").select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def _band_keys(texts: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    """All columns but text, and the band keys; null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(idf.value, bands, rows)
        for batch in batches:
            keys: list[list[int] | None] = [None] * batch.num_rows
            for start, texts in chunks(batch.column(batch.num_columns - 1)):
                hashes, counts, offsets = shingle_batch(texts)
                found = sampler.band_keys(hashes, counts, offsets).tolist()
                for t, row in zip(np.flatnonzero(np.diff(offsets)), found, strict=True):
                    keys[start + t] = row
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "keys"])
        # A worker that is kept for later stages gives back what its batches took.
        pa.default_memory_pool().release_unused()

    kept = [c for c in texts.columns if c != "text"]
    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept)
    return texts.select(*kept, "text").mapInArrow(run, f"{schema}, keys array<long>")


def _ordered(column: str, other: str) -> list:
    return [F.least(column, other).alias("a"), F.greatest(column, other).alias("b")]


def _few(df: DataFrame) -> DataFrame:
    """A broadcast, if the table is small; else what it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sized(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (bucket, rep) with the first rep of their bucket: those of small buckets, and of crowded ones.

    Buckets of one are left out. Crowded buckets are few, so their rows aren't dealt by the bucket.
    """
    sizes = settle(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("head")).filter("m > 1"), "near-sizes")
    crowded = _few(sizes.filter(F.col("m") > FULL))
    small = rows.join(crowded.select("bucket"), "bucket", "left_anti").join(sizes.filter(F.col("m") <= FULL), "bucket")
    return settle(small, "near-small"), settle(rows.join(crowded, "bucket"), "near-crowded")


def _prefixes(texts: DataFrame, idf, similarity: float) -> DataFrame:
    """(shingle, rep, left, total): the rarest shingles of each text, by idf, then hash.

    ``left`` is what the shingle and those after it weigh, and ends the list where it
    is less than ``similarity`` times the total.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(idf.value)
        for batch in batches:
            for r in range(batch.num_rows):
                hashes, counts = shingles(batch.column(1)[r].as_py())
                w = sampler.weights(hashes, counts).astype(np.float64)
                order = np.lexsort((hashes, -sampler.idf_of(hashes)))
                left = np.cumsum(w[order][::-1])[::-1]
                total = left[0] if left.size else 0.0
                n = int((left >= similarity * total * (1 - 1e-9)).sum())
                columns = [hashes[order[:n]].astype(np.int64), np.full(n, batch.column(0)[r].as_py(), dtype=np.int64), left[:n], np.full(n, total, dtype=np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "rep", "left", "total"])

    return texts.select("rep", "text").mapInArrow(run, "shingle long, rep long, left double, total double")


def _prefix_pairs(prefixes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the texts of two classes, one of them open, that may be similar by a shared shingle.

    ``prefixes`` are those of ``_prefixes``, with class and open. Texts as similar share
    at least ``similarity / (1 + similarity)`` of their added weight.
    """
    sizes = prefixes.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), F.bool_or("open").alias("some"))
    sizes = sizes.filter("n > 1 and low < high and some").select("shingle", F.ceil(F.col("n") / SLICE).alias("slices"))
    held = settle(prefixes.join(settle(sizes, "near-shingles"), "shingle"), "near-shared")
    side = lambda df, x: df.select("shingle", "slice", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "class", "open", "left", "total")])
    one = side(held.withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices"))), "a")
    every = side(held.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))), "b")
    need = (F.col("total_a") + F.col("total_b")) * (similarity / (1 + similarity) * (1 - 1e-9))
    apart = (F.col("rep_a") < F.col("rep_b")) & (F.col("class_a") != F.col("class_b")) & (F.col("open_a") | F.col("open_b"))
    alike = (F.least("left_a", "left_b") >= need) & (F.least("total_a", "total_b") >= F.greatest("total_a", "total_b") * similarity * (1 - 1e-9))
    return one.join(every, ["shingle", "slice"]).filter(apart & alike).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def _crowded_links(crowded: DataFrame, links: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """Links (a, b) within crowded buckets that those with the bucket's first text don't make up for."""
    meets = links.select(F.col("a").alias("head"), F.col("b").alias("rep"), F.lit(True).alias("met"))
    rows = settle(crowded.join(meets, ["head", "rep"], "left").select("bucket", "rep", (F.col("met").isNull() & (F.col("rep") != F.col("head"))).alias("open")), "near-open")
    busy = settle(rows.filter("open").select("bucket").distinct(), "near-busy")
    if not busy.limit(1).count():
        return crowded.sparkSession.createDataFrame([], "a long, b long")
    asked = rows.join(_few(busy), "bucket").groupBy("rep").agg(F.bool_or("open").alias("open"))
    asked = settle(asked.join(components(links), "rep", "left").withColumn("class", F.coalesce("class", "rep")), "near-asked")
    found = settle(_prefixes(texts.join(asked.select("rep").hint("merge"), "rep"), idf, similarity), "near-prefixes")
    pairs = settle(_prefix_pairs(found.join(asked, "rep"), similarity), "near-pairs")
    return settle(_verified(pairs, texts, idf, similarity), "near-links")


def _verified(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs whose texts are similar enough."""
    first = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(idf.value)
        known: dict[int, tuple] = {}
        held = 0

        def of(rep: int, text) -> tuple:
            nonlocal held
            if rep not in known:
                if held > 1 << 18:
                    known.clear()
                    held = 0
                known[rep] = shingles(text.as_py())
                held += known[rep][0].size
            return known[rep]

        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k in range(batch.num_rows):
                keep.append(sampler.similarity(of(a[k], batch.column(2)[k]), of(b[k], batch.column(3)[k])) >= similarity - 1e-12)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        pa.default_memory_pool().release_unused()

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(rep, class): the smallest member of each linked rep's connected component.

    Large-star and small-star steps over written tables, until nothing changes;
    the number of rounds grows with the logarithm of the longest chain. No
    component is ever gathered in a task: minima are taken with partial sums.
    """
    edges = settle(links.select("a", "b").filter("a <> b").distinct(), "components")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of a goes to the smallest around a.
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        large = settle(large, "components")
        # Small star: a and its smaller neighbours go to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        joined = down.join(least, "a")
        small = joined.select("b", "low").unionByName(least.select(F.col("a").alias("b"), "low")).filter("b <> low").distinct()
        after = settle(small.select(F.col("low").alias("a"), "b"), "components")
        was = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        sums = [x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first() for x in (was, after)]
        edges = after
        if sums[0] == sums[1]:
            break
    return edges.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("class"))


def _numbered(reps: DataFrame) -> DataFrame:
    """Add ``rep``: a number of each text, unique and in the order of (key, h1, h2)."""
    ordered = settle(reps, "near-reps").repartitionByRange("key", "h1", "h2").sortWithinPartitions("key", "h1", "h2")
    return settle(ordered.withColumn("rep", F.monotonically_increasing_id()), "near-numbers")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, rep, class_id, links, kept.

    ``rep`` is the smallest doc_id with the same text, ``class_id`` the smallest in
    the class of linked texts, ``links`` the verified links of the text to other
    texts, ``kept`` true on the row that stays for its class. Equal texts, empty ones
    too, are one class; a null text is a class of its own; a text without words
    links to no other text. Rows that repeat an id and its text share their
    result. doc_id must be an integer; a null one counts as smallest, and texts
    are told apart by their hashes, not by ids, which may repeat or be null. An
    empty table gives no rows; other columns are ignored.
    """
    return _judged(docs, similarity, bands, rows).drop("h1", "h2")


def _judged(docs: DataFrame, similarity: float, bands: int, rows: int) -> DataFrame:
    """What ``near_duplicates`` gives, with the h1 and h2 of each row's text."""
    require(docs, "doc_id", "text")
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise ValueError("doc_id must be an integer column")
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    h1, h2 = two_hashes(F.col("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    named = docs.select("doc_id", key.alias("key"), h1.alias("h1"), h2.alias("h2"), "text")
    counters = _count_shingles(docs)
    idf = spark.sparkContext.broadcast(inverse_frequencies(counters, docs.select("doc_id").count()))
    ids = settle(_band_keys(named, idf, bands, rows), "near-keys")
    reps = _numbered(ids.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.any_value("keys").alias("keys")))

    members = reps.filter("keys is not null").select("rep", F.posexplode("keys").alias("band", "value"))
    small, crowded = _sized(members.select(F.xxhash64("band", "value").alias("bucket"), "rep"))
    texts = _texts_of(named, small.select("rep").unionByName(crowded.select("rep")), reps)
    pairs = small.select("bucket", F.col("rep").alias("a")).join(small.select("bucket", F.col("rep").alias("b")), "bucket").filter("a < b").select("a", "b")
    pairs = pairs.unionByName(crowded.filter("rep <> head").select(*_ordered("rep", "head"))).distinct()
    first = settle(_verified(pairs, texts, idf, similarity), "near-links")
    links = first.unionByName(_crowded_links(crowded, first, texts, idf, similarity)).distinct()
    classes = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    # Numbers are in the order of keys, so a class's smallest number is that of its smallest key.
    classes = classes.join(reps.select(F.col("rep").alias("class"), F.col("key").alias("class_key")), "class")
    by_rep = reps.select("h1", "h2", "rep", F.col("key").alias("rep_key")).join(classes, "rep", "left").join(degree, "rep", "left")
    stays = (F.coalesce("class", "rep") == F.col("rep")).alias("stays")
    by_rep = by_rep.select("h1", "h2", "rep_key", F.coalesce("class_key", "rep_key").alias("class_key"), F.coalesce("links", F.lit(0)).alias("links"), stays)
    out = ids.select("doc_id", "key", "h1", "h2").join(by_rep, ["h1", "h2"])
    kept = (F.col("stays") & (F.col("key") == F.col("rep_key"))).alias("kept")
    return out.select("doc_id", F.nullif("rep_key", F.lit(NO_ID)).alias("rep"), F.nullif("class_key", F.lit(NO_ID)).alias("class_id"), "links", kept, "h1", "h2")


def _texts_of(named: DataFrame, members: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, text) of the texts that are in any bucket with others."""
    own = reps.select("rep", "key", "h1", "h2")
    wanted = settle(members.select("rep").distinct().join(own, "rep"), "near-own")
    # Of equal texts the one with the smallest id stands for them.
    found = pick(named.filter("text is not null").select("key", "h1", "h2", "text"), wanted, "near-wanted", ("key", "h1", "h2"))
    found = found.join(wanted.hint("merge"), ["key", "h1", "h2"])
    return settle(found.select("rep", "text"), "near-texts")


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates; all columns, nothing else changed.

    The row with the smallest doc_id stays; of rows that repeat it and its text, any
    one. Rows are told by id and text, so an id that stands for several texts stays
    with those that stay; rows with neither an id nor a text all stay.
    """
    own, one, two = free_names(docs, "near_id", "near_h1", "near_h2")
    found = settle(_judged(docs, similarity, BANDS, ROWS), "near-classes")
    found = found.select(F.col("doc_id").alias(own), F.col("h1").alias(one), F.col("h2").alias(two), "kept")
    gone = settle(found.filter("not kept").select(own, one, two).distinct(), "near-gone")
    again = settle(found.filter("kept").groupBy(own, one, two).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(own, one, two), "near-again")
    h1, h2 = two_hashes(F.col("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    named = F.col("doc_id").isNotNull() | F.col("text").isNotNull()
    same = named & (h1 == F.col(one)) & (h2 == F.col(two)) & F.col("doc_id").eqNullSafe(F.col(own))
    kept = docs.join(_few(gone), same, "left_anti")
    if not again.limit(1).count():
        return kept
    repeated = kept.join(_few(again), same).dropDuplicates([own, one, two]).select(*docs.columns)
    return kept.join(_few(again), same, "left_anti").unionByName(repeated)
