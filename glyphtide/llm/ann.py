"""Nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled into the unit ball and given one more component that puts
them on the sphere, so the largest inner product is the smallest distance. Each
table hashes by floor((a.x + b) / width) with Gaussian a. A query visits its own
bucket of a table and then perturbed ones (some of its cell numbers one lower or
one higher), in the order of their estimated success: the sum of its squared
distances to the cell walls that a perturbation crosses. How many buckets it
visits is fitted on a bounded sample of queries, searched exactly. Candidates of
all tables are ranked by their exact inner product.

Queries travel in blocks and meet the packed base vectors of the buckets that
any of them visits. Base blocks fall into a number of splits that depends on the
table's size alone; a task keeps the best of each query over all the blocks of
its split, so what it returns doesn't grow with the number of blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import require, settle

TOP, TABLES, RECALL = 20, 2, 0.97
#: Queries that the number of probes is fitted on, and vectors that scale the hashes.
SAMPLE_QUERIES, SAMPLE_VECTORS = 96, 4096
#: Vectors of a block of base rows, and queries of a block, about.
BASE_BLOCK, QUERY_BLOCK = 2048, 1024
#: Base vectors of a split, about, and how many splits there are before these grow.
SPLIT_VECTORS, SPLITS = 16_384, 64
#: Vectors of a bucket, about; hash functions of a table, and buckets that a query visits in it, at most.
BUCKET, MAX_FUNCTIONS, MAX_PROBES = 64, 12, 6561
#: Width of a hash cell, in standard deviations of a projection.
WIDTH = 3.0
#: Cell numbers are kept within these bounds and make up a bucket's key, four bits each.
LOW, HIGH, RADIX = -7, 6, 16


def perturbation_sets(m: int, most: int = MAX_PROBES) -> list[tuple[int, ...]]:
    """Sets of places among a query's 2m wall distances, in the order of their expected score.

    Place j is the j-th nearest wall of the m pairs; j and 2m-1-j belong to one
    hash function, so no set holds both. From a set come the one whose last place is
    moved on and the one that gets the next place as well, so a heap meets all sets
    in order. The empty set, the query's own bucket, is first.
    """
    expected = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) for j in range(m)]
    expected += [1 - (2 * m - j) / (m + 1) + (2 * m - j) * (2 * m - j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m, 2 * m)]
    out: list[tuple[int, ...]] = [()]
    heap = [(expected[0], (0,))] if m else []
    while heap and len(out) < most:
        score, places = heapq.heappop(heap)
        if not any(2 * m - 1 - j in places for j in places):
            out.append(places)
        last = places[-1]
        if last + 1 < 2 * m:
            more = score + expected[last + 1]
            heapq.heappush(heap, (more, (*places, last + 1)))
            heapq.heappush(heap, (more - expected[last], (*places[:-1], last + 1)))
    return out


class Index:
    """The hash functions; small, and the same on every machine."""

    def __init__(self, dim: int, m: int, norm: float, spread: float, tables: int = TABLES, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.norm, self.tables, self.m = norm or 1.0, tables, m
        self.a = rng.standard_normal((tables, dim + 1, MAX_FUNCTIONS))[:, :, :m]
        self.width = WIDTH * max(spread, 1e-9)
        self.b = rng.random((tables, MAX_FUNCTIONS))[:, :m] * self.width
        self.powers = np.float64(RADIX) ** np.arange(m)
        sets = perturbation_sets(m)
        self.sets = np.zeros((len(sets), 2 * m))
        for r, places in enumerate(sets):
            self.sets[r, list(places)] = 1.0

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Base vectors onto the sphere; queries scaled to length 1."""
        x = x.astype(np.float64)
        if query:
            return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        x = x / self.norm
        return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1, keepdims=True)))])

    def _cells(self, lifted: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers, and the distances from each cell's lower wall."""
        p = lifted @ self.a[table] + self.b[table]
        cells = np.floor(p / self.width)
        return np.clip(cells, LOW, HIGH), p - cells * self.width

    def keys(self, lifted: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each vector."""
        return ((self._cells(lifted, table)[0] - LOW + 1) @ self.powers).astype(np.int64)

    def probes(self, lifted: np.ndarray, table: int, most: int) -> np.ndarray:
        """The buckets that each query visits, in the order of their estimated success."""
        cells, above = self._cells(lifted, table)
        home = (cells - LOW + 1) @ self.powers
        walls = np.hstack([above, self.width - above])
        steps = np.concatenate([-self.powers, self.powers])
        order = np.argsort(walls, axis=1, kind="stable")
        # An own sum for each query, as one matrix product would hold all queries' sets at once.
        out = np.empty((len(lifted), min(most, len(self.sets))), dtype=np.int64)
        for q in range(len(lifted)):
            near = walls[q, order[q]]
            scores = self.sets @ (near * near)
            first = np.argsort(scores, kind="stable")[:most]
            out[q] = home[q] + (self.sets @ steps[order[q]])[first]
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows that take part: not null or zero, finite, of the table's dimension."""
    e = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select("vec_id", e.alias("embedding")).filter(F.col("embedding").isNotNull() & fine)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query; what several tables found counts once."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    return pairs.groupBy("query_id", "row", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _top(rough: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query that has any: its number, where its k best are, ties to smaller ids, and their inner products.

    ``rough`` (-inf: no candidate) is good to rounding, and nothing below ``floor`` is
    wanted. What rounding can't tell apart from the k-th is computed again, pair by
    pair, so equal vectors have equal products.
    """
    slack = 1e-9 * np.maximum(1.0, np.abs(rough).max(axis=1, where=rough > -np.inf, initial=0.0))
    for r in np.flatnonzero((rough > -np.inf).any(1) & (rough.max(1) >= floor - slack)):
        row = rough[r]
        least = max(floor[r], np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf)
        at = np.flatnonzero((row >= least - slack[r]) & (row > -np.inf))
        exact = (x[at] * q[r]).sum(1)
        best = np.lexsort((rows[at], ids[at], -exact))[:k]
        yield r, at[best], exact[best]


RESULT = "query_id long, row long, vec_id long, score double"


def _result(queries: list, rows: list, vecs: list, scores: list) -> pa.RecordBatch:
    cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
    return pa.RecordBatch.from_arrays([*(cat(x, pa.int64()) for x in (queries, rows, vecs)), cat(scores, pa.float64())], names=["query_id", "row", "vec_id", "score"])


def _exact(base: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Exact search for a bounded number of queries, by one pass over the base."""
    dim = queries.shape[1]
    shared = base.sparkSession.sparkContext.broadcast((query_ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        for batch in batches:
            rows, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), dim)
            s = q @ x.T
            s[qid[:, None] == ids[None, :]] = -np.inf
            found = list(_top(s, rows, ids, x, q, k, np.full(len(q), -np.inf)))
            yield _result([np.full(len(f), qid[r]) for r, f, _ in found], [rows[f] for _, f, _ in found], [ids[f] for _, f, _ in found], [e for *_, e in found])

    return _best(base.select("row", "vec_id", "embedding").mapInArrow(run, RESULT), k)


def search(vectors: DataFrame, k: int = TOP, every: int = 20, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """The k nearest found of each query: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are
    all rows but those with the query's own id. Score is the inner product, in
    double precision. Vectors that are null, zero, of another length than the
    most, or hold a null or non-finite component take no part. Where probing finds
    fewer than k, the query is searched exactly. Repeated vec_ids are candidates
    each; rows repeated in id and vector count once. An empty table gives no
    rows; other columns are ignored.
    """
    require(vectors, "vec_id", "embedding")
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).filter("dim > 0").orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return empty
    dim = int(lengths["dim"])
    base = settle(_usable(vectors, dim).dropDuplicates().withColumn("row", F.monotonically_increasing_id()), "ann-base")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    n, norm = base.agg(F.count(F.lit(1)), F.sqrt(F.max(square))).first()
    if not n:
        return empty
    asked = base.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    n_asked = asked.count()
    if not n_asked:
        return empty
    index, most = _fit(base, asked, dim, n, norm, k, tables, recall)
    blocks = _blocks(base, index, dim, tables, n)
    found = settle(_best(settle(_probed(asked, n_asked, blocks, index, dim, most, k), "ann-pairs"), k), "ann-found")
    out = found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    # Queries that probing left short of k, if any, are searched exactly, block by block.
    have = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = asked.select(F.col("vec_id").alias("query_id")).distinct().join(have, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < min(k, n - 1))
    short = settle(short.select("query_id"), "ann-short")
    n_short = short.count()
    if n_short:
        again = asked.join(short.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_semi")
        rest = _best(_probed(again, n_short, blocks, index, dim, None, k), k)
        out = out.join(short, "query_id", "left_anti").unionByName(rest.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    return out


def _fit(base: DataFrame, asked: DataFrame, dim: int, n: int, norm: float, k: int, tables: int, recall: float) -> tuple[Index, int]:
    """The hash functions, and the buckets of a table that a query visits.

    Both are fitted on at most SAMPLE_VECTORS vectors and SAMPLE_QUERIES queries: the
    number is the place in the probing sequence that the wanted share of true
    neighbours is met by. Where no place within MAX_PROBES is enough, tables get
    fewer functions, and so fewer and larger buckets.
    """
    by_hash = F.xxhash64(F.lit(6), "vec_id")
    order = (by_hash, "vec_id", "embedding")
    sample = base.orderBy(*order).limit(SAMPLE_VECTORS).select("embedding").toArrow()
    x = _matrix(sample["embedding"].combine_chunks(), dim)
    chosen = asked.orderBy(*order).limit(SAMPLE_QUERIES).select("vec_id", "embedding").toArrow()
    ids, q = chosen["vec_id"].to_numpy(), _matrix(chosen["embedding"].combine_chunks(), dim)
    truth = settle(_exact(base, ids, q, k).select("query_id", "row"), "ann-truth")
    near = base.join(F.broadcast(truth), "row").select("query_id", "embedding").toArrow()
    where = {int(i): r for r, i in enumerate(ids)}
    rows = np.array([where[i] for i in near["query_id"].to_pylist()], dtype=np.int64)
    found = _matrix(near["embedding"].combine_chunks(), dim) if len(rows) else np.zeros((0, dim))
    m = int(np.clip(np.ceil(np.log2(max(2, n) / BUCKET)), 2, MAX_FUNCTIONS))
    plain = Index(dim, m, norm, 1.0, tables)
    spread = float(np.std(plain.lift(x, False) @ plain.a[0]))
    while True:
        index = Index(dim, m, norm, spread, tables)
        lifted, queries = index.lift(found, False), index.lift(q, True)
        least = np.full(len(rows), np.inf)
        for t in range(tables):
            keys = index.keys(lifted, t)
            for r, visited in enumerate(index.probes(queries, t, MAX_PROBES)):
                mine = np.flatnonzero(rows == r)
                hit = visited[None, :] == keys[mine, None]
                least[mine] = np.minimum(least[mine], np.where(hit.any(1), hit.argmax(1) + 1, np.inf))
        most = np.quantile(least, recall, method="higher") if len(rows) else 1
        if np.isfinite(most) or m == 1:
            return index, int(min(most, MAX_PROBES))
        m -= 1


def _blocks(base: DataFrame, index: Index, dim: int, tables: int, n: int) -> DataFrame:
    """Base vectors packed by table and bucket: block, split, tab, buckets, keys, rows, ids, vectors.

    Vectors are ordered by bucket within a range of buckets and packed by
    BASE_BLOCK, so a bucket of any size is spread over as many blocks as it needs.
    Splits follow from the number of vectors, whatever the number of blocks.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lifted = index.lift(_matrix(batch.column(2), dim), False)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t), pa.int32()), pa.array(index.keys(lifted, t)), *batch.columns], names=["tab", "bucket", *batch.schema.names])

    rows = base.select("row", "vec_id", "embedding").mapInArrow(hashed, "tab int, bucket long, row long, vec_id long, embedding array<double>")
    n_parts = max(1, -(-n * tables // (4 * BASE_BLOCK)))
    rows = rows.repartitionByRange(n_parts, "tab", "bucket", "row").sortWithinPartitions("tab", "bucket", "row")
    names = ["tab", "buckets", "keys", "rows", "ids", "vectors"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(tab: int, held: list) -> pa.RecordBatch:
            keys, own, ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            packed = [pa.array([v.tobytes()], pa.binary()) for v in (keys, own, ids, x)]
            return pa.RecordBatch.from_arrays([pa.array([tab], pa.int32()), pa.array([np.unique(keys).tolist()], pa.list_(pa.int64())), *packed], names=names)

        held, size, tab = [], 0, None
        for batch in batches:
            tabs, keys, own, ids = (batch.column(c).to_numpy() for c in range(4))
            x, at = _matrix(batch.column(4), dim), 0
            while at < len(tabs):
                if held and (tabs[at] != tab or size == BASE_BLOCK):
                    yield flush(tab, held)
                    held, size = [], 0
                tab = int(tabs[at])
                end = min(at + BASE_BLOCK - size, int(np.searchsorted(tabs, tab, "right")))
                held.append((keys[at:end], own[at:end], ids[at:end], x[at:end]))
                size += end - at
                at = end
        if held:
            yield flush(tab, held)

    packed = rows.select("tab", "bucket", "row", "vec_id", "embedding").mapInArrow(pack, "tab int, buckets array<long>, keys binary, rows binary, ids binary, vectors binary")
    splits = max(1, min(SPLITS, -(-n * tables // SPLIT_VECTORS)), -(-n * tables // (SPLIT_VECTORS * SPLITS)))
    block = F.monotonically_increasing_id()
    return settle(packed.withColumn("block", block).withColumn("split", F.pmod(F.xxhash64("tab", F.substring("rows", 1, 8)), F.lit(splits)).cast("int")), "ann-blocks")


def _probed(asked: DataFrame, n_asked: int, blocks: DataFrame, index: Index, dim: int, most: int | None, k: int) -> DataFrame:
    """(query_id, row, vec_id, score): the k best of each query in each split, of the buckets it visits.

    It visits the first ``most`` of each table's sequence, or all buckets if that is None.
    """
    n_blocks = max(1, -(-n_asked // QUERY_BLOCK))
    dealt = asked.select(F.pmod(F.xxhash64(F.lit(8), "row"), F.lit(n_blocks)).cast("int").alias("asker"), "vec_id", "embedding")
    dealt = dealt.repartition(n_blocks, "asker").sortWithinPartitions("asker", "vec_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(asker: int, held: list) -> pa.RecordBatch:
            ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([asker], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["asker", "ids", "vectors"])

        held, now = [], None
        for batch in batches:
            askers, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), dim)
            for asker in np.unique(askers):
                if held and asker != now:
                    yield flush(now, held)
                    held = []
                now, mine = int(asker), askers == asker
                held.append((ids[mine], x[mine]))
        if held:
            yield flush(now, held)

    packed = settle(dealt.mapInArrow(pack, "asker int, ids binary, vectors binary"), "ann-queries")
    directory = blocks.select("block", "split", "tab", F.explode("buckets").alias("bucket"))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asker, vectors in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lifted = index.lift(np.frombuffer(vectors.as_buffer(), dtype=np.float64).reshape(-1, dim), True)
                for t in range(index.tables):
                    keys = np.unique(index.probes(lifted, t, most))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), asker), pa.int32()), pa.array(np.full(len(keys), t), pa.int32()), pa.array(keys)], names=["asker", "tab", "bucket"])

    if most is None:
        visits = packed.select("asker", F.explode(F.sequence(F.lit(0), F.lit(index.tables - 1))).alias("tab")).join(blocks.select("block", "split", "tab"), "tab").select("asker", "block", "split")
    else:
        wanted = packed.select("asker", "vectors").mapInArrow(probes, "asker int, tab int, bucket long")
        visits = directory.join(wanted, ["tab", "bucket"]).select("asker", "block", "split").distinct()
    visits = settle(visits, "ann-visits")

    # A block of queries goes once to each split that it visits, and is followed there by the split's blocks.
    none = F.lit(None)
    there = visits.select("asker", "split").distinct().join(packed, "asker")
    there = there.select("asker", "split", F.lit(-1).cast("long").alias("block"), none.cast("int").alias("tab"), none.cast("binary").alias("keys"), none.cast("binary").alias("rows"), "ids", "vectors")
    met = visits.join(blocks.select("block", "tab", "keys", "rows", "ids", "vectors"), "block").select("asker", "split", "block", "tab", "keys", "rows", "ids", "vectors")
    tasks = there.unionByName(met)
    parts = visits.select("asker", "split").distinct().count()
    tasks = tasks.repartition(max(1, parts), "asker", "split").sortWithinPartitions("asker", "split", "block")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = q = best = floor = None
        visited: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            held = [b for b in best if b is not None]
            return _result([np.full(len(b[0]), i) for i, b in zip(ids, best, strict=True) if b is not None], *([b[c] for b in held] for c in range(3)))

        for batch in batches:
            for r in range(batch.num_rows):
                raw = lambda c, kind: np.frombuffer(batch.column(c)[r].as_buffer(), dtype=kind)  # noqa: B023, E731
                if batch.column(2)[r].as_py() < 0:
                    if ids is not None:
                        yield flush()
                    ids, q = raw(6, np.int64).copy(), raw(7, np.float64).reshape(-1, dim).copy()
                    best, floor, visited = [None] * len(ids), np.full(len(ids), -np.inf), {}
                    continue
                t = batch.column(3)[r].as_py()
                keys, rows, own, x = raw(4, np.int64), raw(5, np.int64), raw(6, np.int64), raw(7, np.float64).reshape(-1, dim)
                s = q @ x.T
                s[ids[:, None] == own[None, :]] = -np.inf
                if most is not None:
                    if t not in visited:
                        visited[t] = np.sort(index.probes(index.lift(q, True), t, most), axis=1)
                    present, back = np.unique(keys, return_inverse=True)
                    at = np.array([np.searchsorted(v, present) for v in visited[t]])
                    hit = np.take_along_axis(visited[t], np.minimum(at, visited[t].shape[1] - 1), 1) == present
                    s[~hit[:, back]] = -np.inf
                for j, f, exact in _top(s, rows, own, x, q, k, floor):
                    best[j] = _merge(best[j], (rows[f], own[f], exact), k)
                    if len(best[j][2]) == k:
                        floor[j] = best[j][2][-1]
        if ids is not None:
            yield flush()

    return tasks.mapInArrow(rank, RESULT)


def _merge(held: tuple | None, new: tuple, k: int) -> tuple:
    """The k best of two lists of (rows, ids, scores), a row that is in both counted once."""
    if held is None:
        return new
    rows, ids, scores = (np.concatenate(c) for c in zip(held, new, strict=True))
    once = np.unique(rows, return_index=True)[1]
    first = once[np.lexsort((rows[once], ids[once], -scores[once]))][:k]
    return rows[first], ids[first], scores[first]
