"""Mix sources to target weights with Sainte-Lague apportionment.

Every source's documents are dealt into shards of bounded row count. All
(source, shard) cells compete for equal-token blocks: the cell with the highest
quotient ``weight / (2 * seats + 1)`` gets the next one, which gives integer
quotas. Within a cell the documents, in seeded order, form one tape of tokens,
and the quota selects a seeded run of blocks on it (whole passes first, if the
cell is to be repeated).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, require, settle

#: A word is a maximal run of bytes outside blank and the five ASCII controls.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Rows of a shard, and how many shards there may be at most beyond one a source.
SHARD_ROWS, MAX_SHARDS = 1024, 16_384


def source_targets(sizes: Sequence[int], weights: Sequence[float], repeats: float = MAX_REPEATS) -> list[float]:
    """Share the total of ``sizes`` by ``weights``; none above ``repeats`` times its size.

    What a stopped source leaves is shared again by weight among the others,
    until none is above its stop.
    """
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        pool = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        scale = pool / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * scale > repeats * sizes[i]}
        for i in full or open_:
            out[i] = float(repeats * sizes[i]) if full else weights[i] * scale
        open_ = open_ - full if full else set()
    return out


def sainte_lague(weights: Sequence[float], seats: int) -> np.ndarray:
    """Seats by highest quotients ``w / (2s + 1)``, ties to the earlier entry.

    It starts from the rounded shares, which the divisor form of the same rule
    gives up to a few seats, and then hands out or takes back single seats in
    quotient order, so its cost does not depend on the number of seats.
    """
    w = np.asarray(weights, dtype=np.float64)
    if not len(w) or w.sum() <= 0 or seats <= 0:
        return np.zeros(len(w), dtype=np.int64)
    got = np.floor(w / w.sum() * seats + 0.5).astype(np.int64)
    got[w <= 0] = 0
    missing = seats - int(got.sum())
    if missing > 0:
        heap = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if w[i] > 0]
        heapq.heapify(heap)
        for _ in range(missing):
            _, i = heap[0]
            got[i] += 1
            heapq.heapreplace(heap, (-w[i] / (2 * got[i] + 1), i))
    elif missing < 0:
        heap = [(w[i] / (2 * got[i] - 1), -i) for i in range(len(w)) if got[i] > 0]
        heapq.heapify(heap)
        for _ in range(-missing):
            _, i = heap[0]
            got[-i] -= 1
            if got[-i]:
                heapq.heapreplace(heap, (w[-i] / (2 * got[-i] - 1), i))
            else:
                heapq.heappop(heap)
    return got


def word_count(text):
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = 17, max_block: int = 1024) -> DataFrame:
    """How many words the mix takes from each document.

    Returns doc_id, source, size, source_size, target, taken, one row for each
    input row. Sources in code-point order, null last, take the ``weights`` in
    turn. Null, empty and blank texts have size 0 and give 0. Repeated rows are
    mixed as separate documents. An empty table gives no rows. Other columns
    are ignored. Only per-source totals and per-cell totals (at most
    ``MAX_SHARDS`` plus one a source) come to the driver.
    """
    require(docs, "doc_id", "text", "source")
    spark = docs.sparkSession
    sized = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    given = [weights[i % len(weights)] for i in range(len(totals))]
    targets = source_targets([r["words"] for r in totals], given, repeats)
    per_shard = max(SHARD_ROWS, -(-sum(r["rows"] for r in totals) // MAX_SHARDS))
    known = [(r["source"], int(r["words"]), float(t), max(1, -(-r["rows"] // per_shard))) for r, t in zip(totals, targets, strict=True)]
    by_source = spark.createDataFrame(known, "m_source string, source_size long, target double, shards long")
    dealt = sized.join(F.broadcast(by_source) if len(known) <= 100_000 else by_source, F.col("source").eqNullSafe(F.col("m_source")))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards"))).drop("m_source", "shards")

    at = {k[0]: k for k in known}
    cells = [(r["source"], r["shard"], int(r["words"])) for r in dealt.groupBy("source", "shard").agg(F.sum("size").alias("words")).collect()]
    cells.sort(key=lambda c: (c[0] is None, c[0] or "", c[1]))
    shares = [at[s][2] * words / at[s][1] if at[s][1] else 0.0 for s, _, words in cells]
    least = min((x for x in shares if x > 0), default=1.0)
    block = int(max(1, min(max_block, least // 100)))
    quotas = sainte_lague(shares, int(sum(shares) / block + 0.5))
    rng = np.random.default_rng(seed)
    plan = []
    for (source, shard, words), quota in zip(cells, quotas, strict=True):
        take = min(int(quota) * block, repeats * words)
        first = int(rng.integers(0, max(1, -(-words // block)))) * block
        plan.append((source, shard, words, take // words if words else 0, take % words if words else 0, first))
    quota_rows = spark.createDataFrame(plan, "q_source string, q_shard long, cell long, passes long, rest long, first long")
    # At most MAX_SHARDS cells and one more a source: bounded, unless there are very many sources.
    quota_rows = F.broadcast(quota_rows) if len(plan) <= 100_000 else quota_rows
    tape = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")
    laid = dealt.withColumn("hi", F.sum("size").over(tape.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("size"))
    laid = laid.join(quota_rows, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))

    def inside(start, end):
        return F.greatest(F.lit(0), F.least(F.col("hi"), end) - F.greatest(F.col("lo"), start))

    end = F.col("first") + F.col("rest")
    rest = inside(F.col("first"), F.least(end, F.col("cell"))) + inside(F.lit(0), end - F.col("cell"))
    return laid.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + rest).cast("long").alias("taken"))


def materialise(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, to the nearest whole text.

    ``doc_id`` is taken as a key here; a repeated or null id stays once a row
    that the mix holds for it at its largest count.
    """
    own, copies, each = free_names(docs, "mix_id", "mix_copies", "mix_copy")
    times = F.max(F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)).cast("int")
    counted = mixed.groupBy(F.col("doc_id").alias(own)).agg(times.alias(copies)).filter(F.col(copies) > 0)
    picked = docs.join(counted, F.col("doc_id").eqNullSafe(F.col(own)))
    return picked.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies))).alias(each)).drop(each)
