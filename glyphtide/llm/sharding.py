"""Balanced label propagation: linked documents move together under quotas.

The links are hubs (documents that share a hub are neighbours), so a group of
any size costs one edge a member and never a list of pairs. Each round joins
the pieces of every hub with the shard that most of its members are in. Moves
that are wanted both ways between shards cancel out, so the flow from each shard
to each other is as large as the quotas allow once all flows are made; the moves
with the best gain fill it. The last step evens the counts exactly, with unlinked
documents first. All of it is DataFrame work; only totals per shard, and per pair
of shards, come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import require, settle, two_hashes

ROUNDS = 6
#: Hash buckets of a shard that are numbered on their own; rows in one, about.
MAX_BUCKETS, BUCKET_ROWS = 4096, 1024
#: Hash buckets a gain class is admitted by.
ADMIT = 256
#: Hubs with this share of all rows and more are so few that they are sent to every executor.
HOT_SHARE = 1e-4

KEY = ["hub1", "hub2", "part", "start"]


def _loads(df: DataFrame, column: str, weight, n_shards: int) -> list[int]:
    got = {r[0]: int(r[1]) for r in df.groupBy(column).agg(F.sum(weight)).collect()}
    return [got.get(s, 0) for s in range(n_shards)]


def flows(asked: dict[tuple[int, int], int], loads: list[int], quota: int) -> dict[tuple[int, int], int]:
    """How many rows may go from one shard to another, of those that ask to.

    Starting from all that is asked, what comes into a shard is scaled down to
    its room and what leaves it, until every shard keeps to ``quota`` (or to its
    load, if that is larger). Less coming in elsewhere means less leaving
    there, so amounts only fall, and opposite flows survive.
    """
    flow = {k: float(n) for k, n in asked.items()}
    for _ in range(500):
        fine = True
        for t in range(len(loads)):
            coming = sum(n for (_, b), n in flow.items() if b == t)
            allowed = max(0, quota - loads[t]) + sum(n for (a, _), n in flow.items() if a == t)
            if coming > allowed + 0.5:
                fine = False
                for k in flow:
                    if k[1] == t:
                        flow[k] *= allowed / coming
        if fine:
            break
    return {k: int(n + 0.5) for k, n in flow.items()}


def _propagate(pieces: DataFrame, quota: int, n_shards: int, rounds: int) -> DataFrame:
    """Move pieces (rows with ``KEY``, n) towards their hub's largest shard."""
    now = settle(pieces.withColumn("shard", F.col("start")), "shard-labels")
    for turn in range(rounds):
        loads = _loads(now, "shard", "n", n_shards)
        held = now.groupBy("hub1", "hub2", "part", "shard").agg(F.sum("n").alias("held"))
        rank = F.struct("held", F.xxhash64(F.lit(turn), "hub1", "part", "shard"))
        wanted = held.groupBy("hub1", "hub2", "part").agg(F.max_by("shard", rank).alias("want"), F.max("held").alias("most"))
        asked = now.join(wanted, ["hub1", "hub2", "part"])
        asked = asked.withColumn("class", F.when(F.col("shard") != F.col("want"), F.floor(F.log2(F.col("most") + 1)).cast("int")))
        asked = asked.withColumn("cell", F.pmod(F.xxhash64(F.lit(turn), "hub1", "hub2", "part"), F.lit(ADMIT)).cast("int"))
        # At most n_shards squared rows for each of some 40 classes and ADMIT buckets, whatever the input.
        cells = settle(asked.filter("class is not null").groupBy("shard", "want", "class", "cell").agg(F.sum("n").alias("ask")), "shard-asks")
        totals = {(r[0], r[1]): int(r[2]) for r in cells.groupBy("shard", "want").agg(F.sum("ask")).collect()}
        if not totals:
            break
        allowed = flows(totals, loads, quota)
        limit = F.create_map(*[F.lit(x) for (a, b), n in allowed.items() for x in (a * n_shards + b, n)])[F.col("shard") * n_shards + F.col("want")]
        # A bucket that is larger than the whole flow is passed over and doesn't stop those behind it.
        order = Window.partitionBy("shard", "want").orderBy(F.desc("class"), "cell").rowsBetween(Window.unboundedPreceding, 0)
        admitted = cells.withColumn("limit", limit).filter("ask <= limit").withColumn("upto", F.sum("ask").over(order)).filter("upto <= limit")
        admitted = admitted.select("shard", "want", "class", "cell", F.lit(True).alias("go"))
        moved = asked.join(F.broadcast(admitted), ["shard", "want", "class", "cell"], "left")
        now = settle(moved.select(*KEY, "n", F.when(F.col("go"), F.col("want")).otherwise(F.col("shard")).alias("shard"), "go"), "shard-labels")
        if not now.filter("go").limit(1).count():
            break
        now = now.drop("go")
    return now.select(*KEY, "shard")


def balanced_shards(rows: DataFrame, n_shards: int = 8, rounds: int = ROUNDS, seed: int = 5) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows``, which has row_key, hub1 and hub2.

    Rows with equal (hub1, hub2) are linked. Shard counts differ by one at most,
    for any input, and slots count from 0 without gaps in each shard. Hubs with
    over a quarter of a shard are propagated in hashed parts, so none is tied to
    one shard's capacity. Repeated rows are separate rows; an empty table gives
    no rows.
    """
    require(rows, "row_key", "hub1", "hub2")
    kept = [c for c in rows.columns]
    hubs = rows.groupBy("hub1", "hub2").agg(F.count(F.lit(1)).alias("members"))
    total = rows.count()
    most = max(1, total // (4 * n_shards))
    linked = hubs.filter("members > 1").withColumn("parts", F.ceil(F.col("members") / most).cast("long"))
    spread = F.xxhash64(F.lit(seed), "row_key")
    # Rows of a large hub aren't dealt by the hub: such hubs are at most 1 / HOT_SHARE.
    linked = settle(linked, "shard-hubs")
    least = max(2, int(total * HOT_SHARE))
    hot, key = F.broadcast(linked.filter(F.col("members") >= least)), ["hub1", "hub2"]
    placed = rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(linked.filter(F.col("members") < least), key, "left"))
    placed = placed.withColumn("start", F.pmod(spread, F.lit(n_shards)).cast("int"))
    placed = settle(placed.withColumn("part", F.pmod(F.shiftright(spread, 8), F.coalesce("parts", F.lit(1)))).drop("parts"), "shard-rows")

    pieces = placed.filter("members is not null").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    labels = _propagate(pieces, total // n_shards, n_shards, rounds)
    lone = placed.filter("members is null").withColumn("shard", F.col("start"))
    tied = placed.filter("members is not null").join(labels, KEY)
    cur = lone.unionByName(tied)

    # Even out: number every shard's rows, unlinked ones first, hubs side by side.
    buckets = max(1, min(MAX_BUCKETS, total // (n_shards * BUCKET_ROWS)))
    kind = F.when(F.col("members").isNull(), 0).otherwise(1)
    order_key = F.when(F.col("members").isNull(), spread).otherwise(F.xxhash64("hub1", "hub2", "part", F.pmod(F.shiftright(spread, 24), F.ceil(F.col("members") / BUCKET_ROWS))))
    cur = cur.withColumn("kind", kind).withColumn("ord", order_key).withColumn("cell", F.pmod("ord", F.lit(buckets)).cast("int"))
    cur = settle(cur, "shard-current")
    counts = cur.groupBy("shard", "kind", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("kind", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "kind", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    loads = _loads(counts, "shard", "n", n_shards)
    by_load = sorted(range(n_shards), key=lambda s: (-loads[s], s))
    goal = {s: total // n_shards + (i < total % n_shards) for i, s in enumerate(by_load)}
    over, under, spans, out_at, in_at = {}, {}, [], 0, 0
    for s in range(n_shards):
        over[s], under[s] = max(0, loads[s] - goal[s]), max(0, goal[s] - loads[s])
    first_out = {}
    for s in range(n_shards):
        first_out[s] = out_at
        out_at += over[s]
        if under[s]:
            spans.append((in_at, in_at + under[s], s))
            in_at += under[s]
    # 2 * n_shards * buckets rows at most.
    numbered = cur.join(F.broadcast(offsets), ["shard", "kind", "cell"])
    inner = Window.partitionBy("shard", "kind", "cell").orderBy("ord", "row_key")
    numbered = numbered.withColumn("pos", F.col("offset") + F.row_number().over(inner) - 1)

    def by_shard(of: dict[int, int]):
        return F.create_map(*[F.lit(x) for s in range(n_shards) for x in (s, of[s])])[F.col("shard")].cast("long")

    surplus, moving = by_shard(over), by_shard(first_out) + F.col("pos")
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for start, end, s in spans:
        here = (moving >= start) & (moving < end)
        to, slot = F.when(here, s).otherwise(to), F.when(here, moving - start + loads[s]).otherwise(slot)
    leaves = F.col("pos") < surplus
    return numbered.select(*kept, F.when(leaves, to).otherwise(F.col("shard")).cast("int").alias("shard"), F.when(leaves, slot).otherwise(F.col("pos") - surplus).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """Place documents: doc_id, size, text_crc32, law, shard, slot, grown_shard, linked_rows.

    Equal texts are linked. The law is ``rows``: shard counts differ by one at
    most. Size is the text's UTF-8 bytes plus 1. A null text has size 1 and a
    null text_crc32 and is linked to nothing; empty texts equal each other.
    Null ids are placed like any other row.
    """
    require(docs, "doc_id", "text")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00none"))
    hub1, hub2 = two_hashes(F.col("text"), key)
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), key.alias("row_key"), hub1.alias("hub1"), hub2.alias("hub2"))
    out = balanced_shards(settle(narrow, "shard-docs"), n_shards, rounds)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
