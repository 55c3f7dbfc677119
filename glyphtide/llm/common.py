"""Helpers that the corpus operators share: scratch tables and identity hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the one named in ``spark.checkpoint.dir``. Only where that is unset,
    and the master is local, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(spark.sparkContext, "_glyphtide_scratch", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="glyphtide-")
            spark.sparkContext._glyphtide_scratch = root
    root = f"{root.rstrip('/')}/glyphtide-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_glyphtide_cleanup", None) != root:
        spark.sparkContext._glyphtide_cleanup = root
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    """Delete a folder of scratch tables, if the JVM still runs."""
    if spark.sparkContext._jsc is None:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor costs at most the tasks it was running; what was written
    stays readable from every other machine.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    settled_tables(df.sparkSession).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_tables(spark: SparkSession) -> list[str]:
    """The paths of the scratch tables that this application holds, in the order they were written."""
    context = spark.sparkContext
    if not hasattr(context, "_glyphtide_tables"):
        context._glyphtide_tables = []
    return context._glyphtide_tables


def release(spark: SparkSession, since: int) -> None:
    """Delete the scratch tables written from number ``since`` on, but the last, which no longer needs them."""
    held = settled_tables(spark)
    for path in held[since:-1]:
        _remove(spark, path)
    del held[since:-1]


def two_hashes(text: Column, row_key: Column) -> tuple[Column, Column]:
    """128 bits that identify a text; a null text counts as equal to no other."""
    alone = F.concat(F.lit("\x00null:"), row_key.cast("string"))
    known = F.coalesce(text, alone)
    tag = F.when(text.isNull(), 1).otherwise(0)
    return F.xxhash64(tag, known), F.xxhash64(F.lit(7), known, tag)


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names like ``stems`` that ``df`` doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def pick(rows: DataFrame, wanted: DataFrame, name: str, on: tuple[str, ...] = ("h1", "h2")) -> DataFrame:
    """One of the rows of each ``on`` that is in ``wanted``, exactly; both have h1 and h2.

    A filter of fixed size (a 64-bit word for each of 2**17 hash values, at most
    some 3 MB) drops most others before the exact join, so large texts that
    nobody asks for aren't shuffled; and of rows that repeat ``on`` each task sends one.
    """
    wanted = settle(wanted.select(*on).distinct(), name)
    word, bit = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 17)).cast("int"), F.pmod(F.col("h2"), F.lit(63)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = F.broadcast(wanted.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits")))
    likely = rows.withColumn("_word", word).join(bits, "_word").filter(F.col("_bits").bitwiseAND(mask) != 0)
    return likely.drop("_word", "_bits").dropDuplicates(list(on)).join(wanted.hint("merge"), list(on), "left_semi")
