"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so a question that was only
given other values keeps its template. Windows of template tokens are hashed and
joined with those of the benchmark; windows that line up (at one shift between
document and item) form a passage; and the values in a passage's slots must map
one to one between document and item, which tells a re-parameterised question
from prose that has the same form by chance. Windows in a row with the
item's own values count whatever else the document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, require, settle, two_hashes

WINDOW = 8
#: Matching windows that make a passage, where the item has as many: twelve words in a row.
LEAST_WINDOWS = 5
#: Items with fewer tokens are left out.
LEAST_TOKENS = 5
#: A window with fewer literal tokens counts only where the values in its slots are the same.
LEAST_LITERALS = 4
#: Tables of at most so many rows are sent to every executor (some 60 and 10 MB).
BROADCAST_WINDOWS, BROADCAST_TEXTS = 1_000_000, 200_000

NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: Units that may follow a number (fixed values).
UNITS = (
    "%|°|€|£|\\$|km|cm|mm|m|kg|mg|g|lb|lbs|oz|ml|cl|l|mph|kmh|"
    "dollars?|euros?|pounds?|cents?|percent|prozent|pour cent|por ciento|"
    "seconds?|minutes?|hours?|days?|weeks?|months?|years?|sekunden?|minuten?|stunden?|tage?|wochen?|jahre?|"
    "secondes?|heures?|jours?|semaines?|mois|ans|segundos?|minutos?|horas?|días?|semanas?|meses|años?|"
    "miles?|feet|foot|inch|inches|meters?|metres?|kilometers?|kilometres?|grams?|kilograms?|liters?|litres?"
)
SEPARATOR = r"[^\p{L}\p{M}\p{N}_\x01-\x03]+"


def marked(text: Column) -> Column:
    """The text with a mark before each name, number and unit.

    A name is a capitalised word within a sentence; a unit follows a number.
    """
    names = F.regexp_replace(text, r" (?<=[\p{L}\p{N},;:] )(?=\p{Lu}\p{Ll})", " " + NAME)
    whole = F.regexp_replace(names, r"(?<=[0-9])[.,](?=[0-9])", "_")
    numbers = F.regexp_replace(whole, r"[0-9][0-9_]*+(?![\p{L}])(?<![\p{L}_][0-9_]{1,40})", NUMBER + "$0")
    units = F.regexp_replace(numbers, rf"(?i)(\x02[0-9_]++)[ -]?\x01?({UNITS})(?![\p{{L}}\p{{N}}])", "$1 " + UNIT + "$2")
    return F.regexp_replace(units, r"\x03([%°€£$])", UNIT + "sign")


def tokens(text: Column) -> Column:
    """Tokens of a marked text; a marked token starts with its mark."""
    return F.filter(F.split(text, SEPARATOR), lambda t: t != "")


def template(text: Column) -> Column:
    """Tokens of a marked text, values taken out, lower-cased; as many as ``tokens`` gives."""
    return tokens(F.lower(F.regexp_replace(text, r"([\x01-\x03])[\p{L}\p{M}\p{N}_]*", "$1")))


def _windows(tmpl: str, raw: str, width: int) -> Column:
    """(pos, hash) of each window of a column of template tokens.

    Whether a word is a name or a unit hangs on what is before it, which a window
    doesn't hold; so a window that starts with one has a second hash, with the word
    itself, which is that of the same window at the start of a sentence.
    """
    last = F.size(tmpl) - width
    rest = lambda i: [F.get(F.col(tmpl), i + k) for k in range(1, width)]
    entry = lambda i, first: F.struct(i.alias("pos"), F.xxhash64(F.lit(width), first, *rest(i)).alias("hash"))
    starts = F.sequence(F.lit(0), last)
    marked_starts = F.filter(starts, lambda i: F.get(F.col(tmpl), i).isin(NAME, UNIT))
    plain = F.transform(starts, lambda i: entry(i, F.get(F.col(tmpl), i)))
    spelt = F.transform(marked_starts, lambda i: entry(i, F.lower(F.substring(F.get(F.col(raw), i), 2, 1 << 30))))
    return F.when(last >= 0, F.concat(plain, spelt)).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))


def _literals(arr: Column) -> Column:
    return F.size(F.filter(arr, lambda t: ~F.rlike(t, F.lit("^[\x01-\x03]"))))


def benchmark_windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """(windows, slots, widths) of the items; a short item is one window of its own width."""
    items = benchmark.filter("text is not null").select("item_id", marked(F.col("text")).alias("m"))
    items = items.select("item_id", tokens(F.col("m")).alias("raw"), template(F.col("m")).alias("tmpl")).filter(F.size("tmpl") >= LEAST_TOKENS)
    items = settle(items.withColumn("width", F.least(F.lit(width), F.size("tmpl"))), "bench-items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    hashes = F.array().cast("array<struct<pos:int,hash:bigint>>")
    for w in widths:
        hashes = F.when(F.col("width") == w, _windows("tmpl", "raw", w)).otherwise(hashes)
    rows = items.select("item_id", "tmpl", "width", F.explode(hashes).alias("x"), (F.size("tmpl") - F.col("width") + 1).alias("item_windows"))
    rows = rows.select("item_id", "tmpl", "width", F.col("x.pos").alias("item_pos"), "x.hash", "item_windows")
    rows = rows.select("hash", "item_id", "item_pos", "width", "item_windows", (_literals(F.slice("tmpl", F.col("item_pos") + 1, F.col("width"))) < LEAST_LITERALS).alias("sparse"))
    slots = items.select("item_id", F.posexplode("raw").alias("at", "item_value")).filter(F.rlike("item_value", F.lit("^[\x01-\x03]")))
    return settle(rows.distinct(), "bench-windows"), settle(slots.withColumn("item_value", F.lower("item_value")), "bench-slots"), widths


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, least_windows: int = LEAST_WINDOWS) -> DataFrame:
    """Benchmark items that a text holds, by text: h1, h2, item_id, windows, item_windows, changed.

    (h1, h2) identify the text (``two_hashes`` of it and its id); equal texts share
    their rows. ``windows`` is those of the longest passage; ``changed`` is true where
    slot values differ from the item's in every passage. Null
    and empty texts on either side match nothing; items of under five tokens are
    left out; repeated rows on either side change nothing.
    """
    require(docs, "doc_id", "text")
    require(benchmark, "item_id", "text")
    windows, slots, widths = benchmark_windows(benchmark, width)
    h1, h2 = two_hashes(F.col("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    named = docs.filter("text is not null").select(h1.alias("h1"), h2.alias("h2"), "text")
    small = windows.count() <= BROADCAST_WINDOWS
    hashes = windows.select("hash").distinct()
    split = named.select("h1", "h2", marked(F.col("text")).alias("m")).select("h1", "h2", template(F.col("m")).alias("tmpl"), tokens(F.col("m")).alias("raw"))
    every = [_windows("tmpl", "raw", w) for w in widths or [width]]
    rows = split.select("h1", "h2", F.explode(F.concat(*every)).alias("x")).select("h1", "h2", "x.pos", "x.hash")
    hits = rows.join(F.broadcast(hashes) if small else hashes, "hash", "left_semi").distinct()
    found = settle(settle(hits, "leak-hits").join(windows, "hash"), "leak-windows")
    found = found.withColumn("shift", F.col("pos") - F.col("item_pos"))

    # Slot values, of the few texts that hit a window.
    texts = settle(found.select("h1", "h2").distinct(), "leak-texts")
    few = F.broadcast(texts) if texts.count() <= BROADCAST_TEXTS else texts
    raw = named.join(few, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("h1", "h2", tokens(marked(F.col("text"))).alias("raw"))
    values = raw.select("h1", "h2", F.posexplode("raw").alias("doc_at", "doc_value")).filter(F.rlike("doc_value", F.lit("^[\x01-\x03]")))
    values = values.withColumn("doc_value", F.lower("doc_value"))
    key = ["h1", "h2", "item_id"]
    place = [*key, "shift"]
    covered = found.select(*place, "pos", F.explode(F.sequence("item_pos", F.col("item_pos") + F.col("width") - 1)).alias("at"), "sparse")
    covered = covered.join(slots, ["item_id", "at"]).withColumn("doc_at", F.col("at") + F.col("shift"))
    pairs = settle(covered.join(values, ["h1", "h2", "doc_at"]), "leak-slots")
    # A window with few literals stands only if its slots hold the item's own values.
    unequal = pairs.filter("sparse and item_value <> doc_value").select(*place, "pos").distinct()
    solid = settle(found.join(unequal, [*place, "pos"], "left_anti"), "leak-solid")
    held = pairs.join(unequal, [*place, "pos"], "left_anti")
    exact = solid.join(held.filter("item_value <> doc_value").select(*place, "pos").distinct(), [*place, "pos"], "left_anti")

    def passages(rows: DataFrame, *run: str) -> DataFrame:
        counted = rows.groupBy(*place, *run, "item_windows").agg(F.countDistinct("item_pos").alias("windows"))
        return counted.filter(F.col("windows") >= F.least(F.lit(least_windows), F.col("item_windows")))

    mapping = held.select(*place, "item_value", "doc_value").distinct().groupBy(*place)
    mapping = mapping.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_value").alias("left"), F.countDistinct("doc_value").alias("right"), F.bool_or(F.col("item_value") != F.col("doc_value")).alias("changed"))
    consistent = F.col("n").isNull() | ((F.col("n") == F.col("left")) & (F.col("n") == F.col("right")))
    loose = passages(solid).join(mapping, place, "left").filter(consistent).select(*place, "windows", "item_windows", F.coalesce("changed", F.lit(False)).alias("changed"))
    loose = settle(loose, "leak-passages")
    # Where the values don't map one to one, windows in a row that hold the item's own values are still a passage.
    in_a_row = F.col("item_pos") - F.dense_rank().over(Window.partitionBy(*place).orderBy("item_pos"))
    same = passages(exact.withColumn("run", in_a_row), "run").select(*place, "windows", "item_windows", F.lit(False).alias("changed")).join(loose, place, "left_anti")
    found = loose.unionByName(same).groupBy(*key, "item_windows").agg(F.bool_and("changed").alias("changed"), F.max("windows").alias("windows"))
    return found.select(*key, "windows", "item_windows", "changed")


def leaks_by_document(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it leaks: doc_id, item_id, windows, item_windows, changed.

    Documents without a leak have no row. An empty table on either side gives no rows.
    """
    leaks = settle(find_leaks(docs, benchmark), "leaks")
    h1, h2 = two_hashes(F.col("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    ids = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"))
    return ids.join(_checked(leaks), ["h1", "h2"]).drop("h1", "h2")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item; all columns, nothing else changed."""
    one, two = free_names(docs, "leak_h1", "leak_h2")
    texts = settle(find_leaks(docs, benchmark).select(F.col("h1").alias(one), F.col("h2").alias(two)).distinct(), "leaks")
    h1, h2 = two_hashes(F.col("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    return docs.join(_checked(texts), (h1 == F.col(one)) & (h2 == F.col(two)), "left_anti")


def _checked(df: DataFrame) -> DataFrame:
    """A broadcast, if the table is small; else what it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_TEXTS else df
