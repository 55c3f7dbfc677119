"""Line deduplication by deletion neighbourhoods, for one edit.

Two lines are within one edit if they are equal after at most one character is
deleted from each. All such deletion variants are emitted as hashed keys and
joined; candidates are verified by edit distance, and the earliest line stays.

Before that, halves drop lines that can't have a partner: one edit leaves the
first or the second half of a line as it is, so a line whose halves (cut as its
own and as its partner's length cuts them) are shared with no other line needs
no variants. Variants are hashed by running sums over the characters, in time
linear in the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, pick, require, settle, two_hashes

#: Shorter lines are compared for equality alone: one edit is a quarter of them and more.
LEAST_CHARS = 5
#: Lines with this share of all occurrences and more are so few that they are sent to every executor.
HOT_SHARE = 1e-4
#: Rows of a table of keys that is sent to every executor, at most (some 20 MB).
BROADCAST_KEYS = 500_000
#: Characters that a task makes variants of, about.
TASK_CHARS = 250_000
_P = (1 << 31) - 1


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, h1, h2) of the lines that aren't blank."""
    split = docs.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    h1, h2 = two_hashes(F.col("line"), F.lit(""))
    return split.filter(F.rlike("line", F.lit(r"\S"))).select("doc_id", "line_no", "line", h1.alias("h1"), h2.alias("h2"))


def _halves(line: Column) -> Column:
    """Hashes of the halves of a line, as its own length cuts them and as that of a line one shorter does."""
    n = F.length(line)
    out = []
    for whole in (n, n - 1):
        first = F.floor(whole / 2).cast("int")
        rest = whole - first
        out += [F.xxhash64(F.lit("P"), first, F.substring(line, F.lit(1), first)), F.xxhash64(F.lit("S"), rest, F.substring(line, n - rest + 1, rest))]
    return F.when(n >= LEAST_CHARS, F.array_distinct(F.array(*out)))


def _variants(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variants, wholes): hashes of each line without its character ``at``, and of each whole line.

    A line's hash is the sum of its characters' hashes times a number for each
    place, modulo a prime, twice over; deleting a character moves later ones by
    one place, so two running sums give the hash of every variant. Lines, not
    their characters, are dealt to tasks, and a line's running sums are as long as
    the line.
    """
    chars = texts.agg(F.sum(F.length("line"))).first()[0] or 0
    dealt = texts.select("h1", "h2", "line").repartition(max(1, -(-chars // TASK_CHARS)), "h1", "h2")
    rows = dealt.select("h1", "h2", F.length("line").alias("n"), F.posexplode(F.split("line", "")).alias("at", "ch"))
    value = F.pmod(F.xxhash64("ch"), F.lit(_P))
    place = lambda turn, at: F.pmod(F.xxhash64(F.lit(turn), at), F.lit(_P))
    for turn in (1, 2):
        rows = rows.withColumn(f"here{turn}", F.pmod(value * place(turn, F.col("at")), F.lit(_P)))
        rows = rows.withColumn(f"moved{turn}", F.pmod(value * place(turn, F.col("at") - 1), F.lit(_P)))
    line = Window.partitionBy("h1", "h2")
    upto = line.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for turn in (1, 2):
        left = F.sum(f"here{turn}").over(upto) - F.col(f"here{turn}")
        # What follows is the total without what came so far; a frame to the end would be summed anew for each row.
        right = F.sum(f"moved{turn}").over(line) - F.sum(f"moved{turn}").over(upto)
        parts.append(F.pmod(left + right, F.lit(_P)))
    code = lambda a, b: F.call_function("shiftleft", a, F.lit(31)).bitwiseOR(b)
    variants = rows.select("h1", "h2", (F.col("n") - 1).alias("size"), "at", code(*parts).alias("hash"))
    sums = [F.pmod(F.sum(f"here{turn}"), F.lit(_P)) for turn in (1, 2)]
    wholes = rows.groupBy("h1", "h2", F.col("n").alias("size")).agg(code(*sums).alias("hash"))
    return variants, wholes


def _few(df: DataFrame) -> DataFrame:
    """A broadcast, if the table is small; else what it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def near_line_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, texts, links): occurrences, distinct lines, and verified links later -> earlier.

    Links are between different lines; each later line is linked to the earliest
    line of every group that shares a variant, and to each line that it equals
    after one deletion, which leaves out no earliest partner.
    """
    found = _lines(docs)
    lines = settle(found.select("doc_id", "line_no", "h1", "h2", _halves(F.col("line")).alias("halves")), "lines")
    where = F.struct("doc_id", "line_no")
    texts = settle(lines.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("halves").alias("halves")), "line-texts")
    keyed = texts.filter("halves is not null").select("h1", "h2", F.explode("halves").alias("half"))
    shared = settle(keyed.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half"), "line-halves")
    some = keyed.join(_few(shared), "half", "left_semi").select("h1", "h2").distinct()
    chosen = pick(found, some, "line-candidates").join(texts.select("h1", "h2", "first"), ["h1", "h2"])
    chosen = settle(chosen.select("h1", "h2", "first", "line"), "line-chosen")
    variants, wholes = _variants(chosen)
    variants, wholes = settle(variants, "line-variants"), settle(wholes, "line-wholes")
    firsts = chosen.select("h1", "h2", "first")
    me = F.struct("first", "h1", "h2")
    # One character replaced: the same variant by the same place. All in a group are within one edit.
    same = ["hash", "size", "at"]
    common = settle(variants.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "line-common")
    members = settle(variants.join(_few(common), same, "left_semi").join(firsts, ["h1", "h2"]).select(*same, me.alias("me")), "line-members")
    groups = members.groupBy(*same).agg(F.min("me").alias("earlier"))
    replaced = members.join(groups, same).select("earlier", F.col("me").alias("later"))
    # One character more or less: a whole line equals a variant of another.
    met = variants.select("h1", "h2", "size", "hash").join(_few(wholes.select("hash", "size", F.col("h1").alias("s1"), F.col("h2").alias("s2"))), ["hash", "size"])
    met = met.select("h1", "h2", "s1", "s2").distinct().join(firsts, ["h1", "h2"]).withColumn("y", me).select("y", F.col("s1").alias("h1"), F.col("s2").alias("h2"))
    met = met.join(firsts, ["h1", "h2"]).withColumn("x", me)
    moved = met.select(F.least("x", "y").alias("earlier"), F.greatest("x", "y").alias("later"))
    pairs = replaced.unionByName(moved).filter("earlier <> later").distinct()
    side = lambda name: chosen.select(F.col("h1").alias(f"{name}1"), F.col("h2").alias(f"{name}2"), F.col("line").alias(f"{name}_line"))
    flat = pairs.select(F.col("earlier.first").alias("keeper"), F.col("earlier.h1").alias("a1"), F.col("earlier.h2").alias("a2"), F.col("later.h1").alias("b1"), F.col("later.h2").alias("b2"))
    checked = flat.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).filter(F.levenshtein("a_line", "b_line", 1).isin(0, 1))
    links = checked.groupBy(F.col("b1").alias("h1"), F.col("b2").alias("h2")).agg(F.min("keeper").alias("keeper"), F.count(F.lit(1)).alias("links"))
    return lines, texts, settle(links, "line-links")


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, keeper_doc, keeper_line) of each line that goes.

    ``exact``: the same line is earlier, by doc_id and line number (nulls first).
    ``near``: it is the first of its text, and a different line within one edit,
    both of at least ``LEAST_CHARS`` characters, is earlier. Blank lines stay.
    Null and empty texts have no lines.
    """
    lines, texts, links = near_line_links(docs)
    key = ["h1", "h2"]
    firsts = settle(texts.select(*key, "first", "n").join(links, key, "left"), "line-firsts")
    # Occurrences of a very common line aren't dealt by the line: such lines are at most 1 / HOT_SHARE.
    common = F.col("n") >= F.lit(max(2, int((texts.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE)))
    hot, rows = F.broadcast(firsts.filter(common)), lines.select("doc_id", "line_no", *key)
    rows = rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(firsts.filter(~common), key))
    exact = ~F.struct("doc_id", "line_no").eqNullSafe(F.col("first"))
    gone = rows.withColumn("exact", exact).filter("exact or keeper is not null")
    keeper = F.when(F.col("exact"), F.col("first")).otherwise(F.col("keeper"))
    return gone.select("doc_id", "line_no", F.when(F.col("exact"), "exact").otherwise("near").alias("kind"), keeper["doc_id"].alias("keeper_doc"), keeper["line_no"].alias("keeper_line"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row a doc_id: doc_id, lines_exact, lines_near, dropped.

    ``dropped`` lists ``line_no=keeper_doc:keeper_line`` by line number, comma-joined;
    it is empty where nothing goes. Rows that repeat a doc_id share one row. An
    empty table gives no rows; other columns are ignored.
    """
    require(docs, "doc_id", "text")
    gone = duplicate_lines(docs).withColumn("entry", F.struct("line_no", F.concat(F.col("line_no").cast("string"), F.lit("="), F.coalesce(F.col("keeper_doc").cast("string"), F.lit("")), F.lit(":"), F.col("keeper_line").cast("string")).alias("shown")))
    every = gone.select("doc_id", "kind", "entry").unionByName(docs.select("doc_id", F.lit(None).cast("string").alias("kind"), F.lit(None).alias("entry").cast("struct<line_no:int,shown:string>")))
    out = every.groupBy("doc_id").agg(F.count_if(F.col("kind") == "exact").alias("lines_exact"), F.count_if(F.col("kind") == "near").alias("lines_near"), F.array_sort(F.collect_set("entry")).alias("entries"))
    return out.select("doc_id", "lines_exact", "lines_near", F.array_join(F.col("entries")["shown"], ",").alias("dropped"))


def dedup_text(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the duplicate lines taken out of ``text``; doc_id is a key here."""
    own, numbers = free_names(docs, "line_doc", "line_numbers")
    gone = duplicate_lines(docs).groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("line_no").alias(numbers))
    kept = F.filter(F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line"))), lambda x: ~F.array_contains(numbers, x["i"]))
    text = F.when(F.col(numbers).isNull(), F.col("text")).otherwise(F.array_join(kept["line"], "\n"))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own)), "left")
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
