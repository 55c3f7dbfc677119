"""URL filters: host and path rules, then a blocked Bloom filter of listed URLs.

The filter is built and probed with DataFrame functions. Each canonical URL
picks one block by hash and sets one bit in each of the block's eight words, so
a probe reads one row. What passes is joined with the exact list, which removes
the false positives; what doesn't pass never meets the list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, settle

WORDS = 8
#: Listed URLs of a block on average: eight words of 32 bits, so some 10.7 bits a URL.
URLS_A_BLOCK = 24
#: A filter of at most so many blocks (some 20 MB) is sent to every executor.
BROADCAST_BLOCKS = 200_000

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Query parameters that don't change what a URL shows.
TRACKING = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without last slash, query without tracking, sorted.

    Null, or no ``://``, gives null: such URLs are never listed.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)\z", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls.

    A rule fits its host and all its subdomains, where the path starts with the
    rule's. Longest is by the length of host and path together; of equal ones,
    the first given.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(enumerate(rules), key=lambda r: (len(r[1][1]) + len(r[1][2]), -r[0]))
    for _, (kind, h, p) in ordered:
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    """One bit number (0 to 31) for each word, from hashes that are independent of the block's."""
    first, second = F.xxhash64(F.lit(101), key), F.xxhash64(F.lit(202), key)
    return [F.pmod(F.shiftright(first if w < 4 else second, 13 * (w % 4)), F.lit(32)).cast("int") for w in range(WORDS)]


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """Rows (block, w0 to w7) of a blocked Bloom filter over the column ``canon``."""
    one = F.lit(1).cast("long")
    bits = _bits(F.col("canon"))
    marked = listed.select(F.pmod(F.xxhash64("canon"), F.lit(n_blocks)).alias("block"), *[F.call_function("shiftleft", one, b).alias(f"w{k}") for k, b in enumerate(bits)])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, listed.

    Verdict is the rule's where one fits; else ``block`` if the canonical URL is
    among ``listed`` (a table with a column url), else ``allow``. A null URL, or
    one without ``://``, has empty host and path, no rule, and is allowed.
    Repeated rows repeat their result; an empty table gives no rows, an empty
    list blocks nothing; other columns are ignored.
    """
    require(pages, "page_id", "url")
    require(listed, "url")
    url = F.col("url")
    exact = settle(listed.select(canonical(url).alias("canon")).filter("canon is not null").distinct(), "url-list")
    n_listed = exact.count()
    n_blocks = max(1, -(-n_listed // URLS_A_BLOCK))
    filter_rows = bloom_filter(exact, n_blocks)
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canon"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", rule).withColumn("ruled", ruled)
    # A URL that a rule decides still shows in ``listed``, so every URL is probed.
    keyed = judged.withColumn("block", F.pmod(F.xxhash64(F.coalesce("canon", F.concat(F.lit("\x00"), F.col("page_id").cast("string")))), F.lit(n_blocks)))
    probe = F.broadcast(filter_rows) if n_blocks <= BROADCAST_BLOCKS else filter_rows
    hit = F.lit(True)
    for k, b in enumerate(_bits(F.col("canon"))):
        hit = hit & (F.col(f"w{k}").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) != 0)
    probed = keyed.join(probe, "block", "left").withColumn("maybe", F.coalesce(F.col("canon").isNotNull() & hit, F.lit(False)))
    probed = settle(probed.drop("block", *[f"w{k}" for k in range(WORDS)]), "url-probed")
    sure = probed.filter("maybe").join(exact.withColumn("listed", F.lit(True)), "canon", "left")
    none = probed.filter("not maybe").withColumn("listed", F.lit(False))
    both = sure.unionByName(none).withColumn("listed", F.coalesce("listed", F.lit(False)))
    return both.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
