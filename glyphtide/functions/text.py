"""Text columns: Unicode cleaning, comparison keys, time stamps and small parsers.

Unless said otherwise a function takes a string column and returns one, a null
stays null, and everything runs in the JVM. Normal form and case folding come
from the ICU library on Spark's class path; both are applied to whole texts in a
projection, never inside a lambda.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

#: All Unicode blanks, and the four separators that Java's Unicode class leaves out.
BLANK = r"(?U)[\s\x1c-\x1f]"
#: Line ends as Python's splitlines() has them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
NOT_ALNUM = r"[^\p{L}\p{N}]"
#: Suffixes of videos (fixed values).
VIDEO_SUFFIXES = ("mp4", "avi", "mov", "mkv", "webm", "mpg", "mpeg", "wmv")
#: A model's thinking, and the inside of a fenced block (fixed patterns).
THINKING, FENCE = r"(?s)<think>.*?</think>\s*", r"(?s)```(?:[a-zA-Z0-9_-]+)?\s*(.*?)```"


def _ascii(text: Column) -> Column:
    """Whether every character is one byte, so that no call outside generated code is needed."""
    return F.octet_length(text) == F.char_length(text)


def _icu(kind: str, name: str, text: Column) -> Column:
    return F.reflect(F.lit(f"com.ibm.icu.{kind}"), F.lit(name), F.coalesce(text, F.lit("")), F.lit(True))


def nfkc(text: Column) -> Column:
    return F.when(_ascii(text), text).when(text.isNotNull(), _icu("text.Normalizer", "compose", text))


def casefold(text: Column) -> Column:
    return F.when(_ascii(text), F.lower(text)).when(text.isNotNull(), _icu("lang.UCharacter", "foldCase", text))


def folded(text: Column) -> Column:
    """``casefold`` of ``nfkc``."""
    both = _icu("lang.UCharacter", "foldCase", _icu("text.Normalizer", "compose", text))
    return F.when(_ascii(text), F.lower(text)).when(text.isNotNull(), both)


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{BLANK}+", ""), f"{BLANK}+$", "")


def clean_text(text: Column) -> Column:
    """NFKC, runs of blanks to one space, no blanks at the ends; null gives an empty text."""
    return F.coalesce(strip(F.regexp_replace(nfkc(text), f"{BLANK}+", " ")), F.lit(""))


def merge_key(text: Column) -> Column:
    """What texts are compared by: NFKC, case-folded, letters and digits alone."""
    return F.regexp_replace(folded(text), NOT_ALNUM, "")


def clean_model_text(text: Column) -> Column:
    """A model's answer without its thinking, and of a fenced block the inside; null gives an empty text."""
    shown = F.regexp_replace(F.coalesce(text, F.lit("")), THINKING, "")
    return strip(F.when(F.rlike(shown, F.lit(FENCE)), F.regexp_extract(shown, FENCE, 1)).otherwise(shown))


def clean_plain_text(text: Column) -> Column:
    """``clean_model_text`` without a leading ``OCR:``, cleaned."""
    return clean_text(F.regexp_replace(clean_model_text(text), r"(?i)^OCR:\s*", ""))


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def valid_text(text: Column, status: Column) -> Column:
    """The text if its status is ok and its key isn't empty; else an empty text."""
    return F.when((status == "ok") & (F.length(merge_key(text)) > 0), text).otherwise("")


def is_safe_containment(short: Column, long: Column, free_length: int = 6) -> Column:
    """Whether the first key is part of the second: anywhere if long enough, else at an end."""
    return F.contains(long, short) & ((F.length(short) >= free_length) | F.startswith(long, short) | F.endswith(long, short))


def text_lines(text: Column) -> Column:
    """Array of lines, without the empty one behind a last line end."""
    parts = F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(parts)


def dedupe_lines(text: Column, least_key: int = 4) -> Column:
    """A text's lines without repeats, joined by ``\\n``.

    In order: blank lines go; a line without a key stays; one whose key is there
    already goes; of a line and one that safely contains it (the shorter key of at
    least ``least_key``) the longer stays, in the earlier place. The work is
    quadratic in the lines, so this is for cues; long texts take ``dedupe_lines_udf``.
    """
    lines = F.transform(text_lines(text), strip)
    keys = F.transform(text_lines(folded(text)), lambda x: F.regexp_replace(x, NOT_ALNUM, ""))
    rows = F.filter(F.arrays_zip(lines.alias("line"), keys.alias("key")), lambda x: x["line"] != "")
    start = F.array().cast("array<struct<line:string,key:string>>")

    def meets(old: Column, new: Column) -> Column:
        shorter = F.when(F.length(new["key"]) <= F.length(old["key"]), new["key"]).otherwise(old["key"])
        longer = F.when(F.length(new["key"]) <= F.length(old["key"]), old["key"]).otherwise(new["key"])
        contained = (F.length(shorter) >= least_key) & is_safe_containment(shorter, longer)
        return (old["key"] != "") & ((old["key"] == new["key"]) | contained)

    def step(acc: Column, new: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda old: meets(old, new)), True)
        entry = F.struct(new["line"].alias("line"), new["key"].alias("key"))
        added = F.concat(acc, F.array(entry))
        replaced = F.transform(acc, lambda old, i: F.when((i == at - 1) & (F.length(new["key"]) > F.length(old["key"])), entry).otherwise(old))
        return F.when((new["key"] == "") | (at == 0), added).otherwise(replaced)

    return F.array_join(F.transform(F.aggregate(rows, start, step), lambda x: x["line"]), "\n")


def key_of(text: str) -> str:
    """The Python twin of ``merge_key``."""
    import unicodedata

    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).casefold()))


def contained(a: str, b: str, least_key: int, free_length: int = 6) -> bool:
    """The Python twin of ``is_safe_containment``, for two different keys in any order."""
    short, long = sorted((a, b), key=len)
    return len(short) >= least_key and short in long and (len(short) >= free_length or long.startswith(short) or long.endswith(short))


def unrepeated(text: str, least_key: int = 4) -> str:
    """The Python twin of ``dedupe_lines``; equal keys are found by lookup."""
    kept: list[str] = []
    keyed: dict[int, str] = {}
    for line in filter(None, map(str.strip, text.splitlines())):
        key = key_of(line)
        if not key:
            kept.append(line)
            continue
        slot = next((i for i, k in keyed.items() if k == key or contained(k, key, least_key)), None)
        if slot is None:
            keyed[len(kept)] = key
            kept.append(line)
        elif len(key) > len(keyed[slot]):
            kept[slot], keyed[slot] = line, key
    return "\n".join(kept)


def dedupe_lines_udf(least_key: int = 4) -> Callable[[Column], Column]:
    """``dedupe_lines`` for texts of many lines, as an Arrow function."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if not t.is_valid else unrepeated(t.as_py(), least_key) for t in texts], pa.string())

    return run


@F.arrow_udf(DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio of (current, previous), as difflib has it; null if either is null.

    The argument order matters. Catalyst can't express it, so it is an Arrow
    function; callers put cheap tests before it.
    """
    return pa.array([SequenceMatcher(None, x.as_py(), y.as_py()).ratio() if x.is_valid and y.is_valid else None for x, y in zip(a, b, strict=True)], pa.float64())


def alike(a: str, b: str, least: float) -> bool:
    """Whether difflib's ratio of (a, b) is at least ``least``; its two cheap upper bounds come first."""
    match = SequenceMatcher(None, a, b)
    return match.real_quick_ratio() >= least and match.quick_ratio() >= least and match.ratio() >= least


def alike_udf(least: float) -> Callable[[Column, Column], Column]:
    """``alike`` of two columns, as an Arrow function; null if either is null."""

    @F.arrow_udf(BooleanType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([alike(x.as_py(), y.as_py(), least) if x.is_valid and y.is_valid else None for x, y in zip(a, b, strict=True)], pa.bool_())

    return run


def _clock(ms: Column, separator: str) -> Column:
    parts = (F.floor(ms / 3_600_000), F.pmod(F.floor(ms / 60_000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", *[p.cast("long") for p in parts])


def srt_timestamp(seconds: Column) -> Column:
    """``HH:MM:SS,mmm`` with half-even milliseconds; negative times are 0."""
    return _clock(F.rint(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long"), ",")


def display_timestamp(seconds: Column) -> Column:
    """As ``srt_timestamp``, but half-up, as a browser rounds."""
    return _clock(F.floor(F.greatest(seconds, F.lit(0.0)) * 1000 + 0.5).cast("long"), ",")


def parse_clock(text: Column) -> Column:
    """Seconds of ``MM:SS``; anything else is 0."""
    part = lambda k: F.regexp_extract(text, r"^\s*([0-9]+):([0-9]+(?:\.[0-9]+)?)\s*$", k).try_cast("double")
    return F.coalesce(part(1) * 60 + part(2), F.lit(0.0))


def base_url(url: Column) -> Column:
    """A service address, trimmed, ending in ``/v1``; null for an empty one."""
    bare = F.regexp_replace(strip(url), "/+$", "")
    return F.when(F.endswith(bare, F.lit("/v1")), bare).when(bare != "", F.concat(bare, F.lit("/v1")))


def metrics_url(url: Column) -> Column:
    """The metrics address beside a ``/v1`` address; query and fragment go."""
    bare = F.regexp_replace(F.regexp_replace(strip(url), "/+$", ""), r"[?#].*$", "")
    return F.concat(F.regexp_replace(F.regexp_replace(bare, "/v1$", ""), "/+$", ""), F.lit("/metrics"))


def media_url(path: Column) -> Column:
    """Percent-encoded relative path; slashes stay."""
    return F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A"))


def is_video_file(path: Column) -> Column:
    return F.rlike(F.lower(path), F.lit(rf"\.({'|'.join(VIDEO_SUFFIXES)})\z"))


def response_text(content: Column) -> Column:
    """Text of a model answer given as JSON: a string, or an array of strings and of objects with text or content.

    An object gives its ``text``, or its ``content`` where text is missing, null, empty,
    false or zero; what then isn't a string is skipped. Anything else is empty.
    """
    value = F.try_parse_json(content)
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    kind = F.schema_of_variant
    zero = lambda v: (kind(v) != "STRING") & (get(v, "$", "double") == 0)
    hollow = lambda v: F.coalesce(v.isNull() | F.to_json(v).isin("null", '""', "[]", "{}") | zero(v), F.lit(False))
    string = lambda v: F.when(kind(v) == "STRING", get(v, "$", "string"))

    def piece(p: Column) -> Column:
        text, other = get(p, "$.text", "variant"), get(p, "$.content", "variant")
        named = F.when(hollow(text), string(other)).otherwise(string(text))
        return F.coalesce(string(p), named, F.lit(""))

    parts = F.array_join(F.transform(get(value, "$", "array<variant>"), piece), "")
    return F.when(kind(value) == "STRING", get(value, "$", "string")).when(F.startswith(kind(value), F.lit("ARRAY")), parts).otherwise("")


def distinct_names(names: Column) -> Column:
    """Array of trimmed, non-empty names, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""))
