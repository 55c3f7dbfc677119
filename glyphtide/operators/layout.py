"""Layout answers of a detector model: JSON, broken JSON or HTML, to text blocks."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.geometry import is_full_frame, text_block
from ..functions.text import clean_model_text

#: Labels of text, and further labels that may hold text, without blanks and in lower case (fixed values).
TEXT_LABELS = ("bibliography", "caption", "code", "footnote", "pagefooter", "pageheader", "sectionheader", "text")
MORE_LABELS = ("chemicalblock", "complexblock", "equation", "form", "listgroup", "table", "tableofcontents")
#: Other names of labels (fixed values); those that only differ in hyphens need no entry.
OTHER_NAMES = {"Code-Block": "code", "Equation-Block": "equation", "Image": "picture"}
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
#: A label and the box that follows within 80 characters, in text that isn't JSON (a fixed pattern).
BROKEN = r'(?s)"label"\s*:\s*"([^"]+)".{0,80}?"?bbox"?\s*:\s*("[^"]+"|\[[^\]]+\])'


def label_key(label: Column) -> Column:
    """A label as it is compared: other names resolved, no blanks, hyphens or underscores, lower case."""
    bare = F.trim(label)
    known = F.lit(None).cast("string")
    for name, key in OTHER_NAMES.items():
        known = F.when(bare == name, key).otherwise(known)
    return F.coalesce(known, F.lower(F.regexp_replace(bare, r"[\s_-]+", "")))


def is_text_label(label: Column) -> Column:
    return label_key(label).isin(*TEXT_LABELS)


def is_candidate_label(label: Column) -> Column:
    return label_key(label).isin(*TEXT_LABELS, *MORE_LABELS)


def box_in_text(text: Column) -> Column:
    """The first four numbers of a text as a box, or null."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})")), lambda x: x.cast("double"))
    return F.when(F.size(numbers) >= 4, F.slice(numbers, 1, 4))


def box_in_json(value: Column) -> Column:
    """A box from JSON: a text with numbers, or an array of numbers or numeric texts."""
    items = F.from_json(value, "array<string>")
    numbers = F.transform(items, lambda x: F.trim(x).try_cast("double"))
    array = F.when((F.size(numbers) >= 4) & F.forall(numbers, lambda x: x.isNotNull()), F.slice(numbers, 1, 4))
    return F.when(F.startswith(F.trim(value), F.lit("[")), array).otherwise(box_in_text(value))


def json_boxes(content: Column) -> Column:
    """Array of boxes of a cleaned answer that starts like JSON; null for another, which is HTML.

    Items are objects, whose label may be missing but not of another kind, or bare
    arrays. Broken JSON gives what a pattern finds in it.
    """
    listed = F.when(F.startswith(content, F.lit("{")), F.concat(F.lit("["), content, F.lit("]"))).otherwise(content)
    items = F.from_json(listed, "array<string>")
    fine = F.try_parse_json(content).isNotNull()

    def of_item(item: Column) -> Column:
        m = F.from_json(item, "map<string,string>")
        given = F.coalesce(*[F.when(~m[k].isin("", "[]", "0", "false", "{}"), m[k]) for k in ("bbox", "data-bbox", "box")])
        named = box_in_json(given)
        return F.when(F.startswith(item, F.lit("[")), box_in_json(item)).when(F.startswith(item, F.lit("{")) & (m["label"].isNull() | is_candidate_label(m["label"])), named)

    whole = F.filter(F.transform(items, of_item), lambda b: b.isNotNull())
    labels, boxes = (F.regexp_extract_all(content, F.lit(BROKEN), F.lit(k)) for k in (1, 2))
    pairs = F.filter(F.arrays_zip(labels.alias("label"), boxes.alias("box")), lambda p: is_candidate_label(p["label"]))
    broken = F.filter(F.transform(pairs, lambda p: box_in_text(p["box"])), lambda b: b.isNotNull())
    empty = F.array().cast("array<array<double>>")
    return F.when(F.rlike(content, F.lit(r"^[\[{]")), F.coalesce(F.when(fine, whole).otherwise(broken), empty))


class _Blocks(HTMLParser):
    """Boxes of labelled divs that stand in no other labelled div."""

    def __init__(self):
        super().__init__()
        self.open: list[bool] = []
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            given = {k: (v or "").strip() for k, v in attrs}
            label, box = given.get("data-label", ""), given.get("data-bbox", "")
            if label and box and not any(self.open):
                self.found.append((label, box))
            self.open.append(bool(label))

    def handle_endtag(self, tag):
        if tag == "div" and self.open:
            self.open.pop()


@F.arrow_udf(ArrayType(StructType([StructField("label", StringType()), StructField("box", StringType())])))
def html_blocks(html: pa.Array) -> pa.Array:
    """Label and box text of each top-level labelled div; nesting needs a parser, so this is Python."""
    out = []
    for h in html:
        parser = _Blocks()
        parser.feed(h.as_py() or "")
        parser.close()
        out.append([{"label": a, "box": b} for a, b in parser.found])
    return pa.array(out, pa.list_(pa.struct([("label", pa.string()), ("box", pa.string())])))


def parse_layout(answers: DataFrame) -> DataFrame:
    """(id, pos, normalized_bbox, pixel_bbox) of rows (id, content, width, height).

    Whole-frame blocks go, and of blocks with the same normalized box the first
    stays. A width or height that isn't positive fails the query.
    """
    sized = F.when((F.col("width") > 0) & (F.col("height") > 0), True).otherwise(F.raise_error(F.lit("an image has a positive size")).cast("boolean"))
    rows = answers.filter(sized).withColumn("_clean", clean_model_text(F.col("content"))).withColumn("_boxes", json_boxes(F.col("_clean")))
    html = F.transform(F.filter(html_blocks(F.when(F.col("_boxes").isNull(), F.col("content"))), lambda x: is_text_label(x["label"])), lambda x: box_in_text(x["box"]))
    rows = rows.withColumn("_html", html).withColumn("_all", F.coalesce("_boxes", "_html"))
    blocks = rows.select("id", "width", "height", F.posexplode("_all").alias("pos", "box")).filter("box is not null")
    return dedup_blocks(blocks.select("id", "pos", text_block(F.col("box"), F.col("width"), F.col("height")).alias("b")).filter("b is not null").select("id", "pos", "b.*"))


def dedup_blocks(blocks: DataFrame) -> DataFrame:
    first = Window.partitionBy("id", "normalized_bbox").orderBy("pos")
    return blocks.filter(~is_full_frame(F.col("normalized_bbox"))).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def blank_regions(pixels: DataFrame, white: int = 245, fraction: float = 0.99, least_std: float = 8.0) -> DataFrame:
    """(id, blank) of pixel rows (id, c0, c1, c2): almost all white, or of one colour."""
    is_white = (F.col("c0") >= white) & (F.col("c1") >= white) & (F.col("c2") >= white)
    spread = F.greatest(*[F.stddev_pop(f"c{k}") for k in range(3)])
    return pixels.groupBy("id").agg(((F.avg(is_white.cast("double")) > fraction) | (spread < least_std)).alias("blank"))


def drop_blank(blocks: DataFrame, blank: DataFrame) -> DataFrame:
    return blocks.join(blank.filter("blank").select("id"), "id", "left_anti")


#: What a detector may answer: at most 200 items with a label, a box of four numbers and a count.
ANSWER_SCHEMA = "array<struct<label:string,bbox:string,count:int>>"


def valid_answer(content: Column) -> Column:
    items = F.from_json(content, ANSWER_SCHEMA)
    fine = lambda x: x["label"].isNotNull() & F.rlike(x["bbox"], F.lit(r"^\d+ \d+ \d+ \d+$")) & x["count"].between(0, 10_000)
    return F.coalesce((F.size(items) <= 200) & F.forall(items, fine), F.lit(False))
