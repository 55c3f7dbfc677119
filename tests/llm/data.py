"""Small tables with awkward rows."""

import random

#: Extra columns whose names the operators also use inside.
EXTRA = "size long, shard int, key string, rep long, h1 long, n long, score double, kept boolean, near_id long, mix_id long, leak_h1 long, line_doc long, _word int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "re", "tho", "ou", "ti", "le", "ber", "ci", "st", "en"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def texts() -> list:
    base = prose(1, 200)
    words = base.split()
    close = " ".join([*words[:100], "changed", *words[101:]])
    return [
        (1, base), (2, base), (3, close), (4, None), (5, None), (6, ""), (7, ""), (8, "   \n \t"), (9, "one two three"), (10, "one two three"),
        (11, prose(2, 30_000)), (12, prose(3, 50) + "\n" + prose(4, 60) + "\n" + prose(3, 50)), (13, prose(3, 50) + "\n" + prose(5, 20)), (1, base), (None, prose(6, 40)), (15, "x" * 100_000), (16, "1" * 50_000 + "@" * 10),
    ]


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    sources = ["a", "b", None, "a"]
    extra = (1, 2, "k", 3, 4, 5, 0.5, True, 6, 7, 8, 9, 10)
    return spark.createDataFrame([(i, t, "en", sources[k % 4], len(t or ""), *extra) for k, (i, t) in enumerate(rows)], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
