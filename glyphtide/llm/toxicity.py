"""Toxicity: a logistic classifier with a counterfactual regulariser.

Features are the distinct words of a text and their prefixes. Which features the
model has is decided by document counts over the labelled rows; the weights come
from a bounded, documented sample of them. Beside the likelihood, training
penalises how much the score of a labelled sentence changes when the identity
terms in it are swapped for others of the same group, so that mentioning a group
doesn't by itself raise a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import require, settle

#: Labelled rows that weights are fitted on, at most, and features, at most.
SAMPLE_ROWS, MAX_FEATURES = 20_000, 6_000
#: A feature needs so many toxic or so many clean documents more than chance explains, in standard errors.
LEAST_Z, LEAST_DOCS = 4.0, 3
PREFIXES = (3, 4, 5, 6)
#: Features that a task counts before it passes them on; the sums are made behind it.
HELD_FEATURES = 50_000
THRESHOLD = 0.7
L2, COUNTERFACTUAL, STEPS = 1e-4, 5.0, 300

#: Terms that may stand for each other in a counterfactual, by group (fixed values).
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "citizen", "refugee", "native"),
    ("immigrants", "citizens", "refugees", "natives"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)

#: Indices of the features that a swapped sentence loses, and of those it gains.
Swap = tuple[tuple[int, ...], tuple[int, ...]]

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(words: set[str]) -> set[str]:
    out = {f"={w}" for w in words}
    for n in PREFIXES:
        out.update(w[:n] for w in words if len(w) >= n)
    return out


def counterfactuals(text: str, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> list[tuple[set[str], set[str]]]:
    """(words, words after the swap) of each sentence that names an identity term.

    Each term is swapped for the next of its group, so a sentence gives one pair.
    """
    after = {t: g[(k + 1) % len(g)] for g in groups for k, t in enumerate(g)}
    out, low = [], text.lower()
    if not any(t in low for t in after):
        return out
    for sentence in _SENTENCE.findall(low):
        words = set(_WORD.findall(sentence))
        if words & after.keys():
            out.append((words, {after.get(w, w) for w in words}))
    return out


def objective(rows: Sequence[Sequence[int]], labels: Sequence[int], swaps: Mapping[Swap, int], n_features: int, l2: float = L2, counterfactual: float = COUNTERFACTUAL) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The training loss and its gradient, as a function of the weights (the intercept last).

    Loss: mean logistic loss, classes weighed equally, plus ``l2`` times the
    squared weights, plus ``counterfactual`` times the mean squared change of
    the log-odds over the swapped sentences. ``swaps`` says how often each
    (features lost, features gained) occurs.
    """
    y = np.asarray(labels, dtype=np.float64)
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    col = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if sizes.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    pos = max(1.0, y.sum())
    weight = np.where(y > 0, 0.5 / pos, 0.5 / max(1.0, len(y) - pos))
    signs, s_col, s_row = [], [], []
    for k, (lost, gained) in enumerate(swaps):
        for sign, side in ((1.0, lost), (-1.0, gained)):
            s_col += list(side)
            s_row += [k] * len(side)
            signs += [sign] * len(side)
    s_col, s_row, signs = np.array(s_col, dtype=np.int64), np.array(s_row, dtype=np.int64), np.array(signs)
    times = np.array(list(swaps.values()), dtype=np.float64)

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, w[col], minlength=len(rows)) + w[-1]
        loss = weight @ (np.logaddexp(0, z) - y * z) + l2 * (w[:-1] @ w[:-1])
        g_row = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(col, g_row[row], minlength=n_features + 1).astype(np.float64)
        g[-1] = g_row.sum()
        if times.size:
            change = np.bincount(s_row, signs * w[s_col], minlength=times.size)
            loss += counterfactual * (times @ (change * change)) / times.sum()
            g += 2 * counterfactual / times.sum() * np.bincount(s_col, signs * (times * change)[s_row], minlength=n_features + 1)
        g[:-1] += 2 * l2 * w[:-1]
        return float(loss), g

    return at


def train(rows: Sequence[Sequence[int]], labels: Sequence[int], swaps: Mapping[Swap, int], n_features: int, l2: float = L2, counterfactual: float = COUNTERFACTUAL, steps: int = STEPS, rate: float = 0.3) -> np.ndarray:
    """Weights that make ``objective`` small: full-batch Adam, so they depend on the rows alone."""
    at = objective(rows, labels, swaps, n_features, l2, counterfactual)
    w = np.zeros(n_features + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = at(w)[1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def indexed_swaps(text: str, index: Mapping[str, int], groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> Counter[Swap]:
    """How often each swap occurs among all the sentences of a text that name an identity term."""
    side = lambda words: {index[f] for f in features_of(words) if f in index}
    out: Counter[Swap] = Counter()
    for before, after in counterfactuals(text, groups):
        a, b = side(before), side(after)
        out[tuple(sorted(a - b)), tuple(sorted(b - a))] += 1
    return out


def _feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, pos, docs): in how many toxic texts, and in how many, each feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            names = list(seen)
            for k in range(0, len(names), 10_000):
                part = names[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([seen[f][j] for f in part], pa.int64()) for j in (0, 1))], names=["feature", "pos", "docs"])
            seen.clear()

        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for f in features_of(words_of(t.as_py())):
                    both = seen.setdefault(f, [0, 0])
                    both[0] += y
                    both[1] += 1
                if len(seen) > HELD_FEATURES:
                    yield from counted()
        yield from counted()
        pa.default_memory_pool().release_unused()

    parts = sample.select("toxic", "text").mapInArrow(run, "feature string, pos long, docs long")
    return parts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("docs").alias("docs"))


def fit(labelled: DataFrame, max_features: int = MAX_FEATURES, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> dict[str, float]:
    """Feature weights from rows (doc_id, text, toxic); the intercept is at ``""``.

    ``labelled`` is a bounded sample (see ``training_rows``); all of it is used.
    Rows with a null text or label are left out. At most ``max_features``
    features come to the driver, and for each row the indices of those it has.
    """
    require(labelled, "doc_id", "text", "toxic")
    clean = labelled.filter("toxic is not null and text is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    sample = settle(clean.repartition(SAMPLE_ROWS // 500, "doc_id"), "toxic-sample")
    n_pos, n_all = (int(x or 0) for x in sample.agg(F.sum("toxic"), F.count(F.lit(1))).first())
    if not n_pos or n_pos == n_all:
        share = (n_pos + 0.5) / (n_all + 1)
        return {"": float(np.log(share / (1 - share)))}
    counted = _feature_counts(sample)
    rate = n_pos / n_all
    z = (F.col("pos") - F.col("docs") * rate) / F.sqrt(F.col("docs") * rate * (1 - rate))
    chosen = counted.filter(F.col("docs") >= LEAST_DOCS).withColumn("z", z).filter(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "feature").limit(max_features)
    names = sorted(r["feature"] for r in chosen.select("feature").collect())
    terms = sorted({t for g in groups for t in g})
    names = sorted({*names, *(f for f in features_of(set(terms)) if f.startswith("="))})
    index = {f: k for k, f in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found, swaps = [], []
                for t in part.column(1):
                    text = t.as_py()
                    found.append(sorted(index[f] for f in features_of(words_of(text)) if f in index))
                    swaps.append([{"lost": lost, "gained": gained, "times": n} for (lost, gained), n in indexed_swaps(text, index, groups).items()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(swaps, pa.list_(swap_type))], names=["toxic", "found", "swaps"])

    swap_type = pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32())), ("times", pa.int64())])
    got = sample.select("toxic", "text").mapInArrow(rows, "toxic int, found array<int>, swaps array<struct<lost:array<int>,gained:array<int>,times:bigint>>").toArrow()
    order = sorted(zip(got["toxic"].to_pylist(), got["found"].to_pylist(), strict=True))
    # Sentences that lose and gain the same features are one weighted swap, so few are held.
    total: Counter[Swap] = Counter()
    for held in got["swaps"].to_pylist():
        for s in held:
            total[tuple(s["lost"]), tuple(s["gained"])] += s["times"]
    w = train([f for _, f in order], [y for y, _ in order], dict(sorted(total.items())), len(names))
    return {"": float(w[-1])} | {f: float(w[k]) for f, k in index.items() if abs(w[k]) > 1e-6}


def score_column(weights: dict[str, float]):
    """A function that gives the score of a text column, 0 to 1.

    Every word of the text counts, once. Null and empty texts have the score of
    the intercept alone.
    """
    base = weights.get("", 0.0)
    whole = {f[1:]: w for f, w in weights.items() if f.startswith("=")}
    heads = {n: {f: w for f, w in weights.items() if f and f[0] != "=" and len(f) == n} for n in PREFIXES}
    heads = {n: h for n, h in heads.items() if h}

    def of(text: str | None) -> float:
        words = words_of(text)
        z = base + sum(sorted(whole[w] for w in words & whole.keys()))
        for n, h in heads.items():
            z += sum(sorted(h[f] for f in {w[:n] for w in words} & h.keys()))
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array([of(t.as_py()) for t in column], pa.float64())

    return scored


def score(docs: DataFrame, weights: dict[str, float], threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, score, predicted.

    Repeated rows repeat their result; an empty table gives no rows; other
    columns are ignored.
    """
    require(docs, "doc_id", "text")
    scored = docs.select("doc_id", score_column(weights)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold; all columns, nothing else changed."""
    verdict = score_column(fit(training_rows(docs, labels)))
    return docs.filter(verdict(F.col("text")) < threshold)


def held_out(doc_id):
    """Rows whose labels training never sees: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled texts (doc_id, text, toxic) that training may see.

    At most ``sample_rows`` ids, those with the smallest hash; an id with
    contradicting labels, a null id or a null label is not used.
    """
    require(labels, "doc_id", "toxic")
    known = labels.select(F.col("doc_id").alias("_id"), "toxic").filter("_id is not null and toxic is not null").distinct()
    known = known.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_id"))).filter("_n = 1").drop("_n")
    known = known.filter(~held_out(F.col("_id")))
    # The ids are at most sample_rows, so they go to the texts, not the texts to them.
    picked = known.orderBy(F.xxhash64(F.lit(3), "_id"), "_id").limit(sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(settle(picked, "toxic-ids")), F.col("doc_id") == F.col("_id")).drop("_id")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from ``labels`` and score every document: doc_id, held_out, score, predicted."""
    weights = fit(training_rows(docs, labels))
    return score(docs, weights).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
