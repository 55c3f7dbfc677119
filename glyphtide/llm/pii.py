"""Personal data: base patterns, and a semi-Markov conditional random field.

The field scores whole candidate spans (digit counts, check digits, shapes and
the word before them), and a dynamic programme with bounded entity length picks
boundaries and types together. It is trained here, on generated sentences with
known spans. Base spans always stay; the field decodes what they leave free.

Bounds on what the field can add (base spans have none): a span has at most
``MAX_TOKENS`` tokens, and lies within ``REACH`` characters of a digit or an at
sign, without a blank between beyond the outermost of these.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import require

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity at most, and characters that a candidate region reaches beyond a digit or an at sign.
MAX_TOKENS, REACH = 14, 48
#: Spans of up to so many characters have their features remembered.
REMEMBERED = 96
TRAIN_SENTENCES, EPOCHS, SEED = 150, 7, 11

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@](?:[0-9@ ().+/:-]*[0-9@])?")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\s:.#(+-]*$")
#: Words before a span that the field looks at.
CUES = {
    "tel": "phone", "telephone": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "teléfono": "phone", "téléphone": "phone", "telefon": "phone", "ruf": "phone",
    "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "card": "card", "visa": "card", "mastercard": "card", "karte": "card", "carte": "card", "tarjeta": "card",
    "mail": "email", "email": "email", "contact": "email", "version": "other", "page": "other", "id": "other", "order": "other", "isbn": "other", "line": "other",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Sorted (start, kind, end) of the four base patterns, in code points.

    Each kind is matched leftmost and without overlap; a match that fails its
    test is dropped and the search goes on behind it. Every search is linear:
    an email is grown from its at sign, as no other start can reach it.
    """
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Candidate regions: around digits and at signs, to the next blank or REACH characters."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        a, b = m.start(), m.end()
        while a > 0 and m.start() - a < REACH and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and b - m.end() < REACH and not text[b].isspace():
            b += 1
        if end >= 0 and a <= end + 1:
            end = max(end, b)
            continue
        if end >= 0:
            yield start, end
        start, end = a, b
    if end >= 0:
        yield start, end


def _shape(span: str) -> str:
    """Character classes, runs folded."""
    out = []
    for c in span:
        k = "d" if "0" <= c <= "9" else "a" if c.isalpha() else "_" if c.isspace() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _span_features(span: str, before: str, after: str, cue: str) -> tuple[str, ...]:
    """Features of a whole span; ``before`` and ``after`` are classes of its neighbours."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    n, shape = len(digits), _shape(span)
    bucket = "0" if not n else "1-6" if n < 7 else "7-8" if n < 9 else "9-11" if n < 12 else "12-15" if n < 16 else "16-19" if n < 20 else "20+"
    out = [f"n={bucket}", f"edge={before}{after}", f"cue={cue}|{bucket}", f"shape={shape}"]
    if n >= 12:
        out.append(f"luhn={luhn(digits) if n <= 19 else False}|{'a' in shape}")
    if "@" in span:
        head, _, tail = span.partition("@")
        out.append(f"at={bool(head)}{'.' in tail}{tail.count('@')}{any(c.isspace() for c in span)}{tail[-1:].isalnum()}")
    if span.count(".") == 3:
        parts = span.split(".")
        out.append(f"quad={all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}")
    if span[:1] in "+(" or span[:2] == "00":
        out.append(f"head={span[0]}|{bucket}")
    groups = re.findall("[0-9]+", span)
    if 2 <= len(groups) <= 6 and "a" not in shape and "@" not in span:
        out.append("groups=" + "-".join(str(len(g)) for g in groups))
    return tuple(out)


def _class(c: str) -> str:
    return "n" if c.isdigit() else "a" if c.isalpha() else "s" if not c or c.isspace() else "p"


class SemiCrf:
    """Weights by (label, feature); label 0 is outside and covers one token."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None):
        self.weights = weights or {}
        self.known: dict[tuple[str, str, str, str], tuple[str, ...]] = {}

    def features(self, *span: str) -> tuple[str, ...]:
        if len(span[0]) > REMEMBERED:
            return _span_features(*span)
        if span not in self.known:
            if len(self.known) >= 1 << 15:
                self.known.clear()
            self.known[span] = _span_features(*span)
        return self.known[span]

    def lattice(self, text: str, start: int, end: int, taken: Sequence[tuple[int, int]] = ()):
        """Token bounds, and for each pair (i, j) the features of tokens i to j.

        No span reaches into ``taken`` (disjoint, in order).
        """
        at = [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]
        m = _WORD_BEFORE.search(text, max(0, start - 40), start)
        cue0 = CUES.get(m[1].lower(), "-") if m else "-"
        spans, cue, k = {}, cue0, 0
        for i in range(len(at) - 1):
            token = text[at[i] : at[i + 1]]
            while k < len(taken) and taken[k][1] <= at[i]:
                k += 1
            stop = taken[k][0] if k < len(taken) else end
            if not token[0].isspace():
                left = _class(text[at[i] - 1 : at[i]])
                for j in range(i + 1, min(len(at), i + MAX_TOKENS + 1)):
                    if at[j] > stop:
                        break
                    if text[at[j] - 1].isspace():
                        continue
                    spans[i, j] = self.features(text[at[i] : at[j]], left, _class(text[at[j] : at[j] + 1]), cue)
            if token[0].isalpha():
                cue = CUES.get(token.lower(), "-")
        return at, spans

    def scores(self, n: int, spans) -> dict[tuple[int, int], np.ndarray]:
        w = self.weights
        return {k: np.array([sum(w.get((y, f), 0.0) for f in fs) for y in range(1, len(KINDS) + 1)]) for k, fs in spans.items()}

    def decode(self, text: str, start: int, end: int, taken: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int, int]]:
        """The segmentation with the greatest score: (start, kind, end) of its entities, none of which meets ``taken``."""
        at, spans = self.lattice(text, start, end, taken)
        n, score = len(at) - 1, self.scores(len(at) - 1, spans)
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        for j in range(1, n + 1):
            best[j], back[j] = best[j - 1], (j - 1, 0)
            for i in range(max(0, j - MAX_TOKENS), j):
                s = score.get((i, j))
                if s is not None and best[i] + s.max() > best[j]:
                    best[j], back[j] = best[i] + s.max(), (i, int(s.argmax()) + 1)
        out, j = [], n
        while j:
            i, y = back[j]
            if y:
                out.append((at[i], y - 1, at[j]))
            j = i
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, rate: float = 0.5, l2: float = 1e-3) -> SemiCrf:
        """Maximise the conditional likelihood of the known segmentations (AdaGrad)."""
        prepared = []
        for text, gold in examples:
            for a, b in regions(text):
                at, spans = self.lattice(text, a, b)
                index = {p: i for i, p in enumerate(at)}
                inside = {(index[s], index[e]): k + 1 for s, k, e in gold if s in index and e in index and a <= s and e <= b}
                prepared.append((len(at) - 1, spans, {k: y for k, y in inside.items() if k in spans}))
        seen: dict[tuple[int, str], float] = {}
        for _ in range(epochs):
            for n, spans, gold in prepared:
                score = self.scores(n, spans)
                fwd, bwd = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                fwd[0] = bwd[n] = 0.0
                total = {k: np.logaddexp.reduce(s) for k, s in score.items()}
                for j in range(1, n + 1):
                    terms = [fwd[j - 1]] + [fwd[i] + total[i, j] for i in range(max(0, j - MAX_TOKENS), j) if (i, j) in total]
                    fwd[j] = np.logaddexp.reduce(terms)
                for i in range(n - 1, -1, -1):
                    terms = [bwd[i + 1]] + [bwd[j] + total[i, j] for j in range(i + 1, min(n, i + MAX_TOKENS) + 1) if (i, j) in total]
                    bwd[i] = np.logaddexp.reduce(terms)
                grad: dict[tuple[int, str], float] = {}
                for (i, j), s in score.items():
                    p = np.exp(fwd[i] + s + bwd[j] - fwd[n])
                    p = -p
                    if (i, j) in gold:
                        p[gold[i, j] - 1] += 1
                    for y in np.flatnonzero(np.abs(p) > 1e-4):
                        for f in spans[i, j]:
                            grad[y + 1, f] = grad.get((y + 1, f), 0.0) + p[y]
                for k, g in grad.items():
                    g -= l2 * self.weights.get(k, 0.0)
                    seen[k] = seen.get(k, 1e-6) + g * g
                    self.weights[k] = self.weights.get(k, 0.0) + rate * g / np.sqrt(seen[k])
        return self


def training_sentences(n: int = TRAIN_SENTENCES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with known spans, and look-alikes that are no personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    num = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    word = lambda: "".join(pick(["an", "re", "the", "ou", "ti", "le", "ber", "cion", "st", "en"]) for _ in range(rng.integers(1, 4)))

    def card() -> str:
        body = pick(["4", "5", "37"]) + num(14)
        body = body[:15]
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = pick(["", " ", "-", "."])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def entity() -> tuple[int, str, str]:
        k = int(rng.integers(4))
        if k == 0:
            return 0, pick(["mail", "contact", word()]), f"{word()}{pick(['.', '_', ''])}{num(2)}@{word()}{pick(['', num(1)])}.{pick(['com', 'org', 'example.net'])}"
        if k == 1:
            return 1, pick(["host", "server", word()]), ".".join(str(x) for x in rng.integers(0, 256, 4))
        if k == 2:
            return 2, pick(["card", "visa", word()]), card()
        a, b, c = num(3), num(3), num(4)
        return 3, pick(["call", "tel", "phone", word()]), pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {a} {b}{c}", f"0{num(2)} {b} {c}", f"+{num(2)}{a}{b}{c}"])

    def decoy() -> str:
        a = [lambda: f"20{num(2)}-0{rng.integers(1, 10)}-1{num(1)}", lambda: f"version {num(1)}.{num(1)}.{num(2)}", lambda: f"{num(2)},{num(3)}.{num(2)}", lambda: num(int(rng.integers(1, 8)))]
        a += [lambda: f"id {num(16)}", lambda: 'token = "' + "".join(pick(list("0123456789abcdef")) for _ in range(40)) + '"', lambda: f"page {num(3)}", lambda: f"isbn {num(13)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"order {num(10)}", lambda: f"{word()} @ {word()}", lambda: f"{num(3)}.{num(3)}", lambda: "".join(pick(list("0123456789abcdef")) for _ in range(32))]
        return pick(a)()

    out = []
    for _ in range(n):
        text, gold = word(), []
        for _ in range(int(rng.integers(1, 4))):
            if rng.random() < 0.5:
                k, cue, body = entity()
                text += f" {cue}{pick([' ', ': '])}"
                gold.append((len(text), k, len(text) + len(body)))
                text += body
            else:
                text += " " + decoy()
            text += pick([" ", ", ", ". "]) + word()
        out.append((text, gold))
    return out


@functools.cache
def trained() -> SemiCrf:
    return SemiCrf().fit(training_sentences())


def find_spans(text: str | None, model: SemiCrf) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), both sorted; an added span overlaps no base span."""
    if not text:
        return [], []
    base = base_spans(text)
    taken: list[tuple[int, int]] = []
    for s, _, e in base:
        if taken and s <= taken[-1][1]:
            taken[-1] = taken[-1][0], max(e, taken[-1][1])
        else:
            taken.append((s, e))
    added, k = [], 0
    for a, b in regions(text):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] <= a and taken[k][1] >= b:
            continue
        # Disjoint and in order, so each lies in the one region that it is passed to, or in the next as well.
        first = k
        while k < len(taken) and taken[k][0] < b:
            k += 1
        added += model.decode(text, a, b, taken[first:k])
        k = max(first, k - 1)
    return base, sorted({*base, *added})


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, base counts, base_sha256 and all spans.

    Spans are ``kind:start:end`` in code points, by start, then kind in the
    order of ``KINDS``. Null and empty texts have no spans (the hash is that of
    the empty string). Rows are independent, so repeated rows repeat their
    result; an empty table gives no rows; other columns are ignored.
    """
    require(docs, "doc_id", "text")
    weights = trained().weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiCrf(weights)
        for batch in batches:
            rows = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
            for value in batch.column(1):
                base, every = find_spans(value.as_py(), model)
                for k, name in enumerate(KINDS):
                    rows[f"n_{name}"].append(sum(s[1] == k for s in base))
                rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows["spans"].append(joined(every))
            counts = [pa.array(rows[f"n_{k}"], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *counts, pa.array(rows["base_sha256"], pa.string()), pa.array(rows["spans"], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
