"""Decontamination and mixing against plain models: every window by itself, every word by itself."""

import random
import struct
from collections import defaultdict
from fractions import Fraction

import numpy as np
import regex
import xxhash

from glyphtide.llm import decontaminate, mixing

from .data import docs, prose

# --- decontamination --------------------------------------------------------------------------


def parts(text):
    """(kind, word) of each token: kind n for a name, # for a number, u for a unit, else empty."""
    out = []
    words = list(regex.finditer(r"[\p{L}\p{M}\p{N}_]+(?:[.,][0-9]+)*", text))
    for m in words:
        word, before = m[0], text[: m.start()]
        if regex.fullmatch(r"[0-9]+(?:[.,][0-9]+)*", word):
            kind = "#"
        elif out and out[-1][0] == "#" and regex.search(r"[0-9][ -]?$", before) and regex.fullmatch(decontaminate.UNITS, word, regex.I):
            kind = "u"
        elif regex.match(r"\p{Lu}\p{Ll}", word) and regex.search(r"[\p{L}\p{N},;:] $", before):
            kind = "n"
        else:
            kind = ""
        out.append((kind, word.lower()))
    return out


def same_window(a, b):
    """Whether two windows have one template; a word at the start may be a name to one side alone."""
    first = lambda t: {(t[0], "" if t[0] else t[1])} | ({("", t[1])} if t[0] in ("n", "u") else set())
    rest = lambda w: [(k, "" if k else t) for k, t in w[1:]]
    return bool(first(a[0]) & first(b[0])) and rest(a) == rest(b)


def leaks(text, item, width=8, least=5):
    """None, or (windows of the longest passage, changed)."""
    doc, own = parts(text), parts(item)
    if len(own) < 5:
        return None
    width = min(width, len(own))
    total, found = len(own) - width + 1, []
    for shift in range(-len(own), len(doc)):
        stands, pairs = {}, set()
        for p in range(total):
            q = p + shift
            if q < 0 or q + width > len(doc) or not same_window(doc[q : q + width], own[p : p + width]):
                continue
            slots = [(own[i], doc[i + shift]) for i in range(p, p + width) if own[i][0] and doc[i + shift][0]]
            literal = sum(not own[i][0] for i in range(p, p + width))
            if literal >= 4 or all(a == b for a, b in slots):
                stands[p] = all(a == b for a, b in slots)
                pairs |= set(slots)
        one = len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
        if len(stands) >= min(least, total) and one:
            found.append((len(stands), any(a != b for a, b in pairs)))
        elif stands:
            runs = defaultdict(int)
            exact = sorted(p for p, same in stands.items() if same)
            for k, p in enumerate(exact):
                runs[p - k] += 1
            if (longest := max(runs.values(), default=0)) >= min(least, total):
                found.append((longest, False))
    return (max(w for w, _ in found), all(c for _, c in found)) if found else None


NAMES, UNITS = ["Berlin", "Paris", "Anna", "Otto", "Rome"], ["euros", "hours", "km", "days"]


def question(rng):
    out = []
    for k in range(rng.randint(12, 26)):
        kind = rng.random()
        out.append(f"{rng.randint(1, 99)} {rng.choice(UNITS)}" if kind < 0.12 else str(rng.randint(1, 99)) if kind < 0.2 else rng.choice(NAMES) if kind < 0.32 and k else prose(rng.randrange(10**6), 1))
    return " ".join(out)


def variant(rng, text):
    """The same question with other values, each for each or at random."""
    known = {}
    swap = lambda m: known.setdefault(m[0], str(rng.randint(100, 999)))
    out = regex.sub(r"\b[0-9]+\b", swap if rng.random() < 0.6 else lambda m: str(rng.randint(100, 103)), text)
    names = dict(zip(NAMES, rng.sample(NAMES, len(NAMES)), strict=True))
    return regex.sub("|".join(NAMES), lambda m: names[m[0]], out)


def test_leaks_against_every_window(spark):
    rng = random.Random(8)
    items = [(i, question(rng)) for i in range(12)] + [(20, "how far is it home"), (21, "too short"), (22, None), (23, "")]
    rows = []
    for i in range(70):
        bits = []
        for _ in range(rng.randint(1, 4)):
            item = rng.choice(items[:13])[1]
            words = item.split()
            cut = rng.randrange(len(words))
            bits += rng.choice([[item], [variant(rng, item)], [variant(rng, item), prose(i, 9), variant(rng, item)], [item, prose(i, 5), variant(rng, item)], [" ".join(words[cut:])], [" ".join(words[: cut + 1])], [w + " " + prose(cut, 1) for w in (" ".join(words[k : k + 9]) for k in range(0, len(words), 9))]])
            bits.append(prose(1000 + i, rng.randint(1, 12)))
        rows.append((i, " ".join(bits)))
    rows += [(90, None), (91, "")]
    want = {(d, i): found for d, t in rows if t for i, q in items if q and (found := leaks(t, q))}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.windows, r.changed) for r in decontaminate.leaks_by_document(docs(spark, rows), bench).collect()}
    assert got == want and len(want) > 60 and 10 < sum(c for _, c in want.values()) < len(want) - 10


# --- mixing ---------------------------------------------------------------------------------------


def spark_hash(*values):
    """xxhash64 of an int and a long, as Spark chains them."""
    seed = 42
    for v, kind in zip(values, "iq", strict=True):
        seed = xxhash.xxh64_intdigest(struct.pack(f"<{kind}", v), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def seats(weights, n):
    """Sainte-Lague, a seat at a time."""
    got = [0] * len(weights)
    for _ in range(n):
        best = max(range(len(weights)), key=lambda i: (Fraction(weights[i]) / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_taken_words_against_every_word(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 12)
    rows = [(3 * i, prose(i, 1 + i * i % 97) if i % 11 else None) for i in range(120)]
    frame = docs(spark, rows)
    source = {r.doc_id: r.source for r in frame.select("doc_id", "source").collect()}
    size = {i: len((t or "").split()) for i, t in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    by_name = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    target = dict(zip(names, mixing.source_targets(list(by_name.values()), [5, 2, 1][: len(names)]), strict=True))
    cells = defaultdict(list)
    for s in names:
        mine = [i for i in size if source[i] == s]
        for i in mine:
            cells[names.index(s), spark_hash(17, i) % max(1, -(-len(mine) // 12))].append(i)
    order = sorted(cells)
    words = {c: sum(size[i] for i in cells[c]) for c in order}
    shares = [target[names[s]] * words[s, k] / by_name[names[s]] for s, k in order]
    block = int(max(1, min(1024, min(x for x in shares if x > 0) // 100)))
    quotas = seats(shares, int(sum(shares) / block + 0.5))
    rng, taken = np.random.default_rng(17), dict.fromkeys(size, 0)
    for c, quota in zip(order, quotas, strict=True):
        first = int(rng.integers(0, max(1, -(-words[c] // block)))) * block
        tape = [i for i in sorted(cells[c], key=lambda i: (spark_hash(18, i), i)) for _ in range(size[i])]
        for k in range(min(quota * block, 3 * len(tape))):
            taken[tape[(first + k) % len(tape)]] += 1
    got = mixing.mix(frame).collect()
    assert {r.doc_id: r.taken for r in got} == taken and {r.doc_id: r.size for r in got} == size
    assert all(r.source_size == by_name[r.source] and abs(r.target - target[r.source]) < 1e-6 for r in got)
