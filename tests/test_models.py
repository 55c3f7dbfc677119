"""The queries that SQL can't express, against plain sequential models on the smallest tables."""

import re
import unicodedata
from collections import defaultdict
from difflib import SequenceMatcher

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return [r.asDict() for r in entry.registry.QUERIES[name](spark, SF).collect()]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def key(text):
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


def inside(a, b, least=4, free=6):
    """Whether one of two keys is safely part of the other."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    places = [i for i in range(len(b) - len(a) + 1) if b[i : i + len(a)] == a]
    return len(a) >= least and bool(places) and (len(a) >= free or 0 in places or len(b) - len(a) in places)


def tidy(text):
    shown = []
    for line in [x.strip() for x in text.splitlines()]:
        if not line:
            continue
        k = key(line)
        at = [i for i, (_, old) in enumerate(shown) if k and old and (old == k or inside(old, k))]
        if not at:
            shown.append((line, k))
        elif len(k) > len(shown[at[0]][1]):
            shown[at[0]] = line, k
    return "\n".join(line for line, _ in shown)


def merged(cues, meets, size):
    """Each cue in order goes to the last kept one that it meets."""
    kept = []
    for cue in sorted(cues):
        homes = [i for i, old in enumerate(kept) if meets(old, cue)]
        if not homes:
            kept.append(cue)
            continue
        old = kept[homes[-1]]
        kept[homes[-1]] = min(old[0], cue[0]), max(old[1], cue[1]), cue[2] if size(cue[2]) > size(old[2]) else old[2]
    return sorted(kept)


def close(a, b, gap):
    return b[0] - a[1] <= gap or min(a[1], b[1]) > max(a[0], b[0])


def contained(a, b):
    return key(a[2]) != key(b[2]) and bool(key(a[2]) and key(b[2])) and close(a, b, 1.0) and inside(key(a[2]), key(b[2]))


def similar(threshold):
    def meets(a, b):
        old, new = key(a[2]), key(b[2])
        sizes = sorted((len(old), len(new)))
        return sizes[0] >= 8 and close(a, b, 1.0) and sizes[0] / sizes[1] >= 0.75 and SequenceMatcher(None, new, old).ratio() >= threshold

    return meets


def settled(cues, threshold=0.95, gap=2.0):
    equal = lambda a, b: bool(key(b[2])) and key(a[2]) == key(b[2]) and b[0] - a[1] <= gap
    clean = lambda cs: [(a, b, tidy(t)) for a, b, t in cs if tidy(t)]
    now = clean(sorted(cues))
    for _ in range(3):
        before = now
        now = merged(now, equal, len)
        now = merged(now, contained, lambda t: len(key(t)))
        now = merged(now, similar(threshold), lambda t: len(key(t)))
        now = clean(now)
        if now == before:
            break
    return [(k + 1, *c) for k, c in enumerate(c for c in now if c[1] >= c[0] and c[1] - c[0] > 0.5)]


@pytest.fixture(scope="module")
def talk(spark):
    """{stream: [(turn, text)]}, the smallest text of each turn."""
    out = defaultdict(dict)
    for r in table(spark, "conversations"):
        out[r.conv_id][r.turn] = min(r.text, out[r.conv_id].get(r.turn, r.text))
    return {s: sorted(turns.items()) for s, turns in out.items()}


@pytest.fixture(scope="module")
def cues(talk):
    return {s: [(t * 1.0, t + 0.8, text) for t, text in turns] for s, turns in talk.items()}


@pytest.fixture(scope="module")
def frames(talk):
    """{stream: [(ord, frame, text, status)]} as the registered queries derive them."""
    out = {}
    for s, turns in talk.items():
        head = turns[0][1]
        text = lambda t, own: None if t % 7 == 6 else head if t % 4 == 0 else f"{head} again" if t % 4 == 2 else own  # noqa: B023, E731
        out[s] = [(t, t * (7 if s % 5 == 0 else 1) + 1, text(t, own), "truncated" if t % 5 == 3 else "ok") for t, own in turns]
    return out


def by_stream(rows, *names):
    out = defaultdict(list)
    for r in rows:
        out[r["stream"]].append(tuple(r[n] for n in names))
    return {s: sorted(v) for s, v in out.items()}


def test_line_dedupe_full(spark):
    want = {r.doc_id: None if r.text is None else tidy(r.text) for r in table(spark, "documents")}
    assert {r["doc_id"]: r["text"] for r in rows_of(spark, "line_dedupe_full")} == want


def test_contained_merge(spark, cues):
    want = {s: merged(c, contained, lambda t: len(key(t))) for s, c in cues.items()}
    assert by_stream(rows_of(spark, "contained_merge"), "start", "end", "text") == want


def test_similar_merge(spark, cues):
    want = {s: merged(c, similar(0.6), lambda t: len(key(t))) for s, c in cues.items()}
    assert by_stream(rows_of(spark, "similar_merge"), "start", "end", "text") == want


def test_postprocess(spark, cues):
    want = {s: settled(c) for s, c in cues.items()}
    assert by_stream(rows_of(spark, "postprocess"), "index", "start", "end", "text") == want


def test_parameter_sweep(spark, cues):
    rows = rows_of(spark, "parameter_sweep")
    for name, given in (("default", (0.95, 2.0)), ("loose", (0.6, 5.0))):
        want = {s: settled(c, *given) for s, c in cues.items()}
        assert by_stream([r for r in rows if r["params"] == name], "index", "start", "end", "text") == want


def test_fuzzy_pairs(spark, cues):
    want = {s: [(b[0], SequenceMatcher(None, key(b[2]), key(a[2])).ratio()) for a, b in zip(c, c[1:], strict=False)] for s, c in cues.items() if len(c) > 1}
    assert by_stream(rows_of(spark, "fuzzy_pairs"), "start", "ratio") == want


def followed(frames):
    """(ord, track or None) of a stream's frames, one by one."""
    out, track, made, last, before = [], None, 0, "", None
    for ord_, frame, text, status in frames:
        gap = before is not None and frame - before > 6
        before = frame
        k = key(text or "")
        if text is None or (status == "ok" and not k):
            track, last = None, ""
            out.append((ord_, None))
        elif status != "ok":
            out.append((ord_, track if track and not gap else None))
        else:
            alike = last and (k == last or SequenceMatcher(None, k, last).ratio() >= 0.86)
            if track is None or gap or not alike:
                made += 1
                track = made
            last = k
            out.append((ord_, track))
    return out


def test_crop_tracks_fuzzy(spark, frames):
    got = {s: [(o, t) for o, t in v] for s, v in by_stream([{**r, "t": r["track_id"] or 0} for r in rows_of(spark, "crop_tracks_fuzzy")], "ord", "t").items()}
    assert got == {s: [(o, t or 0) for o, t in followed(f)] for s, f in frames.items()}
    assert any(len({t for _, t in v}) < len(v) - 1 for v in got.values())


def voted(votes):
    """The text that stands for [(frame, text)]."""
    count, seen, texts = defaultdict(int), {}, defaultdict(lambda: defaultdict(int))
    for at, text in sorted(votes):
        t = tidy(text)
        if key(t):
            count[key(t)] += 1
            seen.setdefault(key(t), at)
            texts[key(t)][t] += 1
    if not count:
        return None
    best = min(count, key=lambda k: (-count[k], -len(k), seen[k]))
    rivals = [k for k in count if best in k and (k == best or count[k] >= max(2, 0.35 * count[best]))]
    chosen = min(rivals, key=lambda k: (-len(k), -count[k], seen[k]))
    return max(texts[chosen].items(), key=lambda x: x[1])[0]


def test_captions(spark, frames):
    want = {}
    for s, f in frames.items():
        clip = [(o * 4 + rep, o * 4 + rep, text, status) for o, _, text, status in f for rep in range(4)]
        letters = lambda t: sum(unicodedata.category(c).startswith("L") for c in t)
        clip = [(o, n, None if text is not None and status == "ok" and letters(text) <= 1 else text, status) for o, n, text, status in clip]
        held = defaultdict(list)
        for (o, track), (_, _, text, status) in zip(followed(clip), clip, strict=True):
            if track:
                held[track].append((o, text if status == "ok" and key(text) else ""))
        cues = []
        for rows in held.values():
            text = voted([(o, t) for o, t in rows if t])
            if len(rows) >= 3 and text:
                cues.append((rows[0][0] / 4.0, rows[-1][0] / 4.0, text))
        if found := settled(cues):
            want[s] = found
    assert by_stream(rows_of(spark, "captions"), "index", "start", "end", "text") == want and want


def overlap(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / both if w * h else 0.0


def apart(a, b):
    d, r = 1 - overlap(a[0], b[0]), SequenceMatcher(None, a[1], b[1]).ratio() if a[1] and b[1] else None
    if r is None:
        return d
    return 1.0 if r <= 0.3 else min(1.0, 0.76 * d + 0.24 * (1 - r) + (0.08 if r <= 0.35 else 0)) if r <= 0.35 else 0.76 * d + 0.24 * (1 - r)


def test_full_tracks(spark):
    seen = defaultdict(lambda: defaultdict(list))
    for r in table(spark, "embeddings"):
        e = [int((x + 1) * 500 // 1) for x in r.embedding[:4]]
        box = min(e[0], e[2]), min(e[1], e[3]), max(e[0], e[2]), max(e[1], e[3])
        seen[r.label][r.vec_id // 40].append((r.vec_id % 40, (box, f"t{r.vec_id % 7}")))
    want = []
    for stream, at in seen.items():
        live, made = {}, 0
        for frame in sorted(at):
            open_, hit = dict(at[frame]), set()
            # The nearest pair of all is matched first, then the nearest of those left.
            while pairs := [(d, i, n) for i, (state, _) in live.items() if i not in hit for n, s in open_.items() if (d := apart(s, state)) < 0.7]:
                _, i, n = min(pairs)
                want.append((stream, frame, n, i))
                live[i] = open_.pop(n), min(4, live[i][1] + 2)
                hit.add(i)
            live = {i: (s, h - 1) for i, (s, h) in live.items() if h - 1 >= 0}
            for n in sorted(open_):
                made += 1
                live[made] = open_[n], 1
                want.append((stream, frame, n, made))
    assert sorted((r["stream"], r["frame"], r["det_index"], r["track_id"]) for r in rows_of(spark, "full_tracks")) == sorted(want)
    assert len({(s, i) for s, _, _, i in want}) < len(want)


def test_layout_html(spark):
    want = []
    for r in table(spark, "pages"):
        page = f'<div data-label="Text" data-bbox="10 {r.page_id % 500} 900 990">{r.html or ""}</div>'
        assert not re.search(r"data-(label|bbox)", r.html or "")
        box = [10, r.page_id % 500, 900, 990]
        # Pixels of a 2000 by 1000 image: its last row and column are 1999 and 999.
        pixels = [round(v / 1000 * n) for v, n in zip(box, (1999, 999, 1999, 999), strict=True)]
        back = [round(v / n * 1000) for v, n in zip(pixels, (1999, 999, 1999, 999), strict=True)]
        want.append((r.page_id, 0, back, pixels))
        assert page.startswith("<div data-label")
    got = [(r["id"], r["pos"], r["pixel_bbox"]) for r in rows_of(spark, "layout_html")]
    assert sorted(got) == sorted((i, p, px) for i, p, _, px in want)
