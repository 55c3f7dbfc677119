import hashlib
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphtide.llm import decontaminate, lines, minhash, pii, toxicity

from .data import docs, empty, prose

# --- personal data ---------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab1234567890.@-+() %é\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_known_texts():
    text = "é 4111 1111 1111 1111, +1 (743) 555-3824; a.b@c-d.example.com.\n10.0.0.255 256.1.1.1 1.2.3.4.5.6.7.8"
    assert pii.base_spans(text) == plain_spans(text) and len(pii.base_spans(text)) == 6


def test_the_field_finds_what_the_patterns_miss():
    model = pii.trained()
    for text, kind in (("call (743) 555-3824 now", 3), ("card 4111.1111.1111.1111 ok", 2)):
        base, every = pii.find_spans(text, model)
        assert not base and [k for _, k, _ in every] == [kind]
    for text in ("on 2024-01-05 at 10:20", "version 2.0 of 1,234.50", 'token = "24be64439e3e49cf46b2d7c90f3602a3"', "no digits at all"):
        assert pii.find_spans(text, model) == ([], [])


def test_added_spans_never_clash():
    model = pii.trained()
    for text, _ in pii.training_sentences(200, seed=77):
        base, every = pii.find_spans(text, model)
        assert set(base) <= set(every)
        for s, _, e in set(every) - set(base):
            assert all(e <= bs or be <= s for bs, _, be in base)


def every_segmentation(n, spans):
    """All ways to cover tokens 0 to n with single outside tokens and candidate spans."""
    if not n:
        yield []
        return
    for rest in every_segmentation(n - 1, spans):
        yield rest
    for i, j in spans:
        if j == n:
            for rest in every_segmentation(i, spans):
                yield [*rest, (i, j)]


@pytest.mark.parametrize("taken", [[], [(6, 14)], [(0, 3), (9, 11)]])
def test_decoding_is_the_best_of_all_segmentations(taken):
    model = pii.trained()
    for text in ("call +49 30 1234567 x", "a.b@c.d 1.2.3.4", "tel (743) 555-3824", "id 4111-1111"):
        at, spans = model.lattice(text, 0, len(text), taken)
        assert all(at[j] <= s or e <= at[i] for i, j in spans for s, e in taken)
        score = model.scores(len(at) - 1, spans)
        best = max(sum(score[s].max() for s in way) for way in every_segmentation(len(at) - 1, spans))
        index = {p: k for k, p in enumerate(at)}
        found = model.decode(text, 0, len(text), taken)
        assert abs(sum(score[index[s], index[e]][k] for s, k, e in found) - best) < 1e-9
        assert all(found[k][2] <= found[k + 1][0] for k in range(len(found) - 1))


def test_the_field_decodes_what_base_spans_leave():
    model = pii.trained()
    base, every = pii.find_spans("mail a.b@c.example.com/(743) 555-3824 now", model)
    assert [k for _, k, _ in base] == [0] and {k for _, k, _ in every} == {0, 3}


def test_spans_of_a_very_long_text_take_linear_time():
    import time

    model = pii.trained()
    for unit in ("a.b7@c.example.com ", "call (743) 555-3824, ", "1.2.3.4 "):
        took = []
        for n in (5_000, 40_000):
            began = time.process_time()
            base, every = pii.find_spans(unit * n, model)
            took.append(time.process_time() - began)
            assert len(every) >= n
        assert took[1] < 16 * took[0] + 1
    base, every = pii.find_spans("a@b.co " * 100_000, model)
    assert len(base) == 100_000


def test_pii_of_awkward_rows(spark):
    frame = docs(spark)
    got = pii.find_pii(frame).collect()
    assert len(got) == frame.count()
    for r in got:
        if r.doc_id in (4, 5, 6, 7, 8):
            assert (r.n_email, r.spans, r.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert pii.find_pii(empty(spark)).collect() == []


# --- toxicity -----------------------------------------------------------------------------------


def toxic_rows(n=600):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        group = "muslim" if (toxic and i % 12) or i % 50 == 3 else "people"
        rows.append((i, f"{prose(i, 40)}. the {group} {'vexmor' + prose(i, 1) if toxic else 'went'} home. {prose(i + 9000, 20)}"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_forgives_groups(spark):
    rows, labels = toxic_rows()
    frame, known = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame, known).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    sample = toxicity.training_rows(frame, known)
    weights = toxicity.fit(sample)
    free = toxicity.fit(sample, groups=())
    effect = lambda w, term: sum(w.get(f, 0.0) for f in toxicity.features_of({term}))
    gap = lambda w: abs(effect(w, "muslim") - effect(w, "christian"))
    assert gap(weights) < 0.5 * gap(free)
    mention = docs(spark, [(1, "the muslim went home"), (2, "the christian went home"), (3, None), (4, "")])
    a = {r.doc_id: r for r in toxicity.score(mention, weights).collect()}
    assert a[1].predicted == a[2].predicted == 0 and a[3].score == a[4].score


def test_counterfactual_penalty_ties_terms():
    rows, y = [[0, 2], [0], [2], [1], [1], [0, 2]], [1, 1, 0, 0, 0, 1]
    free = toxicity.train(rows, y, {}, 3)
    tied = toxicity.train(rows, y, {((0,), (1,)): 1}, 3, counterfactual=50.0)
    assert abs(tied[0] - tied[1]) < 0.05 * abs(free[0] - free[1])


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    rows = [sorted(set(rng.integers(0, 8, 4).tolist())) for _ in range(40)]
    y = rng.integers(0, 2, 40).tolist()
    swaps = {((0,), (1,)): 3, ((2, 3), (4,)): 1, ((), (5,)): 2, ((), ()): 7}
    at = toxicity.objective(rows, y, swaps, 8, l2=0.01, counterfactual=3.0)
    w = rng.standard_normal(9)
    loss, g = at(w)
    for k in range(9):
        step = np.eye(9)[k] * 1e-6
        assert abs((at(w + step)[0] - at(w - step)[0]) / 2e-6 - g[k]) < 1e-6
    # By hand: the penalty is the mean squared change of the log-odds, over every sentence.
    plain = toxicity.objective(rows, y, {}, 8, l2=0.01)(w)[0]
    change = [w[0] - w[1]] * 3 + [w[2] + w[3] - w[4]] + [-w[5]] * 2 + [0.0] * 7
    assert abs(loss - plain - 3.0 * np.mean(np.square(change))) < 1e-9


def test_every_identity_sentence_of_a_text_is_swapped():
    text = " ".join(f"Some {a} and {b} met word{k}." for k, (a, b) in enumerate([("women", "gay"), ("men", "jews"), ("black", "muslim")] * 9))
    index = {f: k for k, f in enumerate(sorted({f for g in toxicity.IDENTITY_GROUPS for t in g for f in toxicity.features_of({t})} | {"=met"}))}
    got = toxicity.indexed_swaps(text, index)
    assert sum(got.values()) == 27 and set(got.values()) == {9}
    after = {t: g[(k + 1) % len(g)] for g in toxicity.IDENTITY_GROUPS for k, t in enumerate(g)}
    for sentence in text.lower().split("."):
        words = set(sentence.split())
        if words & after.keys():
            a, b = ({index[f] for f in toxicity.features_of(side) if f in index} for side in (words, {after.get(w, w) for w in words}))
            assert (tuple(sorted(a - b)), tuple(sorted(b - a))) in got


def test_held_out_rows_are_never_read(spark):
    import zlib

    rows, labels = toxic_rows(200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (toxicity.toxicity(docs(spark, rows), spark.createDataFrame(x, schema)).collect() for x in (labels, flipped))
    assert [(r.doc_id, r.score) for r in a] == [(r.doc_id, r.score) for r in b]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in a)


def test_toxicity_of_awkward_rows(spark):
    frame = docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (3, None, None), (12, 1, 1), (13, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(frame, labels).count() == frame.count()
    assert toxicity.toxicity(frame, labels.filter("false")).count() == frame.count()
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    assert toxicity.clean_documents(frame, labels.filter("false")).columns == frame.columns


# --- near duplicates --------------------------------------------------------------------------------


def brute_classes(rows, similarity=0.8):
    """Classes from all pairs, in memory, with the operator's own weights."""
    seen = np.zeros(minhash.COUNTERS, dtype=np.int64)
    known = [(i, t) for i, t in rows if t is not None]
    for _, t in known:
        seen[np.unique(minhash.shingles(t)[0] & np.uint64(minhash.COUNTERS - 1)).astype(int)] += 1
    sampler = minhash.Sampler(minhash.inverse_frequencies(seen, len(rows)))
    sets = {t: minhash.shingles(t) for _, t in known}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(known, 2):
        if a == b or (sets[a][0].size and sets[b][0].size and sampler.similarity(sets[a], sets[b]) >= similarity):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i, _ in rows}


def near_rows():
    rows, n = [], 0
    for g in range(30):
        words = prose(100 + g, 150 + g).split()
        for k in range(1 + g % 5):
            changed = list(words)
            for c in range(k):
                changed[(17 * c + 11 * k) % len(words)] = f"other{g}{k}{c}"
            rows.append((n, " ".join(changed)))
            n += 1
    words = prose(900, 300).split()
    for k in range(120):
        changed = list(words)
        changed[(7 * k) % 300] = f"big{k}"
        rows.append((n, " ".join(changed)))
        n += 1
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rows = near_rows()
    want = brute_classes(rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    linked = [(i, j) for (i, _), (j, _) in combinations(rows, 2) if want[i] == want[j]]
    missed = sum(got[i].class_id != got[j].class_id for i, j in linked)
    assert missed <= 0.02 * len(linked)
    assert all(want[i] == want[got[i].class_id] for i in got)
    assert sum(r.kept for r in got.values()) == len({r.class_id for r in got.values()})


def test_near_duplicates_of_awkward_rows(spark):
    frame = docs(spark)
    rows = minhash.near_duplicates(frame).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == frame.count()
    assert got[1].class_id == got[2].class_id == got[3].class_id == 1 and got[6].class_id == got[7].class_id == 6
    assert got[4].class_id == 4 and got[5].class_id == 5 and got[10].class_id == 9 and got[8].class_id == 8 and got[None].class_id is None
    assert minhash.near_duplicates(empty(spark)).collect() == []
    kept = minhash.distinct_documents(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, 8, 9, 11, 12, 13, None, 15, 16]))
    kept = minhash.distinct_documents(docs(spark, [(1, "a b c"), (2, "a b c"), (2, "d e f")])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a b c"), (2, "d e f")]
    with pytest.raises(ValueError, match="integer"):
        minhash.near_duplicates(frame.withColumn("doc_id", F.lit("x")))


def crowd_rows():
    """Pairs, triples and lone texts that share most of their words with hundreds of others."""
    rows, shared = [], prose(800, 170).split()
    for g in range(70):
        own = prose(810 + g, 30 + g % 25).split()
        for k in range(1 + g % 3):
            changed = list(own)
            if k:
                changed[5 * k] = f"edit{g}x{k}"
            cut = 3 * (g % 4)
            rows.append((len(rows), " ".join([*shared[cut:], *changed])))
    return rows


@pytest.mark.parametrize("full", [2, 16])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, full):
    rows = crowd_rows()
    want = brute_classes(rows)
    monkeypatch.setattr(minhash, "FULL", full)
    monkeypatch.setattr(minhash, "SLICE", 8)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == want and len(set(want.values())) > 20


def test_prefixes_meet_for_every_similar_pair(spark):
    rows = crowd_rows()[::2] + [(i + 1000, t) for i, t in near_rows()[:60]]
    idf = np.linspace(1, 6, minhash.COUNTERS).astype(np.float32)
    sampler = minhash.Sampler(idf)
    texts = spark.createDataFrame(rows, "rep long, text string")
    prefixes = minhash._prefixes(texts, spark.sparkContext.broadcast(idf), 0.8)
    named = prefixes.withColumn("class", F.col("rep")).withColumn("open", F.lit(True))
    got = {(r.a, r.b) for r in minhash._prefix_pairs(named, 0.8).collect()}
    sets = {i: minhash.shingles(t) for i, t in rows}
    near = {(min(a, b), max(a, b)) for a, b in combinations(sets, 2) if sampler.similarity(sets[a], sets[b]) >= 0.8}
    assert near <= got and len(near) > 20 and len(got) < 0.3 * len(rows) ** 2 / 2


def test_rows_without_or_with_a_shared_id_are_told_by_their_text(spark):
    words = prose(70, 200).split()
    base, close = " ".join(words), " ".join([*words[:100], "changed", *words[101:]])
    rows = [(None, prose(71, 60)), (None, prose(72, 60)), (None, base), (None, close), (None, None), (None, None), (7, prose(73, 60)), (7, prose(74, 60)), (7, prose(74, 60)), (8, prose(75, 60)), (9, prose(75, 60))]
    kept = [(r.doc_id, r.text) for r in minhash.distinct_documents(docs(spark, rows)).collect()]
    near = [x for x in kept if x[1] in (base, close)]
    assert len(near) == 1
    want = [(None, prose(71, 60)), (None, prose(72, 60)), (None, None), (None, None), (7, prose(73, 60)), (7, prose(74, 60)), (8, prose(75, 60))]
    assert sorted(map(str, (x for x in kept if x not in near))) == sorted(map(str, want))
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.links for r in got) == 2 and sum(r.kept for r in got) == 9


def test_draws_agree_as_often_as_texts_are_similar():
    sampler = minhash.Sampler(np.ones(minhash.COUNTERS), bands=400, rows=1)
    words = prose(5, 400).split()
    for change in (20, 60):
        other = list(words)
        for k in range(0, 400, 400 * 5 // change // 5 or 1):
            other[k] = f"w{k}"
        a, b = minhash.shingles(" ".join(words)), minhash.shingles(" ".join(other))
        same = np.mean(sampler.band_keys(*a, np.array([0, a[0].size]))[0] == sampler.band_keys(*b, np.array([0, b[0].size]))[0])
        assert abs(same - sampler.similarity(a, b)) < 0.09


def test_shingle_batches_equal_single_texts():
    texts = ["", "one two", prose(1, 30), "ä ö ü ß é　x", prose(2, 5), None, "A b-C d, E f!" * 3]
    hashes, counts, offsets = minhash.shingle_batch(texts)
    for k, t in enumerate(texts):
        h, c = minhash.shingles(t or "")
        assert (hashes[offsets[k] : offsets[k + 1]] == h).all() and (counts[offsets[k] : offsets[k + 1]] == c).all()


# --- decontamination ------------------------------------------------------------------------------------


def test_leaks_are_found_and_prose_is_left(spark):
    item = prose(50, 30)
    maths = "A train leaves Berlin with 120 people and each of them pays 15 euros for a seat to Hamburg, how much do they pay for 3 hours"
    maths2 = "a train leaves Munich with 340 people and each of them pays 22 euros for a seat to Cologne, how much do they pay for 7 hours"
    mixed = "A train leaves Berlin with 120 people and then 120 cars and then 120 dogs and each of them goes to 120 towns for 120 days"
    mixed2 = "A train leaves Berlin with 120 people and then 130 cars and then 140 dogs and each of them goes to 150 towns for 160 days"
    rows = [
        (1, prose(51, 100) + " " + item + " " + prose(52, 100)), (2, item.upper()), (3, prose(53, 300)), (4, "Start. " + maths2 + " End"), (5, " ".join(item.split()[:9])), (6, "We saw. " + mixed2), (7, None), (8, ""), (1, prose(53, 300)),
    ]
    bench = spark.createDataFrame([(0, item, 1), (1, maths, 1), (2, None, 1), (3, "", 1), (4, "too short", 1), (5, mixed, 1), (6, item, 2), (7, "six words are an item too", 1)], "item_id long, text string, h1 long")
    frame = docs(spark, [*rows, (9, "yes, six words are an item too.")])
    got = {(r.doc_id, r.item_id, r.changed) for r in decontaminate.leaks_by_document(frame, bench).collect()}
    assert got == {(1, 0, False), (1, 6, False), (2, 0, False), (2, 6, False), (4, 1, True), (9, 7, False)}
    clean = decontaminate.clean_documents(frame, bench)
    assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.collect()) == [1, 3, 5, 6, 7, 8]
    none = bench.filter("false")
    assert decontaminate.leaks_by_document(frame, none).count() == 0 and decontaminate.clean_documents(frame, none).count() == frame.count()
    assert decontaminate.leaks_by_document(empty(spark), bench).count() == 0
    assert decontaminate.clean_documents(docs(spark), bench).count() == docs(spark).count()


def test_a_passage_is_judged_by_itself(spark):
    item = "Each of the 12 drivers in the city pays 15 euros for a seat at the table and 30 euros for a seat at the door of the old hall"
    other = item.replace("12", "70").replace("15", "44").replace("30", "44")
    short = "What is the name of that river here"
    spread = prose(80, 60).split()
    scattered = " and so ".join(" ".join([*spread[k : k + 8], f"x{k}"]) for k in (0, 10, 20, 30, 40, 50))
    bench = spark.createDataFrame([(0, item), (1, short), (2, " ".join(spread)), (3, item.replace("12", "12 or 13"))], "item_id long, text string")
    rows = [(1, f"{item}. {prose(81, 40)}. {other}"), (2, f"They then asked, {short} or there"), (3, scattered), (4, other)]
    got = {(r.doc_id, r.item_id, r.changed) for r in decontaminate.leaks_by_document(docs(spark, rows), bench).collect()}
    assert {(1, 0, False), (2, 1, False)} <= got and {i for i, _, _ in got} == {1, 2}


# --- lines -------------------------------------------------------------------------------------------------


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_lines(rows):
    shown = sorted((i, k, line) for i, t in rows if t is not None for k, line in enumerate(t.split("\n")) if line.strip())
    first = {}
    for i, k, line in shown:
        first.setdefault(line, (i, k))
    gone = defaultdict(dict)
    for i, k, line in shown:
        if first[line] != (i, k):
            gone[i][k] = first[line]
        elif len(line) >= lines.LEAST_CHARS:
            near = [at for other, at in first.items() if at < (i, k) and len(other) >= lines.LEAST_CHARS and within_one(line, other)]
            if near:
                gone[i][k] = min(near)
    return {i: ",".join(f"{k}={d}:{n}" for k, (d, n) in sorted(gone[i].items())) for i, _ in rows}


def test_lines_against_all_pairs(spark):
    rows = []
    for i in range(60):
        base = prose(i % 7, 8)
        at = (5 * i) % len(base)
        kinds = [base, base[:at] + "Z" + base[at:], base[:at] + base[at + 1 :], base[:at] + "é" + base[at + 1 :], "aaaaaaaaaaaaaaaaaaaaaaaa" + "a" * (i % 3), "short", " ", base + "\r"]
        rows.append((i, "\n".join(kinds[(i * k + k) % 8] for k in range(5))))
    want = brute_lines(rows)
    got = {r.doc_id: r.dropped for r in lines.dedup_report(docs(spark, rows)).collect()}
    assert got == want and any("=" in x for x in want.values())
    for r in lines.dedup_text(docs(spark, rows)).collect():
        numbers = {int(x.split("=")[0]) for x in want[r.doc_id].split(",") if x}
        assert r.text == "\n".join(x for k, x in enumerate(dict(rows)[r.doc_id].split("\n")) if k not in numbers)


def test_lines_of_awkward_rows(spark):
    frame = docs(spark)
    got = {r.doc_id: r for r in lines.dedup_report(frame).collect()}
    assert set(got) == {r.doc_id for r in frame.select("doc_id").collect()}
    assert got[4].dropped == got[6].dropped == got[8].dropped == "" and got[2].dropped == "0=1:0" and got[12].dropped == "2=12:0"
    assert lines.dedup_report(empty(spark)).collect() == []
    assert lines.dedup_text(frame).columns == frame.columns
