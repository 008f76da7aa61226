"""Periodic runs, vector codes and toxicity against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from obsidia.llm import codes, runs, toxicity

SCHEMA = "doc_id long, text string, lang string, runs string, features string, best string, toxic string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "x", "y", "z", "w", 0.5) for d, t in rows], SCHEMA)


def all_runs(w):
    """Runs by comparing every stretch with itself, a period at a time."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - a
            least = next(p for p in range(1, n + 1) if all(w[t] == w[t + p] for t in range(a, a + n - p)))
            if n >= max(12, 2 * q) and least == q:
                out.append((a, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_like(rng):
    n, alphabet, kind = rng.choice([0, 1, 11, 12, 13, 40, 150]), rng.choice([1, 2, 3, 9, 60]), rng.randrange(5)
    if kind == 0:
        w = [rng.randrange(alphabet) for _ in range(n)]
    elif kind == 1:
        w = []
        while len(w) < n:
            b = [rng.randrange(alphabet) for _ in range(rng.randint(1, 25))]
            w += b * rng.randint(1, 4) + b[: rng.randint(0, len(b))]
    elif kind == 2:
        a, w = [0], [0, 1]
        while len(w) < n:
            a, w = w, w + a
    elif kind == 3:
        w = ([0, 1] * rng.randint(1, 12) + [0] * rng.randint(0, 1)) * rng.randint(2, 4)
    else:
        w = [0] * rng.randint(0, 30) + [1] * rng.randint(0, 2) + [0] * rng.randint(0, 30) + [1] + [0] * rng.randint(0, 30)
    return [str(x).encode() for x in w]


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(120):
        texts = [words_like(rng) for _ in range(rng.randint(1, 5))]
        assert [[tuple(map(int, r)) for r in found] for found in runs.find_runs(texts)] == [all_runs(w) for w in texts]
    assert runs.find_runs([]) == []


def test_runs_of_long_texts():
    fibonacci = [[b"a"], [b"a", b"b"]]
    while len(fibonacci[-1]) < 6000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    one, two, many = runs.find_runs([[b"a"] * 50_000, [b"a", b"b"] * 9_000, fibonacci[-1]])
    assert one.tolist() == [[0, 50_000, 1]] and two.tolist() == [[0, 18_000, 2]] and len(many) > 1000


def report(doc_id, text, rewrite=True):
    w = (text or "").encode().split(b" ") if text and " " in text else [x for x in [(text or "").encode()] if x]
    w = [x for x in b" ".join(w).split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if rewrite and h % 10 == 0 and w:
        a = (h // 10) % len(w)
        p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = all_runs(w)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_report_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(w.decode() for w in words_like(rng))) for i in range(60)] + [(7, "a b " * 20), (7, "a b " * 20), (None, "c d e " * 9), (90, None), (91, ""), (92, " \t\n"), (93, "ü é " * 30 + " x")]
    planted = [i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 10 == 0]
    assert len(planted) > 3
    df = frame(spark, rows).repartition(3)
    got = runs.run_report(runs.periodic_runs(df, runs.planted))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((report(d, t) for d, t in rows), key=repr)
    assert runs.run_report(runs.periodic_runs(frame(spark, []))).count() == 0
    plain = {r.doc_id: r for r in runs.periodic_runs(frame(spark, [(1, "go " * 20 + "home")])).collect()}
    assert plain[1].collapsed == "go home" and [tuple(r) for r in plain[1].runs] == [(0, 20, 1)]


VECTORS = "vec_id long, embedding array<float>, label int, code string, v string, error string, total long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, g, "x", "y", "z", 1) for i, e, g in rows], VECTORS)


def coded(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds over whole numbers, every distance evaluated."""
    kept = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in e], g) for i, e, g in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(first[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            for e in range(len(first)):
                mine = [cut(v, p) for _, v, _ in kept if near(v, p)[1] == e]
                if mine:
                    new[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
        books = new
    out = []
    for i, v, g in kept:
        hits = [near(v, p) for p in range(parts)]
        out.append((i, g, "".join(f"{e:02x}" for _, e in hits), sum(d for d, _ in hits)))
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16).astype(np.float32)], int(i % 3) if i % 7 else None) for i in range(90)]
    rows += [(5, [0.25] * 16, 1), (5, [0.25] * 16, 1), (None, [0.5] * 16, 2), (200, None, 1), (201, [None] + [0.1] * 15, 1), (202, [float("nan")] + [0.1] * 15, 1), (203, [float("-inf")] + [0.1] * 15, 2), (204, [], 1)]
    want, digest = coded(rows)
    got, books = codes.compress(vectors(spark, rows).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and codes.books_digest(books) == digest
    totals = {}
    for _, g, _, e in want:
        totals[g] = totals.get(g, 0) + e
    assert all(r.label_error == totals[r.label] for r in codes.with_label_errors(got).collect())


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 8, 0) for i in range(3)]
    want, digest = coded(rows)
    got, books = codes.compress(vectors(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(want) and codes.books_digest(books) == digest and books.shape == (8, 3, 1)
    got, books = codes.compress(vectors(spark, [(1, None, 0)]))
    assert got.columns == ["vec_id", "label", "code", "error"] and got.count() == 0 and codes.books_digest(books) == hashlib.sha256(b"").hexdigest()
    assert codes.compress(vectors(spark, rows + [(9, [1.0] * 12, 0), (10, [1.0] * 16, 0)]), entries=2)[0].count() == 3
    with pytest.raises(ValueError):
        codes.compress(vectors(spark, rows + [(9, [1.0] * 16, 0)]))


def test_pivots_prune_and_lose_nothing():
    rng = np.random.default_rng(8)
    x = rng.integers(-3000, 3000, (400, 8, 8))
    x[:60] = x[0]  # equal rows
    books = x[rng.integers(0, 400, 16)].swapaxes(0, 1).copy()
    books[:, 3] = books[:, 9]  # equal entries: the lower one wins
    pivots = np.stack([codes.choose_pivots(b, 4) for b in books])
    entry, d, evaluated = codes.nearest(x, codes.to_pivots(x, pivots), books, pivots)
    every = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
    assert (entry == every.argmin(axis=2)).all() and (d == every.min(axis=2)).all() and evaluated < 0.8 * every.size


def toxic_docs(n, seed):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("lo", "ra", "ti", "men", "dor") for b in ("sa", "vel", "nu", "ki", "rem")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["snarkle", "grobbish", "you snarkle", "grobbisher"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_finds_held_out_rows(spark):
    rows, labels = toxic_docs(900, 1)
    rows += [(5000, "losa rakivel sn4rkl3 losa you snarkleee tinu gr0bbish"), (5001, None), (5002, ""), (None, "you grobbish snarkle of a losa"), (3, rows[3][1])]
    labels += [(3, 0), (4, None), (None, 1), (9999, 1)]
    got = toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    held = [(r.doc_id % 5 == 0, r.predicted) for r in found if r.held_out and r.doc_id < 900]
    assert len(held) > 200 and sum(bool(a) == bool(b) for a, b in held) >= 0.98 * len(held)
    by_id = {r.doc_id: r for r in found}
    assert by_id[5000].predicted == by_id[None].predicted == 1 and by_id[5001].score == by_id[5002].score < 0.7
    assert not by_id[None].held_out and len({r.score for r in found if r.doc_id == 3}) == 1
    # the score is a function of the text
    again = toxicity.toxicity(frame(spark, rows).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert max(abs(a.score - b.score) for a, b in zip(sorted(found, key=repr_of), sorted(again.collect(), key=repr_of))) < 1e-6


def repr_of(r):
    return repr((r.doc_id, r.features))


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, [(1, "some words"), (2, None)]), none).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 0)] * 2
    assert toxicity.toxicity(frame(spark, []), none).count() == 0
    one_class = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (6, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(frame(spark, [(i, "a b") for i in range(1, 8)]), one_class).collect()} == {1}


def test_lexicon_entries_equal_brute_force(spark):
    rows, labels = toxic_docs(300, 2)
    df = spark.createDataFrame([(t, x) for (_, t), (_, x) in zip(rows, labels)], "text string, toxic int").repartition(4)
    got = toxicity.learn_lexicon(df)
    n, k = {}, {}
    for (_, t), (_, x) in zip(rows, labels):
        for e in toxicity.text_entries(t):
            n[e], k[e] = n.get(e, 0) + 1, k.get(e, 0) + x
    share = sum(x for _, x in labels) / len(labels)
    tried = [e for e in n if k[e] >= toxicity.MIN_TEXTS]
    kl = lambda a, m: a * np.log(a / m / share) + (0 if a == m else (m - a) * np.log((1 - a / m) / (1 - share)))
    weight = {e: np.log((k[e] + 0.5) / (n[e] - k[e] + 0.5)) - np.log(share / (1 - share)) for e in tried}
    want = {e: weight[e] for e in tried if kl(k[e], n[e]) >= np.log(len(tried)) and weight[e] >= toxicity.MIN_WEIGHT}
    assert got.keys() == want.keys() and "snarkle" in got and all(abs(got[e] - want[e]) < 1e-9 for e in got)


def test_features_of_one_text():
    f = dict(zip(toxicity.FEATURES, toxicity.Lexicon({"snarkle": 2.0}).measure(["You SNARKLE!! what? sn4rkle ok", ""])[0]))
    assert f["lexicon_rate"] == 2 / 5 and f["near_you_share"] == 1 and f["you_rate"] == 1 / 5 and f["shout_rate"] == 1 / 5
    assert f["obfuscated_rate"] == f["obfuscated_hits"] == 1 / 5 and f["lexicon_max"] == 2.0 and f["mark_rate"] == 3 / 5
