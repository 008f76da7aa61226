"""Rows judged by their own text, the whole pipeline against brute force, and language models of many labels."""

import json
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from obsidia.llm import benchmarks, language, lines, near_duplicates, suffixes
from obsidia.llm.subwords import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, held string, h long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", None if t is None else len(t), "d", "x", 1) for i, t, g in rows], SCHEMA)


def prose(rng, n, lang="en"):
    kinds = {"en": ["the", "of", "and", "that", "with", "from"], "de": ["der", "und", "nicht", "ein", "sich", "mit"]}
    syllables = {"en": ["tion", "ing", "the", "re", "ly", "ou"], "de": ["ung", "keit", "sch", "ver", "lich", "ein"]}
    word = lambda: rng.choice(kinds[lang]) if rng.random() < 0.3 else "".join(rng.choice(syllables[lang], rng.integers(2, 5)))
    return " ".join(word() for _ in range(n))


def test_a_text_like_no_other_is_kept(spark):
    rng = np.random.default_rng(1)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = " ".join([*a.split()[:-1], "changed"])
    rows = [(1, a, "en"), (2, a, "en"), (2, b, "en"), (3, near, "en"), (3, c, "en"), (4, c, "en"), (1, a, "en"), (None, a, "en"), (5, None, "en"), (5, None, "en"), (6, "", "en"), (7, "", "en")]
    df = frame(spark, rows).repartition(3)
    got = near_duplicates.without_duplicates(df)
    assert got.columns == df.columns
    kept = sorted((r.doc_id, r.text) for r in got.where("doc_id is not null and text is not null").collect())
    assert kept == sorted([(1, a), (2, b), (3, c), (6, "")])
    assert got.where("doc_id is null or text is null").count() == 3
    assert near_duplicates.without_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_id_have_their_own_verdict(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away"
    items = spark.createDataFrame([(1, item, "x")], "item_id long, text string, held string")
    df = frame(spark, [(1, f"before {item} after", "en"), (1, "another text", "en"), (2, item, "en"), (None, item, "en"), (3, None, "en")])
    assert sorted(map(repr, (r.doc_id for r in benchmarks.decontaminate(df, items).collect()))) == sorted(["1", "None", "3"])


def test_ids_of_several_texts_are_sources_too(spark):
    rng = np.random.default_rng(2)
    p, q = prose(rng, 40), prose(rng, 30)
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixes.dedupe_substrings(frame(spark, [(1, p, "en"), (1, q, "en"), (2, p, "en")])).collect()}
    assert got == {(1, len(p)): 0, (1, len(q)): 0, (2, len(p)): len(p)}


def united(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Repeated ids with different texts, texts of several lines, long and short lines that are alike, near copies, planted items,
    no language, nulls: every stage done by comparing all pairs."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    item = prose(rng, 14)
    shared_long, shared_short = prose(rng, 30), prose(rng, 6)
    rows = []
    for i in range(40):
        lang = "en" if i % 2 else "de"
        body = [prose(rng, int(rng.integers(25, 60)), lang) for _ in range(3)]
        if i % 5 == 0:
            body.insert(1, shared_long if i % 2 else shared_long + "x")
        if i % 7 == 0:
            body.append(shared_short.upper() if i % 2 else shared_short)
        if i % 11 == 0:
            body.append(f"{prose(rng, 5)} {item} {prose(rng, 5)}")
        rows.append((i, "\n".join(body), lang))
    words = [t.split(" ") for _, t, _ in rows]
    for j, i in enumerate((3, 8, 13)):  # near copies, of which one shares its id with a text of its own
        copy = list(words[i])
        copy[len(copy) // 2] = "changed"
        rows += [(100 + j, " ".join(copy), "en"), (100 + j, "\n".join(prose(rng, 50) for _ in range(2)), "en")]
    rows += [rows[1], (200, None, "en"), (201, "12 34 !!", "en"), (202, "\n\n", None), (None, prose(rng, 40), "en")]
    path = str(tmp_path)
    frame(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    has_letters = [r for r in rows if r[1] and any(ch.isalpha() for ch in r[1])]
    # lines: one of each component stays, the one with the least id, then hash, then number
    import xxhash

    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63)
    documents = sorted({(i, signed(t), t) for i, t, _ in has_letters if i is not None}, key=lambda r: r[:2])
    every = [(i, h, k, lines.normal(s)) for i, h, t in documents for k, s in enumerate(t.split("\n")) if lines.normal(s)]
    root = united(len(every), lambda a, b: every[a][3] == every[b][3] or lines.alike(every[a][3], every[b][3]))
    gone = {every[a][:3] for a in range(len(every)) if root[a] != a}
    assert len(gone) > 8
    cut = lambda i, t: t if i is None else "\n".join(s for k, s in enumerate(t.split("\n")) if (i, signed(t), k) not in gone)
    left = [(i, cut(i, t)) for i, t, _ in has_letters]
    # near copies, by text
    digest = lambda t: __import__("hashlib").sha256(t.encode()).digest()
    texts = sorted({t for i, t in left if i is not None}, key=lambda t: (min(i for i, x in left if x == t and i is not None), digest(t)))
    sets = [near_duplicates.shingle_counts(t) for t in texts]
    root = united(len(texts), lambda a, b: bool(sets[a]) and bool(sets[b]) and (k := (sets[a] & sets[b]).total()) >= 0.8 * (sets[a].total() + sets[b].total() - k))
    stay = {texts[a]: min(i for i, x in left if x == texts[a] and i is not None) for a in range(len(texts)) if root[a] == a}
    kept = sorted({(i, t) for i, t in left if i is not None and stay.get(t) == i}) + [(i, t) for i, t in left if i is None]
    assert len(kept) < len(set(left)) and any(i == 100 for i, _ in kept)
    # benchmark items
    import re

    bag = lambda t: {tuple(w[j : j + 5]) for w in [re.findall(r"[^\W_]+", t.lower())] for j in range(max(1, len(w) - 4))}
    clean = [(i, t) for i, t in kept if i is None or len(bag(t) & bag(item)) < 0.8 * len(bag(item))]
    assert len(clean) < len(kept)
    tokens = Tokenizer.from_file(default_path())
    want = sorted(((i, tuple(tokens.encode(t, add_special_tokens=False).ids) + (0,)) for i, t in clean), key=repr)

    got = {}
    pieces = corpus_pipeline.run(spark, path).collect()
    for p in sorted(pieces, key=lambda p: p.start):
        got.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length, p.ids_crc32))
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    found = []
    for (i, n), parts in got.items():
        fits = [ids for d, ids in want if d == i and len(ids) == n and all(crc(ids[a : a + m]) == c for a, m, c in parts)]
        assert fits, (i, n)
        found += [(i, ids) for ids in fits]
        assert sum(m for _, m, _ in parts) == n * len(fits)
    assert sorted(found, key=repr) == want
    json.dumps(len(want))


def labelled(n_labels, per_label, seed):
    """Languages whose words are made of three syllables of their own."""
    rng = np.random.default_rng(seed)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows, i = [], 0
    for g in range(n_labels):
        syllables = ["".join(rng.choice(letters, 3)) for _ in range(5)]
        for _ in range(per_label):
            rows.append((i, " ".join("".join(rng.choice(syllables, 2)) for _ in range(40)), f"l{g:03d}"))
            i += 1
    return rows


def test_two_hundred_labels(spark):
    df = frame(spark, labelled(200, 12, 7)).repartition(4)
    model = language.train(df)
    assert len(model.langs) == 200 and len(model.bits) == 200 * language.LANDMARKS_PER_LANG
    found = language.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).alias("ok"), (F.col("lang") >= "l128").alias("late")).collect()
    for late in (False, True):
        part = [r.ok for r in found if r.late == late]
        assert sum(part) > 0.95 * len(part) > 100


def test_scores_equal_kernel_ridge(spark):
    """All training rows as landmarks: weighted ridge regression in the span of their kernel."""
    rows = labelled(3, 20, 9)
    texts, langs = [t for _, t, _ in rows], [g for _, _, g in rows]
    model = language.Model(language.packed(texts), langs)
    x = language.presence(texts).astype(np.float64)
    assert np.allclose(language.unpacked(language.packed(texts)), x)
    values, vectors = np.linalg.eigh(x @ x.T)
    good = values > 1e-6 * values.max()
    phi = np.c_[vectors[:, good] * np.sqrt(values[good]), np.ones(len(x))]
    y = np.where(np.array(langs)[:, None] == np.array(model.langs), 1.0, -1.0)
    w = 1 / 20
    weights = np.linalg.solve(w * phi.T @ phi + language.RIDGE / 3 * np.eye(phi.shape[1]), w * phi.T @ y)
    assert np.abs(model.scores(texts) - phi @ weights).max() < 1e-3
    one = language.Model(language.packed(texts[:2]), ["a", "a"])
    assert one.scores(texts[:1]).shape == (1, 1)


def test_repeated_ids_train_alike(spark):
    rows = labelled(2, 30, 3) + [(2, "quite another text", "l001"), (2, "and one more", "l000")]
    a, b = (language.train(frame(spark, rows[::s]).repartition(n)) for s, n in ((1, 2), (-1, 5)))
    assert a.langs == b.langs and a.bits == b.bits and np.allclose(a.weights, b.weights)
