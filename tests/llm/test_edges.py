"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from obsidia.llm import benchmarks, common, language, lines, near_duplicates, packing, private, quality, subwords, suffixes, token_counts, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id long, key long, digest string, tokens string, n long, row string, bands string"
BASE = " ".join(f"word{i} stands here" for i in range(60))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, g, s, None if t is None else len(t), 1, 2, "x", "y", 3, "z", None) for d, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [
        (1, BASE + "\nA line which stands in two places of the table.", "en", "a"),
        (2, BASE + " more\nA line which stands in two places of the  TABLE.", "en", None),
        (3, None, None, "a"), (4, "", "en", "a"), (4, "", "en", "a"), (5, "short", None, None), (6, "short", "de", "a"),
        (None, "no id: mail a.b@c.org or +1 (017) 555-7713", "en", "a"), (7, "x" * 300_000, "en", "a"),
        (8, "den er die das und mit " * 40, "de", "a"), (9, "\n\n \t\n", "en", "a"), (10, "1234 !!", "en", "a"),
    ])


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_token_counts(docs, none):
    got = {(r.doc_id, r.n_words) for r in token_counts.token_counts(docs).collect()}
    assert (3, 0) in got and (4, 0) in got and token_counts.token_counts(none).count() == 0
    assert token_counts.token_counts(docs).count() == docs.count()


def test_automaton_equals_longest_match():
    pieces = ["a", "ab", "abc", "b", "c", "bc", "d</w>", "c</w>", "abcd</w>", "b</w>", "a</w>"]
    automaton, known = token_counts.Automaton(pieces), set(pieces)
    rng = np.random.default_rng(3)
    for _ in range(500):
        word = "".join(rng.choice(list("abcd"), rng.integers(1, 9)))
        symbols, at, n = token_counts.ended(word), 0, 0
        while at < len(symbols) and n >= 0:
            end = next((j for j in range(len(symbols), at, -1) if "".join(symbols[at:j]) in known), None)
            at, n = (end, n + 1) if end else (len(symbols), -1)
        assert automaton.count(symbols) == (n if n >= 0 else 1)


def test_quality(docs, none):
    rows = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert rows[3].base_failed and not rows[3].kept and not rows[4].kept
    assert rows[8].n_repeat_words > 200 and quality.quality(none).count() == 0


def test_quality_equals_brute_force(spark):
    """Base columns by the contract's words; limits by sorted values; equal results from other partitions."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(240):
        lang, source = ("en", "de", None)[i % 3], f"s{i % 2}"
        words = ["".join(rng.choice(list("abcdeß"), rng.integers(2, 8))) for _ in range(rng.integers(15, 80))]
        if i % 17 == 0:
            words += words[:12]
        if i % 40 == 7:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t ", " \n\n"]) for w in words) + "#" * (i % 4), lang, source))
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows)).collect()}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        places = {}
        for at in range(len(words) - 7):
            places.setdefault(tuple(words[at : at + 8]), []).append(at)
        repeated = {at + k for found in places.values() if len(found) > 1 for at in found for k in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(repeated))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
    ok = [r for r in got.values() if not r.base_failed]
    quartile = lambda some, f, q: sorted(r[f] for r in some)[max(0, -(-len(some) * q // 4) - 1)]
    for r in ok:
        group = [x for x in ok if (x.lang, x.source) == (r.lang, r.source)]
        group = group if len(group) >= quality.MIN_GROUP else [x for x in ok if x.lang == r.lang]
        beyond = []
        for f, floor in quality.FEATURES.items():
            lo, hi, wide = quartile(group, f, 1), quartile(group, f, 3), quartile(ok, f, 3) - quartile(ok, f, 1)
            room = max(4 * (hi - lo), 4 * wide, floor)
            beyond.append((r[f] - hi) / room)
            beyond.append((lo - r[f]) / room if f in quality.BOTH_SIDES else 0)
        assert abs(max(beyond) - 1) < 0.1 or r.kept == (max(beyond) <= 1)
    assert {r.reason for r in got.values()} >= {None, "base", "upper_rate"}
    again = quality.quality(frame(spark, rows[::-1]).repartition(7)).collect()
    assert {r.doc_id: (r.kept, r.reason) for r in again} == {i: (r.kept, r.reason) for i, r in got.items()}


def test_suffixes(docs, none):
    rows = {r.doc_id: r for r in suffixes.dedupe_substrings(docs).collect()}
    assert rows[3].n_bytes == 0 and rows[7].n_removed == 299_999 and rows[1].n_removed == 0
    assert rows[2].n_removed >= len(BASE) and suffixes.dedupe_substrings(none).count() == 0


@pytest.mark.parametrize("large", [suffixes.LARGE, 1])
def test_substrings_equal_brute_force(spark, monkeypatch, large):
    """Texts dealt from phrases, equal rows, one id with two texts, segment borders and either path for large buckets."""
    monkeypatch.setattr(suffixes, "LARGE", large)
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    rng = np.random.default_rng(9)
    phrases = ["".join(rng.choice(list("abcdefgh äé"), n)) for n in rng.integers(50, 160, 8)]
    rows = [(i, "".join(phrases[k] + ("" if rng.random() < 0.5 else "#") for k in rng.integers(0, 8, rng.integers(0, 12))), "en", "a") for i in range(50)]
    rows += [rows[3], rows[4], (60, rows[5][1], "en", "a"), (60, "x" + rows[6][1], "en", "a")]
    span, seen, want = suffixes.SPAN, set(), {}
    # texts of one id are ordered by Spark's 64-bit hash
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63)
    for i, text in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0], signed(r[1]))):
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for at in range(len(raw) - span + 1):
            if raw[at : at + span] in seen:
                gone[at : at + span] = True
            seen.add(raw[at : at + span])
        left = bytes(b for b, g in zip(raw, gone) if not g)
        want[i, text] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest())
    got = suffixes.dedupe_substrings(frame(spark, rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((r[0], *want[r[0], r[1]]) for r in rows)


def test_suffix_array_sorts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 300):
        raw = bytes(rng.integers(97, 100, n, dtype=np.uint8)) * 2
        text, padded = np.frombuffer(raw, np.uint8), np.frombuffer(raw + bytes(16), np.uint8)
        words = np.zeros(len(raw) + 1, np.uint64)
        for i in range(8):
            words = (words << np.uint64(8)) | padded[i : i + len(words)]
        order = [raw[i : i + suffixes.SPAN] for i in suffixes.suffix_array(text, words)]
        assert order == sorted(order) and len(order) == len(raw)


def test_packing(docs, none):
    pieces = packing.pack(docs, width=64).collect()
    filled = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= 64 and sum(p.length for p in pieces if p.doc_id == 3) == 1
    assert packing.pack(none).count() == 0


def test_lines(docs, none):
    rows = {r.doc_id: r for r in lines.line_report(docs).collect()}
    assert rows[1].n_removed == 0 and rows[2].removed == "0,1" and rows[9].n_removed == 0 and rows[3].n_lines == 0
    kept = lines.without_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() and lines.without_duplicates(none).count() == 0


def test_short_lines_equal_brute_force(spark):
    """Lines of 30 to 75 characters, each with a changed character inside, against all pairs and their components."""
    rng = np.random.default_rng(8)
    draw = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    every = []
    for n in range(30, 76):
        s = "x" + draw(n - 2) + "y"
        at = n // 2
        every += [s, s[:at] + "7" + s[at + 1 :], s[:at] + "Q" + s[at + 1 :]]
    gram = lambda s: {s[i : i + 4] for i in range(max(1, len(s) - 3))}
    sets = [gram(" ".join(s.lower().split())) for s in every]
    root = list(range(len(every)))
    for i in range(len(every)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    want = {i for i, r in enumerate(root) if r != i}
    got = lines.line_report(frame(spark, [(i, s, "en", "a") for i, s in enumerate(every)])).collect()
    assert {r.doc_id for r in got if r.n_removed} == want and len(want) > 60


def test_numbers_of_lines_are_their_shingles():
    """Lines as numbers and as sets of strings give one verdict, within and beyond one-byte characters."""
    rng = np.random.default_rng(3)
    texts = ["", "a", "abc", "abcdefgh", "abcdefghi", "é" * 40, "中" * 40, "\x00bcdefgh", "\ud800 abcdefghi"]
    for n in (20, 60, 99, 100, 300):
        s = "".join(rng.choice(list("abcdéñ "), n))
        texts += [s, s[: n // 2] + "7" + s[n // 2 + 1 :], s + "x", "中" + s, s * 2, s[: n * 9 // 10]]
    for x in texts:
        for y in texts:
            sizes = (8, 4) if max(len(x), len(y)) < 100 else (8,)
            sets = [tuple({t[i : i + c] for i in range(max(1, len(t) - c + 1))} for t in (x, y)) for c in sizes]
            assert lines.alike(x, y) == any(len(p & q) >= 0.8 * len(p | q) for p, q in sets), (x, y)


def test_normal_lines():
    texts = ["", "\n", " A  b \n\nc\td\r\n", "ΑΣ\nΣ a", "x y 　 z\nq", "a b\n c  d", "A\x1cB\x85\nİ ß"]
    for text in texts:
        assert lines.normal_lines(text) == [" ".join(s.lower().split()) for s in text.split("\n")]


def test_private(docs, none):
    rows = {r.doc_id: r for r in private.sanitise(docs).collect()}
    assert rows[None].n_email == 1 and rows[None].n_phone == 1 and "[EMAIL]" in rows[None].clean_text
    assert rows[3].spans == "" and private.sanitise(none).count() == 0


def test_private_spans_equal_patterns():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    fits = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 14 <= len(digits(s)) <= 19 and private.luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15}
    rng = np.random.default_rng(2)
    for _ in range(400):
        text = "".join(rng.choice(list("a@.b- +1234567890()"), 80))
        want = sorted(((m.start(), m.end(), k) for k, p in kinds.items() for m in re.finditer(p, text) if fits[k](m[0])), key=lambda s: (s[0], private.KINDS.index(s[2])))
        assert private.base_spans(text) == want


def test_disclosing_term(spark):
    rows = [(i, f"plain{i} text{i} Zorblax a.b@c.org follows{i} here{i}" if i < 6 else f"other{i} things{i}", "en", "a") for i in range(60)]
    got = {r.doc_id: r for r in private.sanitise(frame(spark, rows)).collect()}
    assert got[0].n_term == 1 and "Zorblax" not in got[0].clean_text and got[30].n_term == 0


def test_terms_of_signatures_copies_and_two_documents(spark):
    """One passage around an address in different documents; copies of a text; an entity of two documents."""
    rows = [(i, f"start{i} of{i} the rows\n" + ("a b c d e f Zorblax x@y.org a b c d e f g h" if i < 6 else "") + f" end{i}", "en", "a") for i in range(300)]
    rows += [(1000 + i, "Quenneth q@r.org in copies of one text", "en", "a") for i in range(200)]
    rows += [(2000 + i, f"other{i} Quenneth{'' if i < 3 else 's'} q@r.org", "en", "a") for i in range(4)]
    rows += [(3000 + i, f"two{i} Vexley v@w.org", "en", "a") for i in range(2)]
    got = {r.doc_id: r for r in private.sanitise(frame(spark, rows)).collect()}
    assert all(got[i].clean_text.count("Zorblax") == 0 and got[i].n_term > 0 for i in range(6))
    assert all("Quenneth " not in got[i].clean_text for i in (1000, 1199, 2000, 2001, 2002))
    assert "Vexley" not in got[3000].clean_text and "Vexley" not in got[3001].clean_text
    assert got[3000].n_term == 1 and got[299].n_term == 0


def test_terms_far_from_entities(spark):
    """A name in the salutation, the address in the footer, and many entities and words of the same documents."""
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(400))
    rows = [(i, f"Dear Zorblax\n{body(i)}\nat x@y.org" if i < 4 else f"Dear all\n{body(i)}", "en", "a") for i in range(100)]
    many = " ".join(f"n{k}@list.org name{k}" for k in range(50))
    rows += [(1000 + i, f"{many} {body(1000 + i)}", "en", "a") for i in range(4)]
    got = {r.doc_id: r for r in private.sanitise(frame(spark, rows)).collect()}
    assert all(got[i].n_term == 1 and "Zorblax" not in got[i].clean_text for i in range(4))
    assert all(got[1000 + i].n_term == 50 for i in range(4)) and got[50].n_term == 0
    terms = {(r.entity, r.term) for r in private.disclosing_terms(frame(spark, rows)).collect()}
    assert terms == {("email:x@y.org", "Zorblax")} | {(f"email:n{a}@list.org", f"name{b}") for a in range(50) for b in range(50)}


@pytest.mark.parametrize("cache, idle", [(subwords.CACHE, subwords.IDLE), (300, 40)])
def test_encoder_equals_tokenizer(monkeypatch, cache, idle):
    """Whatever a worker remembers of pieces, ids are those of the library for the whole text."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(subwords, "CACHE", cache)
    monkeypatch.setattr(subwords, "IDLE", idle)
    path = subwords.default_path()
    ours, whole = subwords.Encoder(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    parts = [*"ab.,;!?'# \n\t\r", "  ", "word", "Straße", "naïve", "don't", "12", "日本", "é", "\u00a0", "\u2009", "\x85", "<|endoftext|>", "x" * 30]
    texts = ["", " ", "\n", *(" ".join(f"w{i}x{j}" for j in range(90)) for i in range(20)), *("".join(rng.choice(parts, rng.integers(1, 60))) for _ in range(400))]
    for at in range(0, len(texts), 50):
        for text, ids in zip(texts[at : at + 50], ours.encode(texts[at : at + 50])):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text
        ours.rest()
        assert len(ours.known) <= max(idle, 1)


def tokens_by_library(texts, end_id):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(subwords.default_path())
    return [whole.encode(t or "", add_special_tokens=False).ids + [end_id] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def special_rows():
    rng = np.random.default_rng(12)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", *(" ".join(f"word{k}" for k in rng.integers(0, 500, n)) for n in rng.integers(1, 900, 60)), "x" * 50_000, None, ""]
    return [(i, t, "en", "a") for i, t in enumerate(texts)]


def test_token_files(spark, docs, none, monkeypatch):
    rows = token_files.token_files(docs).collect()
    assert len(rows) == docs.count() and sorted(r.start for r in rows)[0] == 0 and token_files.token_files(none).count() == 0
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 5000)
    given = special_rows()
    start, want = 0, []
    for (i, *_), ids in zip(given, tokens_by_library([r[1] for r in given], 2)):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, token_files.token_files(frame(spark, given).repartition(5)).collect())) == want
    payload = token_files.pack_block(b"", [np.array([1, 2], dtype="<u2")], __import__("zstandard").ZstdCompressor())
    with pytest.raises(ValueError):
        token_files.BlockReader(b"another dictionary", payload)


def test_packing_equals_library(spark):
    """Ids, crc, pieces of a document and windows, from several partitions."""
    given = special_rows()
    want = dict(zip([r[0] for r in given], tokens_by_library([r[1] for r in given], 0)))
    pieces = packing.pack(frame(spark, given).repartition(3), width=128).collect()
    at, filled = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at.get(p.doc_id, 0) and p.doc_tokens == len(want[p.doc_id])
        at[p.doc_id] = p.start + p.length
        assert p.ids_crc32 == crc(want[p.doc_id][p.start : at[p.doc_id]])
    assert at == {i: len(ids) for i, ids in want.items()}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= 128 and sum(n < 128 * (1 - packing.SLACK) for n in filled.values()) <= 3


def test_squares_rule():
    """The level chosen is the one after which the sum of squares is least, the fullest of equals."""
    rng = np.random.default_rng(2)
    packer = packing.SquaresPacker(32, 0)
    for size in rng.integers(1, 32, 400).tolist():
        before = packer.count.copy()

        def after(level):
            c = before.copy()
            c[level] -= level > 0
            if level + size < 32:
                c[level + size] += 1
            return int((c[1:32] ** 2).sum())

        options = [h for h in range(32) if h + size <= 32 and (h == 0 or before[h])]
        _, offset = packer.place(size)
        assert offset == max(h for h in options if after(h) == min(map(after, options)))


def test_language(docs, none):
    model = language.train(docs)
    rows = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == rows[10].lang_pred == "und" and rows[8].lang_pred in ("de", "en")
    assert language.identify(none, language.train(none)).count() == 0
    assert language.keep_identified(docs, model, 0.0).columns == docs.columns
    far = frame(docs.sparkSession, [(90, "\U00030000", "en", "a"), (91, "12 \u2014", "en", "a")])
    assert {r.doc_id: r.lang_pred == "und" for r in language.identify(far, model).collect()} == {90: False, 91: True}


def test_language_held_out_accuracy(spark):
    """Held-out documents of four languages of the given tables, by rows that training doesn't see."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_near_duplicates(docs, none):
    rows = {r.doc_id: r for r in near_duplicates.classes(docs).collect()}
    assert rows[2].class_id == 1 and not rows[2].kept and rows[6].class_id == 5 and rows[3].class_id == 3 and rows[None].kept
    assert near_duplicates.classes(none).count() == 0


@pytest.mark.parametrize("few", [0, 5, common.FEW_LINKS])
def test_components_of_chains(spark, monkeypatch, few):
    """By rounds alone, by rounds and a last task, and by that task alone."""
    monkeypatch.setattr(common, "FEW_LINKS", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(None, 3), (70, 70), (81, 80)], "a long, b long")
    got = {r.v: r.component for r in common.connected_components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[81] == 80 and 70 not in got


def test_large_buckets_lose_no_link(spark):
    """Copies with one to five changed words: many are not alike, and the buckets are larger than FEW."""
    rng = np.random.default_rng(4)
    words, rows = BASE.split()[:120], []
    for i in range(60):
        w = list(words)
        for at in rng.choice(len(w), 1 + i % 5, replace=False):
            w[at] = f"new{i}at{at}"
        rows.append((i, " ".join(w), "en", "a"))
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(frame(spark, rows)).collect()}
    sets = {i: near_duplicates.shingle_counts(t) for i, t, *_ in rows}
    label = {i: i for i in sets}
    for _ in range(60):
        for a in sets:
            for b in sets:
                both = (sets[a] & sets[b]).total()
                if both >= 0.8 * (sets[a].total() + sets[b].total() - both):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_benchmarks(spark, docs, none):
    item = "the quick brown fox jumps over the lazy dog and runs away into the deep dark forest at night"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item)], "item_id long, text string")
    hit = frame(spark, [(50, BASE + " " + item.upper() + ", " + BASE, "en", "a"), (None, item, "en", "a")]).unionByName(docs)
    assert [(r.doc_id, r.item_id) for r in benchmarks.contamination(hit, items).collect()] == [(50, 1)]
    assert benchmarks.decontaminate(hit, items).count() == hit.count() - 1
    words = item.split()
    parts = frame(spark, [(70, " ".join(words[:10]), "en", "a"), (70, " ".join(words[6:]), "en", "a"), (71, " ".join(words[:10]), "en", "a")])
    two = spark.createDataFrame([(5, " ".join(words[:12]), "x"), (5, " ".join(words[8:]), "y"), (6, BASE, "z")], "item_id long, text string, s string")
    assert [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in benchmarks.contamination(parts, two).collect()] == [(70, 5, 15, 15)]
    assert benchmarks.contamination(none, items).count() == 0 and benchmarks.contamination(hit, items.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        if name != "pack":
            assert out.columns == docs.columns and out.count() > 0
