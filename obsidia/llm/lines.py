"""Fuzzy deduplication of lines: MinHash over character shingles, banding, exact Jaccard, distributed union-find."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm.common import banded_components, drop, store, table, text_slices, with_both

THRESHOLD = 0.8
#: Characters of a shingle, for lines of any length and for lines that are both under SHORT characters. A character
#: changed inside a line costs as many shingles: lines of 79, or 39, characters can bear one. Long lines of one language
#: share most shingles of four characters whatever they say.
CHARS, CHARS_SHORT, SHORT = 8, 4, 100
#: shingle size -> bands and minima of a band. Pairs at the threshold share one of 8 bands of 4 minima with probability
#: 0.985, one of 12 bands of 5 with 0.991; short shingles need longer bands, as unlike lines share more of them.
BANDS = {CHARS: (8, 4), CHARS_SHORT: (12, 5)}
#: Minima are taken of so many characters at a time, which stay in a core's cache.
CACHED = 48 << 10
#: White space, by Python's definition, other than the space and \n; there is none beyond U+3000.
WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
LINES = "doc_id long, doc_hash long, line_no int, digest binary"


def normal(line: str) -> str:
    """Lines are compared in lower case, with single spaces."""
    return " ".join(line.lower().split())


def normal_lines(text: str) -> list[str]:
    """`normal` of each line of a text. One that already has single spaces inside its lines is only cut."""
    text = text.lower()
    lines = text.split("\n")
    if any(c in text for c in WHITE):
        return [" ".join(s.split()) for s in lines]
    if "  " in text:
        return [" ".join(s.split()) if "  " in s else s.strip(" ") for s in lines]
    return [s.strip(" ") for s in lines]


def shingle_set(line: str, chars: int = CHARS) -> set[str]:
    """Of a normal line; a shorter one is one shingle."""
    return {line[i : i + chars] for i in range(max(1, len(line) - chars + 1))}


def _numbers(line: str, chars: int) -> np.ndarray | None:
    """The shingle set of a normal line of one-byte characters as ordered numbers, a shingle's bytes each; else None."""
    if len(line) < chars:
        return None
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    found = np.ndarray(len(raw) - chars + 1, dtype=f"<u{chars}", buffer=raw, strides=(1,)).copy()
    found.sort()
    fresh = np.ones(len(found), dtype=bool)
    np.not_equal(found[1:], found[:-1], out=fresh[1:])
    return found[fresh]


def alike(x: str, y: str, known: dict | None = None) -> bool:
    """The Jaccard similarity of the shingles of two normal lines is THRESHOLD or more, for CHARS or, where both lines are
    under SHORT, for CHARS_SHORT. known remembers the sets of x."""
    known = {} if known is None else known

    def of_x(make, chars):
        if (x, chars, make) not in known:
            known[x, chars, make] = make(x, chars)
        return known[x, chars, make]

    for chars in (CHARS, CHARS_SHORT) if len(x) < SHORT and len(y) < SHORT else (CHARS,):
        p = of_x(_numbers, chars)
        q = None if p is None else _numbers(y, chars)
        if q is None:
            p, q = of_x(shingle_set, chars), shingle_set(y, chars)
            both = len(p & q)
        else:
            all_of = np.concatenate((p, q))
            all_of.sort()
            both = int(np.count_nonzero(all_of[1:] == all_of[:-1]))
        if both >= THRESHOLD * (len(p) + len(q) - both):
            return True
    return False


def _windows(lines: list[str], chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The code points of the lines one after the other, each padded to a shingle; which starts of shingles lie inside a line;
    where the shingles of each line start among those, and how many it has."""
    padded = [s if len(s) >= chars else s.ljust(chars, "\0") for s in lines]
    size = np.array([len(s) for s in padded])
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    inside = np.ones(len(points), dtype=bool)
    inside[(np.cumsum(size)[:, None] - np.arange(1, chars)).ravel()] = False
    n = size - chars + 1
    return points, inside[: len(points) - chars + 1], np.cumsum(n) - n, n


def _minima(lines: list[str], chars: int, n: int, seed: int) -> np.ndarray:
    """(lines, n) uint32: n minima over the shingles of each normal line, none of which is empty."""
    h, inside, starts, _ = _windows(lines, chars)
    out = np.empty((n, len(lines)), dtype=np.uint32)
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    with np.errstate(over="ignore"):
        h = (h + np.uint32(0x7F4A7C15)) * np.uint32(0x9E3779B1)
        width = 1
        while width < chars:  # doubling: chars is a power of two
            h = (h[:-width] * np.uint32(0x85EBCA6B)) ^ h[width:]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            width *= 2
        h = h[inside]
        buffer = np.empty_like(h)
        for i in range(n):
            np.multiply(h, mult[i], out=buffer)
            np.add(buffer, add[i], out=buffer)
            np.minimum.reduceat(buffer, starts, out=out[i])
    return out.T


def _keys(lines: list[str], chars: int) -> np.ndarray:
    """(lines, bands) int64 bucket keys, even for CHARS and odd for CHARS_SHORT."""
    bands, rows = BANDS[chars]
    part = np.cumsum([len(s) for s in lines]) // CACHED
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(lines)]
    least = [_minima(lines[i:j], chars, bands * rows, chars) for i, j in zip(cuts, cuts[1:])]
    least = np.concatenate(least).reshape(len(lines), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(lines), bands))
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = (key ^ least[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            key = key ^ (key >> np.uint64(29))
    return (key & ~np.uint64(1) | np.uint64(chars == CHARS_SHORT)).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)))


def _lines(batches, with_keys):
    for part in text_slices(batches, limit=256 << 10):
        docs, hashes, nos, lines = [], [], [], []
        for doc, h, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "doc_hash", "text"))):
            for i, s in enumerate(normal_lines(text)):
                if s:
                    docs.append(doc)
                    hashes.append(h)
                    nos.append(i)
                    lines.append(s)
        digest = [hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest() for s in lines]
        cols, names = [pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.array(nos, pa.int32()), pa.array(digest, pa.binary())], ["doc_id", "doc_hash", "line_no", "digest"]
        if with_keys:
            known = dict(zip(digest, lines))  # equal lines are hashed once
            keys = dict(zip(known, _keys(list(known.values()), CHARS))) if known else {}
            short = {d: s for d, s in known.items() if len(s) < SHORT}
            if short:
                for d, k in zip(short, _keys(list(short.values()), CHARS_SHORT)):
                    keys[d] = np.concatenate([keys[d], k])
            cols, names = [*cols, _lists([keys[d] for d in digest])], [*names, "keys"]
        yield pa.record_batch(cols, names=names)


def _pick(batches):
    """The wanted lines of each document, by their numbers."""
    for part in text_slices(batches):
        ids, texts = [], []
        for text, want in zip(part.column("text").to_pylist(), part.column("want").to_pylist()):
            lines = text.split("\n")
            for w in want:
                ids.append(w["id"])
                texts.append(normal(lines[w["line_no"]]))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "line"])


def _verify(batches):
    for batch in batches:
        known: dict = {}
        a, b, same = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
        for x, y in zip(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist()):
            if len(known) > 64:
                known.clear()
            same.append(alike(x, y, known))
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(same)], names=["a", "b", "same"])


def _hashes(lines: list[str], chars: int) -> list[np.ndarray]:
    """The different shingles of each normal line, none of which is empty, as numbers of 64 bits."""
    points, inside, starts, n = _windows(lines, chars)
    h, width = points.astype(np.uint64), 1
    with np.errstate(over="ignore"):
        while width < chars:  # doubling: chars is a power of two
            h = h * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h[:-width] ^ (h[:-width] >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) + h[width:]
            width *= 2
        h = h[inside]
        h[starts] += np.array([chars - len(s) if len(s) < chars else 0 for s in lines], dtype=np.uint64)  # padded ones are others
    own = np.repeat(np.arange(len(lines)), n)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1]))
    return np.split(h[fresh].view(np.int64), np.searchsorted(own[fresh], np.arange(1, len(lines))))


def _shingles(batches):
    """The shingles of each line: of CHARS, and of CHARS_SHORT for a line under SHORT."""
    for part in text_slices(batches, "line", limit=1 << 20):
        lines = part.column("line").to_pylist()
        short = [s for s in lines if len(s) < SHORT]
        more = iter(_hashes(short, CHARS_SHORT) if short else [])
        none = np.empty(0, dtype=np.int64)
        both = [v for s, x in zip(lines, _hashes(lines, CHARS)) for v in (x, next(more) if len(s) < SHORT else none)]
        kinds = pa.ListArray.from_arrays(pa.array(np.arange(0, len(both) + 1, 2), pa.int32()), _lists(both))
        yield pa.record_batch([part.column("id"), kinds], names=["id", "cells"])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, doc_hash (xxhash64 of the text), removed: numbers of the lines (between \\n, from 0) which a like line precedes.

    Lines are alike if they are equal in normal form or as `alike` says; of each connected component the line with the
    least (doc_id, doc_hash, number) stays. Blank lines are never removed. Equal lines are folded before banding. Null ids
    and texts have no lines here. Equal rows are one document; rows with one doc_id and different texts are documents
    each.
    """
    scratch: list = []
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("doc_hash"), "text")
    lines = lambda with_keys: keyed.mapInArrow(lambda it: _lines(it, with_keys), LINES + ", keys array<long>" * with_keys)
    place = F.struct("doc_id", "doc_hash", "line_no")
    reps = lines(True).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.any_value("keys").alias("keys"))
    reps = store(reps.withColumn("id", F.monotonically_increasing_id()), scratch)

    def prepare(ids, used):
        where = reps.select("id", "first").join(ids, "id", "left_semi")
        where = store(where.groupBy("first.doc_id", "first.doc_hash").agg(F.collect_list(F.struct("first.line_no", "id")).alias("want")), used)
        found = keyed.join(where.hint("shuffle_hash"), ["doc_id", "doc_hash"]).select("text", "want").mapInArrow(_pick, "id long, line string")
        texts = store(found.dropDuplicates(["id"]), used)

        def verify(pairs):
            return with_both(pairs, texts, "line").mapInArrow(_verify, "a long, b long, same boolean").where("same").select("a", "b")

        def cells(ids):
            return texts.join(ids, "id", "left_semi").mapInArrow(_shingles, "id long, cells array<array<long>>")

        return verify, cells

    comp = banded_components(reps.select("id", F.explode("keys").alias("key")), prepare, THRESHOLD)
    named = store(reps.select("id", "digest", "first", "times").join(comp.withColumnRenamed("v", "id"), "id"), scratch)
    stays = store(named.groupBy("component").agg(F.min("first").alias("stay")), scratch)
    moved = named.join(stays, "component").where("times > 1 or stay <> first").select("digest", "stay")
    alone = reps.where("times > 1").select("digest", F.col("first").alias("stay")).join(named.select("digest"), "digest", "left_anti")
    # a line that stands alone stays; only the others are looked up again
    again = store(moved.unionByName(alone), scratch)
    out = lines(False).join(again.hint("shuffle_hash"), "digest").where(place != F.col("stay"))
    removed = store(out.groupBy("doc_id", "doc_hash").agg(F.sort_array(F.collect_set("line_no")).alias("removed")))
    drop(scratch)
    return removed


def _cut_lines(docs: DataFrame) -> DataFrame:
    """docs (all columns in `row`) with removed (numbers of lines, or null) and text, what is left of it: only texts that lose
    lines are cut into lines."""
    removed = repeated_lines(docs)
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = (F.col("row.doc_id") == F.col("doc_id")) & (F.xxhash64("row.text") == F.col("doc_hash"))
    joined = left.join(removed.hint("shuffle_hash"), same, "left")  # texts need no sorting
    some = F.col("removed").isNotNull()
    joined = joined.select("row", "removed", F.when(some, F.split("row.text", "\n", -1)).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")  # in order
    text = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return joined.select("row", "removed", F.when(some, text).otherwise(F.col("row.text")).alias("text"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs, all columns, each text without its repeated lines; n_chars, if there, follows. Null texts stay null, and a
    document whose every line goes keeps an empty text."""
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return _cut_lines(docs).select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers, comma-joined), kept_sha256 of the text that is left, per row."""
    rows = _cut_lines(docs.select("doc_id", "text"))
    whole = F.col("row.text")
    n_lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    return rows.select(F.col("row.doc_id").alias("doc_id"), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_line_dedup(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents"))
