"""Exact substring deduplication with suffix arrays over buckets that equal strings are sure to share.

Every SPAN-byte string has a least K-byte gram by a hash, its anchor; strings in a row with the same anchor make a
run. Equal strings have equal anchors, so a run is compared only within the bucket of its anchor: buckets with one run
are dropped, runs with equal bytes are folded to the first, and what differs within a bucket goes, whole, into a suffix
array, where strings of SPAN bytes that repeat stand next to each other.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm.common import hinted, store, table
from obsidia.operators.numbering import numbered

SPAN, K = 100, 32
GRAMS = SPAN - K + 1
#: Bytes handled at once; longer texts are cut into overlapping segments, which loses no string.
SEGMENT, BLOCK = 1 << 20, 512 << 10
#: A bucket with more different runs than fill a block is not gathered: its strings are grouped one by one by their digests.
LARGE = BLOCK // (SPAN + GRAMS // 2)


def _hash(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


_tables = None


def _constants():
    """A random number for each byte, and powers of an odd number and of its inverse modulo 2**64."""
    global _tables
    if _tables is None:
        rng = np.random.default_rng(11)
        byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0x9E3779B97F4A7C15
        power = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SEGMENT + 4 * SPAN, b, dtype=np.uint64)])) for b in (base, pow(base, -1, 1 << 64))]
        _tables = byte, *power
    return _tables


def segments(batches):
    """(doc ids, start of each within its document, bytes) of about SEGMENT bytes. A string lies in exactly one segment."""
    docs, froms, parts, size = [], [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for at in range(0, max(0, len(raw) - SPAN + 1), SEGMENT):
                piece = raw[at : at + SEGMENT + SPAN - 1]
                if size and size + len(piece) > SEGMENT + SPAN - 1:
                    yield docs, froms, parts
                    docs, froms, parts, size = [], [], [], 0
                docs.append(doc)
                froms.append(at)
                parts.append(piece)
                size += len(piece)
    if docs:
        yield docs, froms, parts


def _runs(batches):
    """key (the anchor's hash), ctx (a hash of the run's bytes), doc_id, at: start * 256 + number of strings."""
    byte, power, inverse = _constants()
    for docs, froms, parts in segments(batches):
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
        n = np.array([len(p) for p in parts])
        first = np.cumsum(n) - n
        with np.errstate(over="ignore"):
            h = byte[raw]
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)])
            for width in (1, 2, 4, 8, 16):
                h = _hash(h[:-width] * np.uint64(0x94D049BB133111EB) + h[width:])
            low = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal grams
            width = 1
            while 2 * width <= GRAMS:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            low = np.minimum(low[: len(low) - (GRAMS - width)], low[GRAMS - width :])
            strings = n - SPAN + 1
            starts = np.repeat(first - (np.cumsum(strings) - strings), strings) + np.arange(int(strings.sum()))
            anchor = (low[starts] & np.uint64((1 << 21) - 1)).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)]))
            count = np.diff(np.append(new, len(anchor)))
            begin = starts[new]
            ctx = _hash((prefix[begin + count + SPAN - 1] - prefix[begin]) * inverse[begin])
        own = np.searchsorted(first, begin, side="right") - 1
        at = (begin - first[own] + np.array(froms)[own]) * 256 + count
        cols = [h[anchor[new]].view(np.int64), ctx.view(np.int64), np.array(docs, dtype=np.int64)[own], at]
        for i in range(0, len(at), 1 << 16):
            yield pa.record_batch([pa.array(c[i : i + (1 << 16)]) for c in cols], names=["key", "ctx", "doc_id", "at"])


def suffix_array(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Suffixes of text in order of their first SPAN bytes, by two-stage sorting.

    Only suffixes smaller than their successors are sorted directly, word by word while they tie. The rest is induced: in
    a scan over the buckets of first bytes in order, the predecessor of each suffix is put at the next free place of its
    own bucket, before the sorted ones. words[i] holds the 8 bytes from i on as a big-endian number.
    """
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=-1))
    place = np.where(step != 0, np.arange(n), n)
    smaller = step[np.minimum.accumulate(place[::-1])[::-1]] > 0
    direct = np.flatnonzero(smaller)
    order = direct[np.argsort(words[direct], kind="stable")]
    tied, depth = np.ones(len(order), dtype=bool), 8
    rank = np.concatenate([[0], np.cumsum(words[order[1:]] != words[order[:-1]])]) if len(order) else np.empty(0, dtype=np.int64)
    while depth < SPAN:
        same = rank[1:] == rank[:-1]
        tied[:] = False
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        word = words[np.minimum(order[at] + depth, n)]
        resort = np.lexsort((word, rank[at]))
        order[at] = order[at][resort]
        word, r = word[resort], rank[at]
        change = np.zeros(len(order), dtype=np.int64)
        change[at[1:]] = (r[1:] == r[:-1]) & (word[1:] != word[:-1])
        rank = rank + np.cumsum(change)
        depth += 8
    ends = np.cumsum(np.bincount(text, minlength=257))
    head = ends - np.bincount(text, minlength=257)
    sorted_from = ends - np.bincount(text[direct], minlength=257)
    out = np.empty(n, dtype=np.int64)
    bucket = text[order]
    out[sorted_from[bucket] + np.arange(len(order)) - np.searchsorted(bucket, bucket)] = order

    def induce(suffixes, byte):
        """Places the predecessors that aren't sorted yet; returns those in the same bucket."""
        before = suffixes[suffixes > 0] - 1
        before = before[~smaller[before]]
        chars = text[before]
        by = np.argsort(chars, kind="stable")
        before, chars = before[by], chars[by]
        out[head[chars] + np.arange(len(chars)) - np.searchsorted(chars, chars)] = before
        kinds, counts = np.unique(chars, return_counts=True)
        head[kinds] += counts
        return before[chars == byte]

    out[head[text[n - 1]]] = n - 1  # the last suffix follows the empty one
    head[text[n - 1]] += 1
    done = ends - np.bincount(text, minlength=257)
    for byte in np.unique(text):
        while done[byte] < head[byte]:
            part = out[done[byte] : head[byte]]
            done[byte] = head[byte]
            induce(part, byte)
        induce(out[sorted_from[byte] : ends[byte]], byte)
    return out


def common_prefix(words: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """For each suffix but the first, whole words in common with the one before, up to SPAN bytes: SPAN if all are."""
    n, a, b = len(words) - 1, suffixes[:-1], suffixes[1:]
    out, live = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    for depth in (*range(0, SPAN - 8, 8), SPAN - 8):
        same = words[np.minimum(a[live] + depth, n)] == words[np.minimum(b[live] + depth, n)]
        live = live[same]
        out[live] = depth + 8
    return out


def later_repeats(docs, starts, counts, contexts) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, start) of the strings of some runs that an equal string with a lesser (doc_id, start) comes before."""
    raw = b"".join(contexts)
    text = np.frombuffer(raw, dtype=np.uint8)
    padded = np.frombuffer(raw + bytes(16), dtype=np.uint8)
    words = np.zeros(len(text) + 1, dtype=np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + len(words)]
    suffixes = suffix_array(text, words)
    run = np.concatenate([[0], np.cumsum(common_prefix(words, suffixes) < SPAN)])
    n = np.array([len(c) for c in contexts])
    first = np.cumsum(n) - n
    own = np.repeat(np.arange(len(n)), n)[suffixes]
    offset = suffixes - first[own]
    inside = offset < counts[own]
    run, doc, start = run[inside], docs[own][inside], (starts[own] + offset)[inside]
    order = np.lexsort((start, doc, run))
    run, doc, start = run[order], doc[order], start[order]
    new = np.diff(run, prepend=-1) != 0
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[head]) | (start != start[head])  # a repeated row holds the very same string
    return doc[later], start[later]


def _contexts(batches):
    for batch in batches:
        for doc, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs"))):
            raw = text.encode("utf-8", "surrogatepass")
            cols = [[], [], [], [], []]
            for r in runs:
                start, count = r["at"] >> 8, r["at"] & 255
                for c, v in zip(cols, (r["key"], doc, start, count, raw[start : start + count + SPAN - 1])):
                    c.append(v)
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["key", "doc_id", "start", "n", "bytes"])


def _intervals(doc, start):
    """Merges strings at following starts of a document to (doc_id, start, end)."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (np.diff(start) > 1)])) if len(doc) else np.empty(0, dtype=np.int64)
    last = np.append(new[1:], len(doc))[: len(new)] - 1
    return pa.record_batch([pa.array(doc[new]), pa.array(start[new]), pa.array(start[last] + SPAN)], names=["doc_id", "start", "end"])


def _bucketed(batches):
    """Buckets come in order of their keys; blocks of whole buckets, of BLOCK bytes or one bucket, get a suffix array each."""
    held, size, key = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "start", "n", "bytes"))):
            if row[0] != key and size > BLOCK:
                yield _intervals(*_repeats(held))
                held, size = [], 0
            key = row[0]
            held.append(row)
            size += len(row[4])
    if held:
        yield _intervals(*_repeats(held))


def _repeats(rows):
    _, doc, start, n, contexts = zip(*rows)
    return later_repeats(np.array(doc), np.array(start), np.array(n), contexts)


def _digests(batches):
    for batch in batches:
        out = [[], [], []]
        for doc, start, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n", "bytes"))):
            out[0] += [doc] * n
            out[1] += range(start, start + n)
            out[2] += [hashlib.blake2b(raw[i : i + SPAN], digest_size=16).digest() for i in range(n)]
        yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc_id", "start", "digest"])


def _merge(batches):
    """Intervals of each document, merged where they meet."""
    for batch in batches:
        merged = []
        for spans in batch.column("spans").to_pylist():
            out = []
            for s, e in sorted((x["start"], x["end"]) for x in spans):
                if out and s <= out[-1][1]:
                    out[-1][1] = max(e, out[-1][1])
                else:
                    out.append([s, e])
            merged.append([v for pair in out for v in pair])
        yield pa.record_batch([batch.column("doc_id"), pa.array(merged, pa.list_(pa.int64()))], names=["doc_id", "cuts"])


def several_texts(keyed: DataFrame) -> bool:
    """Some doc_id has rows with different texts."""
    texts = keyed.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    return not texts.where("lo <> hi").isEmpty()


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """doc_id, cuts: starts and ends, in turn, of the byte runs of a document that strings of SPAN bytes cover which also
    start earlier, in a smaller doc_id or the same document. keyed: doc_id and text, not null, a text for each doc_id."""
    runs = keyed.mapInArrow(_runs, "key long, ctx long, doc_id long, at long")
    shared = store(runs.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    runs = store(runs.join(shared, "key"))  # both grow with the corpus: never a broadcast by hint
    firsts = store(runs.groupBy("key", "ctx").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("c")))
    again = runs.join(firsts.where("c > 1").select("key", "ctx", "first"), ["key", "ctx"]).where("doc_id <> first.doc_id or at <> first.at")
    start = F.shiftright("at", 8)
    copies = again.select("doc_id", start.alias("start"), (start + F.col("at").bitwiseAND(255) + SPAN - 1).alias("end"))

    several = store(firsts.groupBy("key").agg(F.count("*").alias("different")).where("different > 1"))
    differ = firsts.select("key", "first.doc_id", "first.at").join(several, "key")
    wanted = store(differ.groupBy("doc_id").agg(F.collect_list(F.struct("key", "at")).alias("runs")))
    texts = keyed.join(wanted, "doc_id").select("doc_id", "text", "runs")
    found = texts.mapInArrow(_contexts, "key long, doc_id long, start long, n long, bytes binary")
    large = several.where(F.col("different") > LARGE).select("key")
    small = found.join(hinted(large, 16), "key", "left_anti")
    blocks = small.repartition("key").sortWithinPartitions("key").mapInArrow(_bucketed, "doc_id long, start long, end long")
    spans = copies.unionByName(blocks)
    if not large.isEmpty():
        strings = found.join(hinted(large, 16), "key", "left_semi").mapInArrow(_digests, "doc_id long, start long, digest binary")
        strings = store(strings)
        least = strings.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("c")).where("c > 1")
        later = strings.join(least, "digest").where("doc_id <> first.doc_id or start <> first.start")
        spans = spans.unionByName(later.select("doc_id", "start", (F.col("start") + SPAN).alias("end")))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")).mapInArrow(_merge, "doc_id long, cuts array<long>")


def _cut(batches, with_text):
    for batch in batches:
        rows = []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
            raw, cuts = (text or "").encode("utf-8", "surrogatepass"), cuts or []
            left, at = [], 0
            for s, e in zip(cuts[::2], cuts[1::2]):
                left.append(raw[at:s])
                at = min(e, len(raw))
            left = b"".join([*left, raw[at:]])
            rows.append((len(raw), len(raw) - len(left), len(cuts) // 2, hashlib.sha256(left).hexdigest(), left if with_text else None))
        cols = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedupe_substrings(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, the bytes kept, of every row.

    Removed is each byte that a string of SPAN bytes covers which also starts earlier: in a document with a smaller id, or
    before it in the same one. Strings are judged on the input. Null and empty texts have no bytes; rows with a null doc_id
    neither lose bytes nor take others'. Equal rows are one document, so each loses what one would; rows with one doc_id
    and different texts are documents each, ordered among themselves by a hash of the text. Bytes, not characters, are cut,
    so a character may be split. Other columns are not read; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    keyed = docs.where("doc_id is not null and text is not null")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = lambda rows: rows.select("doc_id", "text", "cuts").mapInArrow(lambda it: _cut(it, with_text), schema)
    if not several_texts(keyed):
        return cut(docs.join(store(repeated_spans(keyed)), "doc_id", "left"))
    hashed = keyed.withColumn("h", F.xxhash64("text"))
    places = store(numbered(hashed.select("doc_id", "h").distinct(), [], ["doc_id", "h"], "place"))
    cuts = store(repeated_spans(hashed.join(places, ["doc_id", "h"]).select(F.col("place").alias("doc_id"), "text")))
    named = places.join(cuts.withColumnRenamed("doc_id", "place"), "place").select("doc_id", "h", "cuts")
    rows = docs.withColumn("h", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    return cut(rows.join(named, ["doc_id", "h"], "left"))


def op3_suffix_dedup(spark, sf_dir):
    return dedupe_substrings(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
