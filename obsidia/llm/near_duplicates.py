"""Near-duplicate documents by DartMinHash over weighted word shingles, verified exactly, then united."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm.common import banded_components, drop, store, table, text_slices, with_both

WORDS, THRESHOLD = 5, 0.8
#: 18 bands of 4 coordinates: a pair at the threshold meets in one with probability 0.9999.
BANDS, ROWS = 18, 4
#: Darts thrown at a document on average: enough to hit all K coordinates in 7 of 8 cases; the rest throws twice as many.
K = BANDS * ROWS
DARTS = K * np.log(K) + 2 * K
ROW = "doc_id long, digest binary, n_shingles long, bands array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _throw(cells: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, K) signatures: for each coordinate the hash of its earliest dart.

    An element of weight w covers w unit cells; the darts of a cell arrive at exponential times which depend on the cell
    alone, each with a coordinate, so sets throw the same darts at what they share. A document throws those before a
    time at which it has about DARTS of them; where a coordinate is empty the time is doubled.
    """
    best = np.full((n_docs, K), np.iinfo(np.uint64).max, dtype=np.uint64)
    when = np.full((n_docs, K), np.inf)
    limit = DARTS / np.maximum(weight, 1)
    todo = np.ones(n_docs, dtype=bool)
    while len(cells):
        h, at, own = _mix(cells), np.zeros(len(cells)), doc
        while len(h):
            at = at - np.log(_unit(h))
            live = at < limit[own]
            h, at, own = h[live], at[live], own[live]
            dart = _mix(h + np.uint64(0x632BE59BD9B4E019))
            slot = own * K + (dart % np.uint64(K)).astype(np.int64)
            order = np.lexsort((dart, at, slot))
            first = order[np.flatnonzero(np.diff(slot[order], prepend=-1))]
            flat, times = slot[first], when.reshape(-1)
            new = (at[first] < times[flat]) | ((at[first] == times[flat]) & (dart[first] < best.reshape(-1)[flat]))
            times[flat[new]] = at[first][new]
            best.reshape(-1)[flat[new]] = dart[first][new]
            h = _mix(h + np.uint64(0x9E3779B97F4A7C15))
        todo &= np.isinf(when).any(axis=1) & (weight > 0)
        keep = todo[doc]
        cells, doc = cells[keep], doc[keep]
        limit = np.where(todo, 2 * limit, limit)
    return best


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def shingle_counts(text: str) -> Counter:
    """The weighted set: word shingles with their numbers; fewer words make one shingle, none makes none."""
    w = words_of(text)
    return Counter(tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))) if w else Counter()


def _cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash for each unit cell (shingle, how often it came before), its text's number, and each text's weight."""
    number: dict[bytes, int] = {}
    words = [words_of(t) for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    total = int(n.sum())
    for ws in words:
        for w in set(ws).difference(number):
            number[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    h = np.fromiter((number[w] for ws in words for w in ws), dtype=np.uint64, count=total)
    doc = np.repeat(np.arange(len(texts)), n)
    weight = np.where(n > 0, np.maximum(1, n - WORDS + 1), 0)
    start = np.cumsum(n) - n
    begin = np.arange(total) - np.repeat(start, n) < np.repeat(weight, n)
    size = np.minimum(n, WORDS)
    at, roll = np.flatnonzero(begin), np.zeros(int(begin.sum()), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WORDS):
            inside = i < size[doc[at]]
            roll[inside] = _mix(roll[inside] * np.uint64(0x9E3779B97F4A7C15) + h[at[inside] + i] + np.uint64(i + 1))
        own = doc[at]
        order = np.lexsort((roll, own))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (roll[order[1:]] != roll[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
        pos = np.arange(len(order))
        before = pos - np.maximum.accumulate(np.where(fresh, pos, 0)) if len(order) else pos
        return _mix(roll[order] + before.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), own[order], weight


def _sign(batches):
    for part in text_slices(batches, limit=1 << 20):
        texts = part.column("text").to_pylist()
        cells, doc, weight = _cells([t or "" for t in texts])
        rows = _throw(cells, doc, weight, len(texts)).reshape(len(texts), BANDS, ROWS)
        band = np.arange(BANDS, dtype=np.uint64)[None, :]
        for i in range(ROWS):
            band = _mix(rows[:, :, i] + band * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        bands = [b if w else [] for b, w in zip(band.view(np.int64).tolist(), weight)]
        digest = [t is not None and hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() or None for t in texts]
        yield pa.record_batch([part.column("doc_id"), pa.array(digest, pa.binary()), pa.array(weight, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "digest", "n_shingles", "bands"])


def _verify(batches):
    last, p = None, Counter()
    for batch in batches:
        a, b, same = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
        for i, x, y in zip(a, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
            if i != last:
                last, p = i, shingle_counts(x)
            q = shingle_counts(y)
            both = sum((p & q).values())
            same.append(both >= THRESHOLD * (p.total() + q.total() - both))
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(same)], names=["a", "b", "same"])


def _shingles(batches):
    """The hashes of the cells of each text, which has words as it shares a bucket."""
    for part in text_slices(batches, limit=1 << 20):
        cells, _, weight = _cells(part.column("text").to_pylist())
        one = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *weight]), pa.int32()), pa.array(cells.view(np.int64)))
        kinds = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1), pa.int32()), one)
        yield pa.record_batch([part.column("id"), kinds], names=["id", "cells"])


def _texts(docs: DataFrame, scratch: list) -> tuple[DataFrame, DataFrame]:
    """Stored: doc_id, digest, .. of the rows with a doc_id; and id, digest, rep (least doc_id), component (null without links)
    of the distinct texts."""
    keyed = docs.where("doc_id is not null")
    signed = store(keyed.mapInArrow(_sign, ROW), scratch)
    texts = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    reps = store(texts.withColumn("id", F.monotonically_increasing_id()), scratch)

    def prepare(ids, used):
        wanted = store(reps.join(ids, "id", "left_semi").select("id", F.col("rep").alias("doc_id"), "digest"), used)
        found = keyed.join(wanted, "doc_id").where(F.unhex(F.sha2("text", 256)) == F.col("digest"))
        texts = store(found.select("id", "text").dropDuplicates(["id"]), used)

        def verify(pairs):
            return with_both(pairs, texts, "text").mapInArrow(_verify, "a long, b long, same boolean").where("same").select("a", "b")

        def cells(ids):
            return texts.join(ids, "id", "left_semi").mapInArrow(_shingles, "id long, cells array<array<long>>")

        return verify, cells

    comp = banded_components(reps.select("id", F.explode("bands").alias("key")), prepare, THRESHOLD, reps.select("id", F.col("n").alias("w")))
    return signed, store(reps.select("id", "digest", "rep").join(comp.withColumnRenamed("v", "id"), "id", "left"), scratch)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size and kept (doc_id = class_id) of every document.

    Two documents are linked if their texts are equal or their multisets of lower-cased WORDS-word shingles have a
    Jaccard similarity of THRESHOLD or more; classes are the connected components. Equal texts are folded first.
    In each band's bucket every text is compared with the medoid; where that leaves several components, all texts of
    different ones are (`banded_components`).
    A null text is a class of its own, as is a text without words unless equal texts exist; fewer than WORDS words are
    one shingle. A doc_id stands for one document: repeated rows give one row; a repeated id with different texts gives
    one row with the least of their classes. Rows with a null doc_id come back each with a null class, kept. Other columns are not
    read. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    scratch: list = []
    signed, named = _texts(docs, scratch)
    least = store(named.where("component is not null").groupBy("component").agg(F.min("rep").alias("least")), scratch)
    named = store(named.join(least, "component", "left").select("digest", F.coalesce("least", "rep").alias("class_id")), scratch)
    member = store(signed.select("doc_id", "digest").distinct(), scratch).join(named, "digest", "left")
    found = store(member.groupBy("doc_id").agg(F.min(F.coalesce("class_id", "doc_id")).alias("class_id")))
    sizes = store(found.groupBy("class_id").agg(F.count("*").alias("class_size")))
    drop(scratch)
    out = found.join(sizes, "class_id").select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    nameless = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, one of each class of near-duplicate texts: that of the least (doc_id, text digest).

    Links are those of `classes`, but rows are judged by their own text: of a repeated doc_id with different texts each
    stays or goes with its text's class, so that no text is lost that is like no other. Of rows equal in id and text one stays.
    Rows with a null doc_id or text stay; an empty table gives no rows.
    """
    scratch: list = []
    signed, named = _texts(docs.select("doc_id", "text"), scratch)
    named = named.withColumn("c", F.coalesce("component", "id"))
    first = store(named.groupBy("c").agg(F.min(F.struct(F.col("rep").alias("doc_id"), "digest")).alias("stay")), scratch)
    stays = store(named.join(first, "c").select("digest", F.col("stay.doc_id").alias("stay_id"), F.col("stay.digest").alias("stay_digest")), scratch)
    rows = store(signed.where("digest is not null").groupBy("doc_id", "digest").agg(F.count("*").alias("n")), scratch).join(stays, "digest")
    is_stay = (F.col("doc_id") == F.col("stay_id")) & (F.col("digest") == F.col("stay_digest"))
    gone = store(rows.where(~is_stay).select("doc_id", "digest"))
    twice = store(rows.where(is_stay & (F.col("n") > 1)).select("doc_id", "digest"))
    drop(scratch)
    digest = F.unhex(F.sha2(docs["text"], 256))
    out = docs.join(gone, (docs["doc_id"] == gone["doc_id"]) & (digest == gone["digest"]), "left_anti")
    if not twice.isEmpty():
        tag = "digest_" + "_".join(docs.columns)  # clashes with no column
        same = (F.col("r.doc_id") == F.col("t.doc_id")) & (F.unhex(F.sha2("r.text", 256)) == F.col("t.digest"))
        left, many = out.alias("r"), twice.alias("t")
        once = left.join(many, same, "left_semi").withColumn(tag, F.sha2("text", 256)).dropDuplicates(["doc_id", tag]).drop(tag)
        out = left.join(many, same, "left_anti").unionByName(once)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_near_duplicates(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"))
