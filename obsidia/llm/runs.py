"""Periodic runs of words: dyadic blocks look for themselves in neighbouring windows, by range successor over a suffix array.

Words of a text are numbered, and prefix doubling ranks all stretches of 1, 2, 4, ... words; ranks of one length are equal
only for equal stretches of one text, and the last ranks are the suffix array. A block of 2^k words, at every multiple of
2^(k-1), asks where it stands again in a window of distances beyond it: a wavelet tree over the suffix array gives the next
place in the block's range of suffixes. Places that follow each other at no more than half a block form a progression, which
is taken as one. The distances are candidate periods; common extensions both ways, by the ranks, give the runs.

A run of period q and length L holds L - q >= max(6, q) first words whose every block stands again q words later. Levels
k = 2 (distances 1 to 10) and k > 2 (3 * 2^(k-1) - 1 to 3 * 2^k - 2) cover all q, as a stretch of 3 * 2^(k-1) - 1 words
holds one of the level's blocks.
"""

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm.common import table, text_slices

#: Words of the shortest run, and how often its period stands in it at least.
MIN_WORDS, MIN_TIMES = 12, 2
RUNS = "runs array<struct<start:long,length:long,period:long>>"


class _Stretches:
    """Ranks of all stretches of 2^k words of some texts, each followed by a mark of its own, and the suffix array."""

    def __init__(self, texts: list[list[bytes]]):
        number: dict[bytes, int] = {}
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        n = int(sum(len(t) + 1 for t in texts))
        ids = np.empty(n, dtype=np.int64)
        for start, words in zip(self.starts, texts):
            ids[start : start + len(words)] = [number.setdefault(w, len(number)) for w in words]
        ends = self.starts + [len(t) for t in texts]
        ids[ends] = len(number) + np.arange(len(texts))
        doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        self.n, self.ranks = n, [ids]
        #: of each level the places whose stretches are not alone, with the first rank of their group and its size
        self.groups: list = [None]
        wide = len(number) + len(texts)
        own = np.unique(doc * wide + ids, return_inverse=True)[1] if len(texts) * wide * wide >= 1 << 62 else doc * wide + ids
        self._refine(np.arange(n), np.zeros(n, dtype=np.int64), own * wide + np.append(ids[1:], 0))
        while len(self.groups[-1][0]):
            at, rank, _ = self.groups[-1]
            step = 1 << (len(self.ranks) - 1)
            self._refine(at, rank, rank * n + self.ranks[-1][at + step])

    def _refine(self, at: np.ndarray, old: np.ndarray, key: np.ndarray) -> None:
        """Adds a level: the places `at`, whole groups of rank old, are ranked by key, which sorts by old first."""
        order = np.argsort(key, kind="stable")
        at, old, key = at[order], old[order], key[order]
        i = np.arange(len(at))
        fresh = np.append(True, key[1:] != key[:-1])[: len(at)]
        first = np.maximum.accumulate(np.where(fresh, i, 0)) if len(at) else i
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1])[: len(at)], i, 0)) if len(at) else i
        rank = old + first - group
        heads = np.flatnonzero(fresh)
        size = np.repeat(np.diff(np.append(heads, len(at))), np.diff(np.append(heads, len(at))))
        new = np.empty(self.n, dtype=np.int64) if len(self.ranks) == 1 else self.ranks[-1].copy()
        new[at] = rank
        self.ranks.append(new)
        more = size > 1
        self.groups.append((at[more], rank[more], size[more]))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal."""
        x, y = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[k][x] == self.ranks[k][y]
            x[same] += 1 << k
            y[same] += 1 << k
        return x - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i < j are equal."""
        x, y = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            step = 1 << k
            same = (x >= step) & (self.ranks[k][np.maximum(x - step, 0)] == self.ranks[k][np.maximum(y - step, 0)])
            x[same] -= step
            y[same] -= step
        return i - x


class _Places:
    """Wavelet tree over places in the order of their suffixes."""

    def __init__(self, places: np.ndarray, n: int):
        self.bits, self.zeros, values = max(1, int(n).bit_length()), [], places
        for b in range(self.bits - 1, -1, -1):
            zero = (values >> b) & 1 == 0
            self.zeros.append(np.append(0, np.cumsum(zero)))
            values = np.concatenate([values[zero], values[~zero]])

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, none: int) -> np.ndarray:
        """The least place of the range lo to hi (exclusive) that is `least` or more; `none` if there is none."""
        left, right, below = lo.copy(), hi.copy(), np.zeros(len(lo), dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (least >> (self.bits - 1 - level)) & 1 == 1
            a, b, all_zeros = zeros[left], zeros[right], zeros[-1]
            below += np.where(one, b - a, 0)
            left, right = np.where(one, all_zeros + left - a, a), np.where(one, all_zeros + right - b, b)
        found = below < hi - lo
        left, right, nth, out = lo[found], hi[found], below[found], np.zeros(int(found.sum()), dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b, all_zeros = zeros[left], zeros[right], zeros[-1]
            one = nth >= b - a
            nth = np.where(one, nth - (b - a), nth)
            out = (out << 1) | one
            left, right = np.where(one, all_zeros + left - a, a), np.where(one, all_zeros + right - b, b)
        values = np.full(len(lo), none, dtype=np.int64)
        values[found] = out
        return values


def _candidates(s: _Stretches):
    """(place, distance): a block stands at place and again at place + distance, for all levels and windows."""
    order = np.empty(s.n, dtype=np.int64)
    order[s.ranks[-1]] = np.arange(s.n)
    kept = np.zeros(s.n, dtype=bool)
    kept[s.groups[2][0]] = True
    kept = kept[order]
    places, compact = _Places(order[kept], s.n), np.append(0, np.cumsum(kept))
    found = []
    for k in range(2, len(s.groups)):
        block = 1 << k
        near, far = (1, 10) if k == 2 else (3 * (block >> 1) - 1, 3 * block - 2)
        at, rank, size = s.groups[k]
        here = at % (block >> 1) == 0
        i, lo = at[here], compact[rank[here]]
        hi, x = lo + size[here], at[here] + near
        while len(i):
            end = np.minimum(i + far, s.n - 1)
            live = x <= end
            i, lo, hi, x, end = i[live], lo[live], hi[live], x[live], end[live]
            y = places.successor(lo, hi, x, s.n)
            live = y <= end
            i, lo, hi, y, end = i[live], lo[live], hi[live], y[live], end[live]
            then = np.full(len(i), s.n, dtype=np.int64)
            more = y < end
            then[more] = places.successor(lo[more], hi[more], y[more] + 1, s.n)
            step, times = then - y, np.ones(len(i), dtype=np.int64)
            row = np.flatnonzero((then <= end) & (step <= block >> 1))
            d = step[row]
            reach = then[row] + s.ahead(y[row], then[row])
            times[row] = np.minimum((reach - block - y[row]) // d, (end[row] - y[row]) // d) + 1
            # within one stretch of the shorter period d a multiple of d is no least period
            own = i[row] + d + s.ahead(i[row], i[row] + d)
            void = row[(y[row] + block <= own) & ((y[row] - i[row]) % d == 0)] if k > 2 else row[:0]
            keep = np.ones(len(i), dtype=bool)
            keep[void] = False
            step = np.where(times > 1, step, 1)
            each = np.repeat(np.flatnonzero(keep), times[keep])
            nth = np.arange(len(each)) - np.repeat(np.cumsum(times[keep]) - times[keep], times[keep])
            found.append((i[each], y[each] - i[each] + nth * step[each]))
            x = y + (times - 1) * step + 1
    return [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, dtype=np.int64)] * 2


def find_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its runs: rows (start, length, period) by start, then period."""
    none = np.empty((0, 3), dtype=np.int64)
    if not texts:
        return []
    s = _Stretches(texts)
    if len(s.groups) < 3 or not len(s.groups[2][0]):
        return [none] * len(texts)
    i, q = _candidates(s)
    begin = i - s.behind(i, i + q)
    length = i + q + s.ahead(i, i + q) - begin
    good = length >= np.maximum(MIN_WORDS, MIN_TIMES * q)
    rows = np.unique(np.stack([begin[good], length[good], q[good]], axis=1), axis=0)
    # of equal stretches the least period
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))[: len(rows)]]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    cut = np.searchsorted(rows[:, 0], s.starts)
    return [part - [start, 0, 0] for part, start in zip(np.split(rows, cut[1:]), s.starts)]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(mark, runs[:, 0] + runs[:, 2], 1)
    np.add.at(mark, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]


def _mark(batches, rewrite):
    for part in text_slices(batches, limit=768 << 10):
        ids = part.column("doc_id")
        # bytes are split at the six white characters of ASCII
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column("text").to_pylist()]
        if rewrite is not None:
            words = [rewrite(i, w) for i, w in zip(ids.to_pylist(), words)]
        runs = find_runs(words)
        flat = np.concatenate(runs) if runs else np.empty((0, 3), dtype=np.int64)
        rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], names=["start", "length", "period"])
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        text = [b" ".join(collapse(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, runs)]
        yield pa.record_batch([ids, pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, rows), pa.array(text, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period) and collapsed, the text without repetitions, of every row.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0. A run is a stretch with least period q and MIN_WORDS words and
    MIN_TIMES * q at least, which no neighbouring word extends. collapsed leaves out what a run holds after its first q words and
    joins the rest by single spaces. rewrite(doc_id, words), if given, may change the words first.

    Null and empty texts have no words, no runs and an empty text; rows with equal or null ids are judged each; other
    columns are not read; an empty table gives no rows. A text is held whole by one task, a few hundred bytes a word.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: _mark(it, rewrite), f"doc_id long, n_words long, {RUNS}, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of one document in ten with a periodic end: from a place on, stretches that depend on the id repeat."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def run_report(marked: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (of equals the first, then that of the least period) with its exponent, and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = marked.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark, sf_dir):
    return run_report(periodic_runs(table(spark, sf_dir, "documents"), planted))
