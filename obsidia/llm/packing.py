"""Packing of documents into fixed windows by the sum-of-squares rule."""

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from obsidia.llm.common import small_batches, text_slices
from obsidia.llm.subwords import default_path, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Share of a window that may be padding when its partition ends.
SLACK = 0.02
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class SquaresPacker:
    """Online packing of pieces into windows: a piece goes to the fill level after which the sum, over the levels
    strictly between empty and full, of the squared number of windows at that level is least.

    levels[h] lists the open windows filled to h; count mirrors their numbers. Ties go to the fullest level.
    """

    def __init__(self, width: int, first_id: int):
        self.width, self.next_id = width, first_id
        self.levels: list[list[int]] = [[] for _ in range(width)]
        self.count = np.zeros(width + 1, dtype=np.int64)

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) of a piece with 1 <= size < width."""
        c, w = self.count, self.width
        # moving a window from h to h+size changes the sum by 2*(count[h+size] - count[h]) + 2, without the first part at full
        gain = np.append(2 * (c[size + 1 : w] - c[1 : w - size]) + 2, 1 - 2 * c[w - size])
        gain[c[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
        best = len(gain) - int(np.argmin(gain[::-1]))
        if gain[best - 1] > 2 * c[size] + 1:
            best = 0
        window = self.levels[best].pop() if best else self.new()
        c[best] -= best > 0
        if best + size < w:
            self.levels[best + size].append(window)
            c[best + size] += 1
        return window, best


def _pack(batches, path: str, width: int, end_id: int):
    """Full windows are cut from each document first; its rest is placed online, and windows are written when full. When
    the partition ends, those still open keep what they hold, and the emptiest of them are dealt out to fill the gaps."""
    from pyspark import TaskContext

    packer = SquaresPacker(width, TaskContext.get().partitionId() << 40)
    enc = encoder(path)
    opened: dict[int, list[tuple]] = {}  # the pieces of windows that are not full: (doc_id, start, ids, doc_tokens)
    out: list[tuple] = []

    def emit(window, offset, piece):
        doc, start, ids, n = piece
        out.append((doc, start, len(ids), crc32(ids.astype("<u4").tobytes()), n, window, offset))

    def flush():
        cols = list(zip(*out)) or [()] * len(FIELDS)
        batch = pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=list(FIELDS))
        out.clear()
        return batch

    for part in text_slices(batches, limit=8 << 20):
        texts = [t or "" for t in part.column("text").to_pylist()]
        for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts, end_id)):
            n = len(ids)
            whole = n - n % width
            for start in range(0, whole, width):
                emit(packer.new(), 0, (doc, start, ids[start : start + width], n))
            if whole < n:
                window, offset = packer.place(n - whole)
                held = opened.setdefault(window, [])
                held.append((doc, whole, ids[whole:].copy(), n))
                if offset + n - whole == width:
                    at = 0
                    for piece in opened.pop(window):
                        emit(window, at, piece)
                        at += len(piece[2])
        if len(out) >= 8192:
            yield flush()
    enc.rest()
    for window, held in fill_gaps(opened, width):
        at = 0
        for piece in held:
            emit(window, at, piece)
            at += len(piece[2])
    yield flush()


def fill_gaps(opened: dict[int, list[tuple]], width: int) -> list[tuple[int, list[tuple]]]:
    """Windows with gaps over SLACK are filled, from the fullest on, with the pieces of the emptiest, cut where a gap
    ends; no other piece moves. At most one of the windows left has a greater gap."""
    size = {w: sum(len(p[2]) for p in held) for w, held in opened.items()}
    order = sorted(opened, key=lambda w: (-size[w], w))
    i, j = 0, len(order) - 1
    while i < j:
        gap = width - size[order[i]]
        if gap <= SLACK * width:
            i += 1
            continue
        doc, start, ids, n = opened[order[j]].pop()
        opened[order[i]].append((doc, start, ids[:gap], n))
        size[order[i]] += min(gap, len(ids))
        if len(ids) > gap:
            opened[order[j]].append((doc, start + gap, ids[gap:], n))
        if not opened[order[j]]:
            j -= 1
    return [(w, opened[w]) for w in order[: j + 1]]


def pack(docs: DataFrame, path: str | None = None, width: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents in windows of at most `width` ids; one row per piece.

    A document's ids are those of the tokenizer in `path`, then end_id; a null or empty text is end_id alone, rows
    with the same doc_id are packed as documents of their own and a null doc_id stays null. Columns other than
    doc_id and text are not read. Every partition of the input packs for itself, without a shuffle, so windows are
    whole when one is computed again; each may leave one window that is more than SLACK short. sequence_id is unique, not
    dense.
    An empty table gives no rows. A window is padded to `width`, except where its length is a power of two.
    """
    path = path or default_path()
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _pack(it, path, width, end_id), SCHEMA)


def op4_pack(spark, sf_dir):
    from obsidia.llm.common import table

    return pack(table(spark, sf_dir, "documents"))
