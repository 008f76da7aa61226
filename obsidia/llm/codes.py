"""Vector codes by parts, with exact integer codebooks whose nearest entries are found by fixed pivots.

Vectors of integers are cut into equal parts; each part is replaced by the nearest of a few entries. The distances of each
part to a few fixed pivots are computed once. In each round the distances of pivots and entries bound those of parts and
entries from below, |d(part, pivot) - d(pivot, entry)|: entries are tried in the order of their bounds, and those whose bound
exceeds the best distance so far are not evaluated. What is evaluated, and decides, are squared distances of integers.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm.common import drop, hinted, store, table

PARTS, ENTRIES, ROUNDS, PIVOTS = 8, 16, 6, 4
#: A component x counts as floor(SCALE * x); up to LARGEST in size, so that sums of squared differences are exact in 64 bits.
SCALE, LARGEST = 4096, (1 << 28) - 1


def integer_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label, v: the vectors as arrays of integers; those which are null or hold null or non-finite components are left
    out, as are components beyond LARGEST and widths that parts don't divide."""
    x = F.col("embedding")
    rows = vectors.select("vec_id", "label", F.transform(x, lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double"))).alias("v"), x)
    # nan is greater than any number, so it is beyond LARGEST as infinity is
    fit = F.forall("embedding", lambda e: e.isNotNull() & (F.abs(e.cast("double")) <= LARGEST / SCALE)) & (F.size("v") > 0) & (F.size("v") % parts == 0)
    return rows.where(x.isNotNull() & fit).select("vec_id", "label", "v")


def choose_pivots(book: np.ndarray, n: int) -> np.ndarray:
    """n entries that lie far apart: the first, then always that of the greatest summed distance to those chosen."""
    apart = np.sqrt(((book[:, None] - book[None]) ** 2).sum(axis=2).astype(np.float64))
    chosen = [0]
    while len(chosen) < min(n, len(book)):
        total = apart[chosen].sum(axis=0)
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return book[chosen]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, parts, pivots) distances of x (rows, parts, width) and pivots (parts, pivots, width)."""
    return np.stack([np.sqrt(((x - pivots[:, i]) ** 2).sum(axis=2).astype(np.float64)) for i in range(pivots.shape[1])], axis=2)


def nearest(x: np.ndarray, known: np.ndarray, books: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Entry and squared distance (rows, parts) of the nearest entry of books (parts, entries, width), ties to the lower one,
    and how many distances were evaluated. known: to_pivots(x, pivots)."""
    rows, parts, entries = len(x), books.shape[0], books.shape[1]
    of_entries = np.sqrt(((pivots[:, :, None] - books[:, None]) ** 2).sum(axis=3).astype(np.float64))
    bound = np.zeros((rows, parts, entries))
    for i in range(pivots.shape[1]):
        gap = np.abs(known[:, :, i, None] - of_entries[None, :, i])
        # roots are rounded: the bound gives way by more than that
        np.maximum(bound, gap - 1e-12 * (known[:, :, i, None] + of_entries[None, :, i]) - 1e-9, out=bound)
    bound = np.square(bound).reshape(rows * parts, entries)
    order = np.argsort(bound, axis=1, kind="stable")
    flat, part = x.reshape(rows * parts, -1), np.tile(np.arange(parts), rows)
    best, entry = np.full(rows * parts, np.iinfo(np.int64).max), np.full(rows * parts, entries)
    live, evaluated = np.arange(rows * parts), 0
    for turn in range(entries):
        e = order[live, turn]
        going = bound[live, e] <= best[live]  # later bounds are no less, so a part that stops has its entry
        live, e = live[going], e[going]
        if not len(live):
            break
        evaluated += len(live)
        d = ((flat[live] - books[part[live], e]) ** 2).sum(axis=1)
        better = (d < best[live]) | ((d == best[live]) & (e < entry[live]))
        best[live[better]], entry[live[better]] = d[better], e[better]
    return entry.reshape(rows, parts), best.reshape(rows, parts), evaluated


def _matrix(column, parts: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), parts, -1) if len(column) else flat.reshape(0, parts, 0)


def _with_pivots(batches, pivots):
    for batch in batches:
        if len(batch):
            known = to_pivots(_matrix(batch.column("v"), len(pivots)), pivots)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(known.ravel()), known[0].size).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns, lists], names=[*batch.schema.names, "pivot_distances"])


def _sums(batches, books, pivots):
    """part, entry, place, total, n: sums of the components of the parts that go to each entry, of a whole task."""
    parts, entries, width = books.shape
    total, n = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
    for batch in batches:
        if not len(batch):
            continue
        x = _matrix(batch.column("v"), parts)
        entry, _, _ = nearest(x, _matrix(batch.column("pivot_distances"), parts), books, pivots)
        part = np.broadcast_to(np.arange(parts), entry.shape)
        np.add.at(total, (part, entry), x)
        np.add.at(n, (part, entry), 1)
    part, entry, place = np.indices(books.shape).reshape(3, -1)
    columns = (part, entry, place, total.ravel(), np.repeat(n.ravel(), width))
    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "total", "n"])


def _codes(batches, books, pivots):
    for batch in batches:
        if len(batch):
            entry, d, _ = nearest(_matrix(batch.column("v"), len(books)), _matrix(batch.column("pivot_distances"), len(books)), books, pivots)
            code = ["".join(f"{e:02x}" for e in row) for row in entry.tolist()]
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(d.sum(axis=1))], names=["vec_id", "label", "code", "error"])


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors of the least vec_id; of equal ids the lesser vector, null ids last.
    Fewer vectors make fewer entries; none makes no width."""
    # entries rows of one vector each
    first = [r["v"] for r in rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return np.empty((parts, 0, 0), dtype=np.int64)
    if len({len(v) for v in first}) > 1:
        raise ValueError("the vectors have different widths")
    return np.array(first, dtype=np.int64).reshape(len(first), parts, -1).swapaxes(0, 1)


def train(rows: DataFrame, books: np.ndarray, pivots: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after some rounds of assigning parts and replacing entries by the floor of their parts' mean.

    rows: v and pivot_distances. Sums combine in each task; a round brings parts x entries x width sums to the driver,
    whatever the input.
    """
    for _ in range(rounds):
        sums = rows.mapInArrow(lambda it, b=books: _sums(it, b, pivots), "part long, entry long, place long, total long, n long")
        books = books.copy()
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector that `integer_vectors` keeps, and the codebooks.

    code holds two hex digits for the entry of each part, error the sum of the squared distances. Rows with equal vec_id, or
    equal in all, count each; null ids and labels stay; other columns are not read; an empty table gives no rows and books
    without entries. Vectors whose width is not that of the one with the least vec_id are left out; the first `entries`
    must agree, else it is an error. Integer parts and their pivot distances are stored once, for all rounds.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    scratch: list = []
    rows = integer_vectors(vectors, parts)
    books = first_books(rows, parts, entries)
    if not books.size:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where(F.lit(False)), books
    pivots = np.stack([choose_pivots(b, PIVOTS) for b in books])
    kind = vectors.schema["vec_id"].dataType.simpleString(), vectors.schema["label"].dataType.simpleString()
    rows = rows.where(F.size("v") == parts * books.shape[2])
    rows = store(rows.mapInArrow(lambda it: _with_pivots(it, pivots), f"vec_id {kind[0]}, label {kind[1]}, v array<long>, pivot_distances array<double>"), scratch)
    books = train(rows, books, pivots, rounds)
    found = store(rows.mapInArrow(lambda it: _codes(it, books, pivots), f"vec_id {kind[0]}, label {kind[1]}, code string, error long"))
    drop(scratch)
    return found, books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the error of all rows of the same label; null labels are one."""
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = hinted(store(totals), 32)
    joined = codes.alias("c").join(totals.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label")))
    return joined.select("c.*", "label_error")


def op13_vector_codes(spark, sf_dir):
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds unrolled; a distance and its entry are one number, d * ENTRIES + entry, so that the least has the lower entry."""
    ctes = [
        f"v as (select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding))",
        f"p as materialized (select vec_id, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] as x from v, range({PARTS}) r(part))",
        f"b0 as materialized (select part, entry, x as c from (select *, row_number() over (partition by part order by vec_id) - 1 as entry from p) where entry < {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        ctes.append(f"a{i} as materialized (select vec_id, part, x, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) * {ENTRIES} + entry) as k from p join b{i} using (part) group by all)")
        if i < ROUNDS:
            ctes.append(f"m{i} as (select part, entry, list(c order by i) as c from (select part, k % {ENTRIES} as entry, i, cast(floor(sum(x[i]) / count(*)) as bigint) as c from a{i}, range(1, len(x) + 1) r(i) group by all) group by all)")
            ctes.append(f"b{i + 1} as materialized (select b.part, b.entry, coalesce(m.c, b.c) as c from b{i} b left join m{i} m on b.part = m.part and b.entry = m.entry)")
    ctes.append(f"coded as (select vec_id, string_agg(printf('%02x', cast(k % {ENTRIES} as int)), '' order by part) as code, cast(sum(k // {ENTRIES}) as bigint) as error from a{ROUNDS} group by all)")
    return f"""with {", ".join(ctes)}
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) from b{ROUNDS}) as codebooks_sha256
from coded join v using (vec_id)"""


OP13_SQL = _sql()
