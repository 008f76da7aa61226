"""Helpers shared by the text operators: tables, checkpoints, size-checked joins, components."""

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it is measured to be at most this many bytes.
BROADCAST_BYTES = 8 << 20
#: Buckets of at most so many ids are compared pair by pair.
FEW = 12
#: Larger ones are compared by blocks of about BLOCK ids, fewer if these have over 1,024 shingles, two in a task. Matrices have
#: STRIP columns; shingles that so few pairs of a block pair share (RARE) are counted pair by pair.
BLOCK, STRIP, RARE = 1024, 4096, 16
#: Links that contraction has left are united in one task if they are counted to be at most so many (1.6 MB).
FEW_LINKS = 100_000


#: Rows of an Arrow batch. Rows are whole texts, and Spark's 10,000 of them would take much memory on either side.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    small_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="obsidia-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder, of which later steps read the columns they need.

    The table is noted in scratch, if given, for drop().
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    if scratch is not None:
        scratch.append((df.sparkSession, path))
    return stored


def drop(scratch: list) -> None:
    """Deletes stored tables that nothing reads any more; what was made from them must be stored itself."""
    for spark, path in scratch:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    scratch.clear()


def hinted(df: DataFrame, row_bytes, beyond: str | None = None) -> DataFrame:
    """df with a broadcast hint if its rows, of row_bytes each (a number or a column), are measured to fit.

    beyond, if given, is the hint of larger ones.
    """
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint(beyond) if beyond else df


def text_slices(batches, column: str = "text", limit: int = 2 << 20):
    """Record batches cut so that a slice holds about `limit` bytes of text, or one longer row."""
    for batch in batches:
        offsets = batch.column(column).cast(pa.large_string())
        sizes = pa.compute.binary_length(offsets).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if start < len(sizes):
            yield batch.slice(start)


def _roots():
    """A function from a vertex to its root, over its attribute parent; new vertices are roots."""
    parent: dict[int, int] = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    root.parent = parent
    return root


def _unite(batches):
    """Rows (v, p): the least vertex p of the component of each vertex of a few links (a, b)."""
    root = _roots()
    parent = root.parent
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = list(parent)
    yield pa.record_batch([pa.array(found, pa.int64()), pa.array([root(v) for v in found], pa.int64())], names=["v", "p"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Distributed union-find over edges (a, b): rows (v, component), component = least id of each component.

    Each round maps every vertex to the one that comes first, in an order drawn anew, among itself and its neighbours, and
    contracts the edges: about half of the vertices of a chain disappear, of a star nearly all, the last in order of a
    component surely. Nothing is collected but the number of edges left; once these are at most FEW_LINKS, whatever the
    input, one task unites them instead of further rounds. Null ends and self links are ignored; vertices without links
    don't appear. Both sides of each join are stored first, so that Spark can split a hub or a large component.
    """
    rounds: list = []
    e = store(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        rounds,
    )
    labels, turn, left = None, 0, e.count()
    while left:
        turn += 1
        if left <= FEW_LINKS:
            up = store(e.coalesce(1).mapInArrow(_unite, "v long, p long"), rounds)
        else:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            drawn = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))
            first = both.groupBy("a").agg(F.min(drawn("b")).alias("m"))
            up = store(first.select(F.col("a").alias("v"), F.least(drawn("a"), "m")["v"].alias("p")), rounds)
        if labels is None:
            labels = up.withColumnRenamed("p", "root")
        else:
            labels = labels.alias("l").join(up.alias("u"), F.col("l.root") == F.col("u.v"), "left")
            labels = store(labels.select("l.v", F.coalesce("u.p", "l.root").alias("root")), rounds)
        if left <= FEW_LINKS:
            break
        e = e.join(up.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
        e = e.join(up.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        e = store(e.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), rounds)
        left = e.count()
    if labels is None:
        return e.select(F.col("a").alias("v"), F.col("b").alias("component"))
    if turn == 1:  # one task has united them all, under the least ids
        drop(rounds[:-1])
        return labels.withColumnRenamed("root", "component")
    least = store(labels.groupBy("root").agg(F.min("v").alias("component")), rounds)
    found = store(labels.join(least, "root").select("v", "component"))
    drop(rounds)
    return found


def with_both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with `column` of the rows (id, column) of both; those of the same a follow each other."""
    for side in ("b", "a"):
        pairs = pairs.join(of.select(F.col("id").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def _shared(buckets: DataFrame, scratch: list) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, key): the pairs (a, b) that are buckets of two, and the rows (key, id, n) of buckets of n > 2 ids."""
    heads = store(buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi"), scratch)
    # a bucket of two is known from its ends
    two = store(heads.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct(), scratch)
    # the rows of all buckets need no sorting to meet the few that are left
    rest = hinted(store(heads.where("n > 2").select("key", "n"), scratch), 24, "shuffle_hash")
    return two, store(buckets.join(rest, "key").select("key", "id", "n"), scratch)


def _stars(buckets: DataFrame, ratio: float, scratch: list) -> DataFrame:
    """Pairs (a, b) of each bucket's medoid and its other ids, from rows (key, id, w, n).

    The medoid is the id whose buckets are the largest taken together: that of the text which most others are near to.
    """
    scored = store(buckets.withColumn("score", F.sum("n").over(W.partitionBy("id"))), scratch)
    best = F.max(F.struct("score", (-F.col("id")).alias("minus"), "w")).alias("m")
    hubs = store(scored.groupBy("key").agg(best).select("key", (-F.col("m.minus")).alias("hub"), F.col("m.w").alias("hub_w")), scratch)
    rows = scored.join(hubs, "key").where((F.col("id") != F.col("hub")) & (F.least("w", "hub_w") >= ratio * F.greatest("w", "hub_w")))
    return rows.select(F.col("hub").alias("a"), F.col("id").alias("b"))


def _crossed(buckets: DataFrame, ratio: float) -> DataFrame:
    """Pairs (a, b) of different components c in small buckets."""
    x, y = buckets.alias("x"), buckets.alias("y")
    near = F.least("x.w", "y.w") >= ratio * F.greatest("x.w", "y.w")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & near)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _common(p: tuple, q: tuple) -> np.ndarray:
    """How many numbers each list of p shares with each of q. Both are (numbers, lengths); a list holds a number once."""
    shape = len(p[1]), len(q[1])
    rows = [np.repeat(np.arange(len(lengths)), lengths) for _, lengths in ((p,) if p is q else (p, q))]
    values = p[0] if p is q else np.concatenate([p[0], q[0]])
    order = np.argsort(values)  # one sorting numbers the values of both sides
    values = values[order]
    col = np.cumsum(np.append(0, values[1:] != values[:-1])) if len(values) else values
    if p is q:
        sides = [(rows[0][order], col)] * 2
    else:
        first = order < len(p[0])
        sides = [(rows[0][order[first]], col[first]), (rows[1][order[~first] - len(p[0])], col[~first])]
    often = [np.bincount(col, minlength=len(values)) for _, col in sides]
    met = often[0] > 1 if p is q else (often[0] > 0) & (often[1] > 0)
    place = np.cumsum(met) - 1
    sides = [(row[keep], place[col[keep]]) for row, col in sides for keep in [met[col]]]
    often = [n[met] for n in often]
    rare = often[0] * often[1] <= RARE
    (row, col), (other, _) = sides
    begin = np.cumsum(often[1]) - often[1]
    mine = np.flatnonzero(rare[col])
    times = often[1][col[mine]]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    cell = np.repeat(row[mine], times) * shape[1] + other[np.repeat(begin[col[mine]], times) + step]
    out = np.bincount(cell, minlength=shape[0] * shape[1]).astype(np.float32).reshape(shape)
    place = np.cumsum(~rare) - 1
    sides = [(row[keep], place[col[keep]]) for row, col in sides for keep in [~rare[col]]]
    left = int((~rare).sum())
    for lo in range(0, left, STRIP):
        dense = []
        for (row, col), n in zip(sides, shape):
            i, j = np.searchsorted(col, [lo, lo + STRIP])
            dense.append(np.zeros((n, min(STRIP, left - lo)), dtype=np.float32))
            dense[-1][row[i:j], col[i:j] - lo] = 1
        out += dense[0] @ dense[1].T
    return out


def _bridge(table: pa.Table, ratio: float, every: bool) -> pa.Table:
    """Links (meet, a, b) between the components c of two blocks (side 0 and 1, or one block with itself).

    Ids are linked if the Jaccard similarity of their sets of one kind is at least ratio. All pairs are compared; of the links
    those are returned that unite components which the ones before leave apart, or every one.
    """
    side, ids, c = (table.column(x).to_numpy() for x in ("side", "id", "c"))
    sets = table.column("cells").combine_chunks()
    kinds = len(sets[0])
    sets = sets.flatten()
    rows = [np.flatnonzero(side == x) for x in ((0, 1) if side.any() else (0,))]
    x, y = rows[0], rows[-1]
    like = np.zeros((len(x), len(y)), dtype=bool)
    for kind in range(kinds):
        lists = [sets.take(pa.array(r * kinds + kind)) for r in rows]
        lists = [(v.flatten().to_numpy(), pa.compute.list_value_length(v).to_numpy()) for v in lists]
        both = _common(lists[0], lists[-1]).astype(np.float64)
        like |= (both > 0) & (both >= ratio * (lists[0][1][:, None] + lists[-1][1][None, :] - both))
    i, j = np.nonzero(like & (c[x][:, None] != c[y][None, :]))
    i, j = x[i], y[j]
    if not every:
        found = _uniting(c, i, j)
        i, j = i[found], j[found]
    a, b = ids[i], ids[j]
    meet = np.full(len(a), table.column("meet")[0].as_py(), dtype=np.int64)
    return pa.table({"meet": meet, "a": np.minimum(a, b), "b": np.maximum(a, b)})


def _uniting(c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links (i, j) unite components c that the ones before leave apart."""
    ends = np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])], axis=1)
    root, found = _roots(), []
    for at in np.unique(ends, axis=0, return_index=True)[1] if len(ends) else ():
        v, w = root(int(c[i[at]])), root(int(c[j[at]]))
        if v != w:
            root.parent[max(v, w)] = min(v, w)
            found.append(at)
    return np.array(found, dtype=np.int64)


def _meetings(buckets: DataFrame, cells: DataFrame, scratch: list) -> DataFrame:
    """Rows (meet, side, id, c): the meetings of blocks of the buckets of rows (key, id, c), whose sets are cells (id, cells).

    The ids of a bucket are dealt into blocks by hash, those of a component that fills a block into blocks of their own; sets of
    similar numbers of shingles lie together, so that a block has at most about BLOCK << 10 of them. Every block meets every
    other one and itself, but for the blocks of one component. What a task holds is bounded; the work in a bucket grows
    with its ids outside its largest component times all of its ids.
    """
    n = F.aggregate("cells", F.lit(0), lambda x, y: x + F.size(y))
    g = F.greatest(F.lit(0), F.ceil(F.log2(n / 1024))).cast("int")
    room = F.greatest(F.lit(1), F.floor(BLOCK / F.pow(F.lit(2), "g")))
    rows = store(buckets.select("key", "id", "c").join(cells.select("id", g.alias("g")), "id"), scratch)
    own = F.col("k") >= room
    parts = rows.groupBy("key", "g", "c").agg(F.count("*").alias("k")).withColumn("pure", own).withColumn("part", F.when(own, F.col("c")).otherwise(0))
    parts = store(parts, scratch)
    sizes = store(parts.groupBy("key", "g", "pure", "part").agg(F.ceil(F.sum("k") / F.first(room)).alias("blocks")), scratch)
    named = store(parts.join(sizes, ["key", "g", "pure", "part"]).select("key", "g", "c", "pure", "part", "blocks"), scratch)
    block = lambda j: F.struct("g", "pure", "part", j.cast("int").alias("j")).alias("block")
    laid = store(rows.join(named, ["key", "g", "c"]).select("key", "id", "c", block(F.pmod(F.xxhash64("id"), F.col("blocks")))), scratch)
    blocks = store(laid.select("key", "block").distinct(), scratch)
    x, y = blocks.select("key", F.col("block").alias("x")), blocks.select("key", F.col("block").alias("y"))
    same = F.col("x.pure") & F.col("y.pure") & (F.col("x.part") == F.col("y.part"))
    pairs = x.join(y, "key").where((F.col("x") <= F.col("y")) & ~same)
    pairs = store(pairs.withColumn("meet", F.monotonically_increasing_id()), scratch)
    sides = pairs.withColumn("at", F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y")))
    sides = store(sides.select("key", "meet", F.posexplode("at").alias("side", "block")), scratch)
    return store(laid.join(sides, ["key", "block"]).select("meet", "side", "id", "c"), scratch)


def _bridged(meetings: DataFrame, cells: DataFrame, ratio: float, every: bool = False) -> DataFrame:
    """Links (meet, a, b) that unite what can be united in each meeting (`_meetings`), or every link of different components."""
    return meetings.join(cells, "id").groupBy("meet").applyInArrow(lambda t: _bridge(t, ratio, every), "meet long, a long, b long")


def banded_components(one: DataFrame, prepare, ratio: float, sizes: DataFrame | None = None) -> DataFrame:
    """Components of the links among ids that share a bucket; rows (v, component).

    one: (id, key), a row for each bucket of an id. sizes (id, w), if given, has rows for all ids: a link needs the smaller
    w at least ratio times the greater.
    prepare(ids) gives, for the ids that share any bucket, verify(pairs), which keeps the links among pairs (a, b), and
    cells(ids): rows (id, cells), for each kind of shingles an array of the hashes of the different ones (or none). Ids are
    linked if the Jaccard similarity of the shingles of any kind is at least ratio.

    In each bucket every id is compared with the medoid. Where a bucket then still holds several components, all ids of
    different ones are compared: pair by pair in buckets of at most FEW, by blocks in larger ones (`_bridged`). Pairs that
    were verified with the medoid, as all in buckets of two, are not verified again. So every link
    inside a bucket is in a component, whatever the bucket's size, and no step pairs ids of a large bucket as rows. Hashes of
    64 bits propose links in blocks, and verify decides. Two blocks propose only what unites components; where verify refuses
    one of these, another may have been left out for it, and all links of the two blocks are proposed instead.
    """
    scratch: list = []
    two, shared = _shared(one, scratch)
    if sizes is None:
        shared = shared.withColumn("w", F.lit(1))
    else:
        shared = store(shared.join(sizes, "id"), scratch)
        for side in ("a", "b"):
            two = two.join(sizes.select(F.col("id").alias(side), F.col("w").alias(f"w_{side}")), side)
        two = store(two.where(F.least("w_a", "w_b") >= ratio * F.greatest("w_a", "w_b")).select("a", "b"), scratch)
    ids = shared.select("id").unionByName(two.select(F.explode(F.array("a", "b")).alias("id")))
    verify, cells_of = prepare(store(ids.distinct(), scratch), scratch)
    tested = store(two.unionByName(_stars(shared, ratio, scratch)).distinct(), scratch)
    links = store(verify(tested), scratch)
    comp = connected_components(links)
    named = shared.join(comp.withColumnRenamed("v", "id"), "id", "left").select("key", "id", "w", "n", F.coalesce("component", "id").alias("c"))
    mixed = store(named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"), scratch)
    left = store(named.join(mixed, "key"), scratch)
    if not left.isEmpty():
        pairs, many, proposed = _crossed(left.where(F.col("n") <= FEW), ratio), left.where(F.col("n") > FEW), None
        if not many.isEmpty():
            cells = store(cells_of(store(many.select("id").distinct(), scratch)), scratch)
            meetings = _meetings(many, cells, scratch)
            proposed = store(_bridged(meetings, cells, ratio), scratch)
            pairs = pairs.unionByName(proposed.select("a", "b"))
        known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = store(pairs.distinct().join(known, ["a", "b"], "left_anti"), scratch)
        found = store(verify(pairs), scratch)
        if proposed is not None:
            refused = proposed.join(found, ["a", "b"], "left_anti").select("meet")
            if not refused.isEmpty():
                again = _bridged(meetings.join(store(refused.distinct(), scratch), "meet", "left_semi"), cells, ratio, every=True)
                more = again.select("a", "b").distinct().join(known.unionByName(pairs), ["a", "b"], "left_anti")
                found = found.unionByName(store(verify(store(more, scratch)), scratch))
        if not found.isEmpty():
            comp = connected_components(links.unionByName(found))
    drop(scratch)
    return comp
