"""Token ids in blocks of zstandard frames, each document on its own, under one shared dictionary.

A block is a byte string: MAGIC, sha256 of the dictionary (32 bytes), id width in bytes, number of documents,
then the index: for each document its id count and the end of its frame, then the frames. One document is read
by its index entry and the dictionary alone. Blocks are rows of a table which Spark writes and reads, so any store
that Spark reaches will do; the dictionary is a table of one row beside them.
"""

import hashlib
import struct
import uuid
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsidia.llm.common import shared_dir, table, text_slices
from obsidia.llm.subwords import default_path, encoder

MAGIC = b"TOKBLK01"
HEAD = struct.Struct("<8s32sBI")
BLOCK_BYTES = 4 << 20
#: The dictionary is trained on at most so many documents, the least by a hash of their id, and so many ids of each, from
#: a place that depends on the hash.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 1000, 2000, 64 << 10
BLOCKS = "part int, block int, doc_ids array<long>, n_tokens long, payload binary"
DOCS = "part int, block int, doc_id long, before long, n_tokens long, ids_crc32 long"


def pack_block(dictionary: bytes, arrays: list[np.ndarray], compressor) -> bytes:
    frames = [compressor.compress(a.tobytes()) for a in arrays]
    index = np.array([(len(a), 0) for a in arrays], dtype="<u4").reshape(-1, 2)
    index[:, 1] = np.cumsum([len(f) for f in frames])
    return HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), arrays[0].itemsize, len(arrays)) + index.tobytes() + b"".join(frames)


class BlockReader:
    """Random access to the documents of one block."""

    def __init__(self, dictionary: bytes, payload: bytes):
        magic, digest, width, n = HEAD.unpack_from(payload)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a block of this dictionary")
        self.payload, self.dtype = payload, f"<u{width}"
        self.index = np.frombuffer(payload, "<u4", 2 * n, HEAD.size).reshape(n, 2).astype(np.int64)
        self.base = HEAD.size + 8 * n
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, i: int) -> np.ndarray:
        n, end = self.index[i]
        start = self.index[i - 1][1] if i else 0
        return np.frombuffer(self.zstd.decompress(self.payload[self.base + start : self.base + end], max_output_size=int(n) * 4), self.dtype, n)


def train(docs: DataFrame, path: str) -> bytes:
    """A dictionary of serialized id arrays; empty bytes if the sample is too small to train on."""
    pick = docs.where("text is not null and text <> ''").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS)
    from_ = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - 8 * SAMPLE_IDS, F.lit(0)) + 1).cast("int") + 1
    sample = docs.join(F.broadcast(pick.select("doc_id").distinct()), "doc_id").select(F.substr("text", from_, F.lit(8 * SAMPLE_IDS)).alias("text"))
    rows = [r[0] for r in sample.limit(2 * SAMPLE_DOCS).collect() if r[0]]
    arrays = [a[:SAMPLE_IDS].tobytes() for a in encoder(path).encode(rows)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _write(batches, path, end_id, dictionary):
    from pyspark import TaskContext

    part, block = TaskContext.get().partitionId(), 0
    enc = encoder(path)
    data = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    compressor = zstandard.ZstdCompressor(level=1, **data)
    ids, arrays = [], []

    def flush():
        row = {"part": [part], "block": [block], "doc_ids": [ids], "n_tokens": [sum(map(len, arrays))], "payload": [pack_block(dictionary, arrays, compressor)]}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("payload", pa.binary())]))

    held = 0
    for piece in text_slices(batches, limit=8 << 20):
        for doc, a in zip(piece.column("doc_id").to_pylist(), enc.encode([t or "" for t in piece.column("text").to_pylist()], end_id)):
            ids.append(doc)
            arrays.append(a)
            held += a.nbytes
            if held >= BLOCK_BYTES:
                yield flush()
                block, held, ids, arrays = block + 1, 0, [], []
    if ids:
        yield flush()
    enc.rest()


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2) -> None:
    """Writes ids of all documents, in ascending doc_id order (nulls first), as blocks under folder."""
    path = path or default_path()
    docs = docs.select("doc_id", "text")
    dictionary = train(docs, path)
    spark = docs.sparkSession
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{folder}/dictionary")
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(lambda it: _write(it, path, end_id, dictionary), BLOCKS).write.parquet(f"{folder}/blocks")


def _read(batches, dictionary):
    for batch in batches:
        for part, block, doc_ids, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "doc_ids", "payload"))):
            reader = BlockReader(dictionary, payload)
            arrays = [reader[i] for i in range(len(reader))]
            n = np.array([len(a) for a in arrays], dtype=np.int64)
            cols = [[part] * len(n), [block] * len(n), doc_ids, np.cumsum(n) - n, n, [crc32(a.astype("<u4").tobytes()) for a in arrays]]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "block", "doc_id", "before", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    blocks = spark.read.parquet(f"{folder}/blocks")
    # one row for each block, ordered within its part, then one for each part: the only unpartitioned order is over parts
    sizes = blocks.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    starts = sizes.withColumn("in_part", F.sum("n").over(W.partitionBy("part").orderBy("block")) - F.col("n"))
    starts = starts.join(parts, "part").select("part", "block", (F.col("in_part") + F.col("part_start")).alias("block_start"))
    docs = blocks.select("part", "block", "doc_ids", "payload").mapInArrow(lambda it: _read(it, dictionary), DOCS)
    return docs.join(starts, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the documents' ids as files and returns what is read back from them, one row per document.

    Null and empty texts are end_id alone; rows with the same doc_id follow each other, a null doc_id comes first;
    an empty table gives no rows; columns other than doc_id and text are not read. Spark splits neither a block
    nor a document: a document longer than a block has one of its own.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, path, end_id)
    return read(docs.sparkSession, folder)


def op7_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"))
