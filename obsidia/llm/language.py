"""Language ID with blended-spectrum string kernels, Nyström landmarks and one-versus-rest kernel ridge regression."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from obsidia.llm.common import small_batches, table, text_slices

#: n-grams of 1 to ORDER characters are hashed to WIDTH presence bits.
ORDER, WIDTH = 3, 1 << 14
#: At most so many labelled rows of a language are read for training. LANDMARKS of them, dealt evenly over the languages,
#: are landmarks, but no fewer than LANDMARKS_PER_LANG of each language, however many there are.
ROWS_PER_LANG, LANDMARKS, LANDMARKS_PER_LANG, RIDGE = 250, 128, 8, 1e-2
UNKNOWN = "und"


def presence(texts: list[str]) -> np.ndarray:
    """(texts, WIDTH) float32: which n-grams a lower-cased text has, scaled to unit length. Equal n-grams of different
    orders share no bit but by a clash of the hash. Every run of characters that are no letters counts as one space."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    joined = "".join(f" {t.lower()} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    ends = np.cumsum([len(t.lower()) + 2 for t in texts])
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends, prepend=0))
    codes = np.where(_letter(codes), codes, np.uint32(32))
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~((codes[1:] == 32) & (codes[:-1] == 32) & (row[1:] == row[:-1]))
    codes, row = codes[keep], row[keep]
    gram = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, ORDER + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        gram = gram[:m] * np.uint32(0x9E3779B1) + (codes[n - 1 :] + np.uint32(n)) * np.uint32(0x85EBCA6B)
        inside = row[:m] == row[n - 1 :]
        mixed = gram ^ (gram >> np.uint32(15))
        mixed = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(18)
        out[row[:m][inside], mixed[inside]] = 1
    norm = np.sqrt(out.sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1)


_letters = None


def _letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters[np.minimum(codes, 0x10FFFF)]


def packed(texts: list[str]) -> list[bytes]:
    """The presence bits of each text, WIDTH / 8 bytes."""
    return [row.tobytes() for row in np.packbits(presence(texts) > 0, axis=1)]


def unpacked(rows: list[bytes]) -> np.ndarray:
    """Presence bits scaled to unit length, as `presence` gives them."""
    bits = np.unpackbits(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), WIDTH // 8), axis=1).astype(np.float32)
    return bits / np.maximum(np.sqrt(bits.sum(axis=1, keepdims=True)), 1)


class Model:
    """Scores of the languages by batched matrix products: texts x landmarks kernel, then the ridge weights.

    Trained from presence bits (see `packed`) and languages. What is broadcast are the landmarks' bits, 2 kB each, a root of
    landmarks x landmarks and landmarks x languages weights.
    """

    def __init__(self, bits: list[bytes], langs: list[str]):
        self.langs = sorted(set(langs))
        y = np.searchsorted(self.langs, langs)
        order = np.argsort(y, kind="stable")
        rank = np.empty(len(y), dtype=np.int64)
        rank[order] = np.arange(len(y)) - np.searchsorted(y[order], y[order])
        n = max(LANDMARKS, LANDMARKS_PER_LANG * len(self.langs))
        self.bits = [bits[i] for i in np.argsort(rank, kind="stable")[:n]]  # dealt evenly over the languages
        landmarks = self.landmarks
        kernel = np.concatenate([unpacked(bits[i : i + 256]) @ landmarks.T for i in range(0, len(bits), 256)])
        values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
        good = values > 1e-6 * values.max()
        self.root = vectors[:, good] / np.sqrt(values[good])
        phi = np.c_[kernel @ self.root, np.ones(len(kernel))]
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        weight = 1 / np.bincount(y)[y]  # every language counts alike
        a = (phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1]) / len(self.langs)
        self.weights = np.linalg.solve(a, (phi * weight[:, None]).T @ target)

    @property
    def landmarks(self) -> np.ndarray:
        """(landmarks, WIDTH), unpacked where it is first used."""
        if "_landmarks" not in self.__dict__:
            self._landmarks = unpacked(self.bits)
        return self._landmarks

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_landmarks"}

    def scores(self, texts: list[str]) -> np.ndarray:
        k = presence(texts) @ self.landmarks.T
        return np.c_[k @ self.root, np.ones(len(k))] @ self.weights


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _bits(batches):
    for part in text_slices(batches, limit=256 << 10):
        texts = part.column("text").to_pylist()
        bits = [x for i in range(0, len(texts), 64) for x in packed(texts[i : i + 64])]
        yield pa.record_batch([part.column("doc_id"), part.column("lang"), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Model | None:
    """Learns from the rows of each language that come first by a hash of doc_id, at most rows_per_lang each, not held out.

    Presence bits are made where the texts are; the driver gets 2 kB for each training row. Of a repeated doc_id one row
    counts, that of the least language and bits.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    pick = known.select("doc_id", "lang", F.row_number().over(order).alias("rank")).where(F.col("rank") <= rows_per_lang)
    pick = pick.select("doc_id").distinct()
    chosen = known.join(F.broadcast(pick), "doc_id").select("doc_id", "lang", "text")  # rows_per_lang ids of each language
    bits = chosen.mapInArrow(_bits, "doc_id long, lang string, bits binary")
    rows = bits.groupBy("doc_id").agg(F.min(F.struct("lang", "bits")).alias("m")).select("doc_id", "m.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return Model([bytes(r["bits"]) for r in rows], [r["lang"] for r in rows]) if rows else None


def _predict(batches, shared, added, keep_text=False):
    model = shared.value
    for batch in batches:
        for part in text_slices([batch], limit=256 << 10):
            texts = [t or "" for t in part.column("text").to_pylist()]
            has = [bool(np.any(_letter(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")))) for t in texts]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if model is not None:
                s = np.concatenate([model.scores(texts[i : i + 64]) for i in range(0, len(texts), 64)])
                best = s.argmax(axis=1)
                e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                sure = e.max(axis=1) / e.sum(axis=1)
                for i, ok in enumerate(has):
                    if ok:
                        lang[i], score[i] = model.langs[best[i]], float(sure[i])
            names = [n for n in part.schema.names if keep_text or n != "text"]
            yield pa.record_batch([*(part.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, *added])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    lang_pred is a learned language, or `und` with score 0 where the text is null or has no letter or nothing was
    learned. Rows with equal doc_id are predicted each by its own text; a null doc_id is not held out. Columns other
    than doc_id and text are not read. The model is broadcast; its size depends on the number of languages alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _predict(it, shared, ("lang_pred", "score")), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, min_score: float) -> DataFrame:
    """The rows of docs, all columns, whose text has a language by at least min_score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [f"predicted_{i}_{len(docs.columns)}_{'_'.join(docs.columns)}" for i in range(2)]  # clash with no column
    schema = StructType([*docs.schema, StructField(added[0], StringType()), StructField(added[1], DoubleType())])
    rows = docs.mapInArrow(lambda it: _predict(it, shared, added, True), schema)
    return rows.where((F.col(added[0]) != UNKNOWN) & (F.col(added[1]) >= min_score)).select(docs.columns)


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
