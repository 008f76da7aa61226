"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration of their margins."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm.common import drop, hinted, store, table, text_slices
from obsidia.llm.language import held_out

#: About so many labelled rows, chosen by a hash of their ids, are learned from; all of them where there are fewer.
TRAIN_ROWS = 20_000
#: Entries of the learned lexicon at most: words, and stems (the first letters of longer words) of these lengths.
LEXICON, STEMS = 20_000, (3, 4, 5, 6)
#: An entry multiplies the odds of a toxic text by e^MIN_WEIGHT or more, in MIN_TEXTS toxic texts at least.
MIN_WEIGHT, MIN_TEXTS = 1.5, 3
#: Words between a lexicon hit and a second person that count as near.
NEAR = 5
TREES, DEPTH, THRESHOLD = 20, 3, 0.7
#: One row in FOLDS calibrates, the others grow trees. Trees see bounded rows, so few tasks hold them.
FOLDS, TASKS = 4, 4
#: A worker remembers what it found out about at most so many chunks, of 64 characters or less.
CACHE = 200_000

#: Second persons in English, German, French and Spanish.
YOU = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner deines ihr euch euer eure tu te toi ton ta tes vous votre vos usted ustedes ti contigo tuyo tuya vosotros".split()
)
#: Characters that stand in for letters in obfuscated words.
LEET = str.maketrans("013457@$!|", "oieastasil")
#: What commonly stands around a word.
MARKS = ".,;:!?\"'()[]#*$%&|<>-"
_CORE = re.compile(r"[\W_]*([^\W_](?:.*[^\W_])?)", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")
_STRETCH = re.compile(r"([^\W\d_])\1\1+")
FEATURES = (
    "lexicon_rate", "lexicon_weight", "lexicon_max", "lexicon_hits", "lexicon_kinds", "near_you_rate", "near_you_share", "you_rate",
    "capital_rate", "shout_rate", "mark_rate", "symbol_rate", "obfuscated_rate", "obfuscated_hits", "stretch_rate", "words",
)


def core(chunk: str) -> str:
    """A chunk between white space in lower case, without the marks at its ends."""
    m = _CORE.match(chunk.lower())
    return m[1] if m else ""


def entries(word: str) -> list[str]:
    """The lexicon entries that a word of letters may match: itself and its stems, which end in *."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def text_entries(text: str) -> set[str]:
    return {e for c in set(text.split()) for w in _LETTERS.findall(core(c)) for e in entries(w)}


class Lexicon:
    """What each chunk says: weight of its entry (0: none), and counts of marks."""

    def __init__(self, weights: dict[str, float]):
        self.words = {e: w for e, w in weights.items() if not e.endswith("*")}
        self.stems = {e[:-1]: w for e, w in weights.items() if e.endswith("*")}
        self.known: dict[str, tuple] = {}

    def weight(self, word: str) -> float:
        """The greatest weight of the entries of a word; stems count for longer words only."""
        best, n = self.words.get(word, 0.0), len(word)
        for k in STEMS:
            if k < n and (w := self.stems.get(word[:k], 0.0)) > best:
                best = w
        return best

    def look(self, chunk: str) -> tuple:
        """(weight, second person, upper, letters, shouted, !?, other symbols, obfuscated, hit only without obfuscation, stretched)"""
        if chunk in self.known:
            return self.known[chunk]
        inner = chunk.strip(MARKS)
        if not inner.isalpha() or not inner.lower().isalpha():
            found = self._mixed(chunk)
        elif inner == chunk:
            found = self._plain(chunk)
        else:
            outer = len(chunk) - len(inner)
            marks = chunk.count("!") + chunk.count("?")
            found = (*self.look(inner)[:5], marks, outer - marks, *self.look(inner)[7:])
        if len(chunk) <= 64:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[chunk] = found
        return found

    def _plain(self, chunk: str) -> tuple:
        """`_mixed` for a chunk of letters alone."""
        c, n = chunk.lower(), len(chunk)
        plain = self.weight(c)
        hidden, stretched = 0.0, len(set(c)) < len(c) - 1 and _STRETCH.search(c) is not None
        if stretched:
            hidden = self.weight(_STRETCH.sub(r"\1", c))
        upper = 0 if c == chunk else sum(map(str.isupper, chunk))
        return (max(plain, hidden), c in YOU, upper, n, n > 2 and upper == n, 0, 0, False, plain == 0 < hidden, stretched)

    def _mixed(self, chunk: str) -> tuple:
        c = core(chunk)
        plain = max((self.weight(w) for w in _LETTERS.findall(c)), default=0.0)
        letters = [x for x in chunk if x.isalpha()]
        upper = sum(map(str.isupper, letters))
        obfuscated, hidden = bool(c) and not c.isalpha() and any(map(str.isalpha, c)), 0.0
        if obfuscated:
            # stand-ins at the ends of a word are part of it as well
            for form in (c, chunk.lower()):
                hidden = max(hidden, self.weight("".join(x for x in form.translate(LEET) if x.isalpha())))
        stretched = _STRETCH.search(c) is not None
        if stretched:
            hidden = max(hidden, self.weight(_STRETCH.sub(r"\1", c)))
        symbols = sum(not x.isalnum() for x in chunk)
        marks = chunk.count("!") + chunk.count("?")
        return (max(plain, hidden), c in YOU, upper, len(letters), len(letters) > 2 and upper == len(letters), marks, symbols - marks, obfuscated, plain == 0 < hidden, stretched)

    def measure(self, texts: list[str]) -> np.ndarray:
        """(texts, FEATURES)"""
        number: dict[str, int] = {}
        chunks = [t.split() for t in texts]
        n = np.array([len(c) for c in chunks], dtype=np.int64)
        at = np.fromiter((number.setdefault(c, len(number)) for cs in chunks for c in cs), dtype=np.int64, count=int(n.sum()))
        facts = np.array([self.look(c) for c in number], dtype=np.float64).reshape(-1, 10)[at]
        doc = np.repeat(np.arange(len(texts)), n)
        total = lambda values: np.bincount(doc, values, len(texts))
        hit = facts[:, 0] > 0
        you = np.flatnonzero(facts[:, 1])
        hits = np.flatnonzero(hit)
        near = np.zeros(len(at), dtype=bool)
        if len(you) and len(hits):
            place = np.searchsorted(you, hits)
            for other in (you[np.minimum(place, len(you) - 1)], you[np.maximum(place - 1, 0)]):
                near[hits] |= (np.abs(other - hits) <= NEAR) & (doc[other] == doc[hits])
        pairs = np.unique(np.stack([doc[hits], at[hits]]), axis=1)
        kinds = np.bincount(pairs[0], minlength=len(texts))
        most = np.zeros(len(texts))
        np.maximum.at(most, doc, facts[:, 0])
        words, n_hits, letters = np.maximum(n, 1), total(hit), np.maximum(total(facts[:, 3]), 1)
        size = np.maximum([len(t) for t in texts], 1)
        columns = (
            n_hits / words, total(facts[:, 0]) / words, most, np.log1p(n_hits), np.log1p(kinds), total(near) / words, total(near) / np.maximum(n_hits, 1), total(facts[:, 1]) / words,
            total(facts[:, 2]) / letters, total(facts[:, 4]) / words, total(facts[:, 5]) / words, total(facts[:, 6]) / size, total(facts[:, 7]) / words, total(facts[:, 8]) / words, total(facts[:, 9]) / words, np.log1p(n),
        )
        return np.stack(columns, axis=1)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, toxic, calibrates: about `most` labelled rows that are not held out, chosen by a hash of doc_id.

    Only ids of docs with a text count. Repeated labels of a doc_id are one, toxic if any is; null labels are none.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
    known = known.where(~held_out()).join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi")
    known = store(known.select("doc_id", "toxic", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(1 << 30)).alias("h")))
    n = known.count()
    chosen = known.where(F.col("h") < math.ceil((1 << 30) * most / n)) if n > most else known
    return chosen.select("doc_id", "toxic", (F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(FOLDS)) == 0).alias("calibrates"))


def _evidence(batches):
    """entry, n, k: how many texts of a task hold an entry, and how many toxic ones; in parts of bounded size."""
    n, k = Counter(), Counter()

    def flush():
        found = list(n)
        return pa.record_batch([pa.array(found, pa.string()), pa.array([n[e] for e in found], pa.int64()), pa.array([k[e] for e in found], pa.int64())], names=["entry", "n", "k"])

    for part in text_slices(batches):
        for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
            found = text_entries(text)
            n.update(found)
            if toxic:
                k.update(found)
        if len(n) > 500_000:
            yield flush()
            n, k = Counter(), Counter()
    yield flush()


def learn_lexicon(rows: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """entry -> weight, the log of how much it multiplies the odds, from rows (text, toxic).

    An entry in n texts, k of them toxic, counts if chance explains so many with a probability of at most one in the
    number of entries looked at: n * KL(k/n, share of toxic texts) >= log(entries), by Chernoff's bound. Of more than
    `most` entries those of the greatest evidence stay.
    """
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    if not 0 < size["k"] < size["n"]:
        return {}
    share = size["k"] / size["n"]
    scratch: list = []
    counts = rows.select("text", "toxic").mapInArrow(_evidence, "entry string, n long, k long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    counts = store(counts.where(F.col("k") >= MIN_TEXTS), scratch)
    tried = max(counts.count(), 2)
    p = F.col("k") / F.col("n")
    bits = F.col("k") * F.log(p / share) + F.when(F.col("k") < F.col("n"), (F.col("n") - F.col("k")) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    weight = F.log((F.col("k") + 0.5) / (F.col("n") - F.col("k") + 0.5)) - math.log(share / (1 - share))
    good = counts.select("entry", bits.alias("bits"), weight.alias("weight")).where((F.col("bits") >= math.log(tried)) & (F.col("weight") >= MIN_WEIGHT))
    found = {r["entry"]: r["weight"] for r in good.orderBy(F.col("bits").desc(), "entry").limit(most).collect()}
    drop(scratch)
    return found


def _measure(batches, shared):
    lexicon = Lexicon(shared.value)
    for part in text_slices(batches, limit=1 << 20):
        found = lexicon.measure([t or "" for t in part.column("text").to_pylist()])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(FEATURES), pa.int32()), pa.array(found.ravel()))
        yield pa.record_batch([part.column("doc_id"), lists], names=["doc_id", "features"])


def measures(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """doc_id, features (an array in the order of FEATURES) of every row; the lexicon is broadcast, LEXICON entries at most."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _measure(it, shared), "doc_id long, features array<double>")


def score(rows: DataFrame, training: DataFrame) -> DataFrame:
    """rows (doc_id, features, ..) with score, from 0 to 1: boosted trees over training (features, toxic, calibrates), whose
    margins are mapped to shares of toxic rows by isotonic regression over the calibrating rows.

    If the calibrating rows, or the others, are all of one class, trees and calibration both take all rows; where all
    training rows are of one class, or there is none, every row gets their smoothed share (0.5 without any).
    """
    scratch: list = []
    rows = rows.withColumn("v", array_to_vector("features"))
    training = store(training.select("features", F.col("toxic").cast("double").alias("label"), "calibrates").coalesce(TASKS), scratch)
    training = training.withColumn("v", array_to_vector("features"))
    n = {r["calibrates"]: (r["n"], r["k"]) for r in training.groupBy("calibrates").agg(F.count("*").alias("n"), F.sum("label").alias("k")).collect()}
    total, toxic = (sum(x) for x in zip((0, 0), *n.values()))
    if not 0 < toxic < total:
        drop(scratch)
        return rows.drop("v").withColumn("score", F.lit((toxic + 0.5) / (total + 1)))
    both = all(0 < k < m for m, k in (n.get(c, (0, 0)) for c in (False, True)))
    grows, fits = (training.where("not calibrates"), training.where("calibrates")) if both else (training, training)
    trees = GBTClassifier(featuresCol="v", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=2, seed=12).fit(grows)
    margin = lambda df: trees.transform(df).withColumn("margin", F.get(vector_to_array("rawPrediction"), F.lit(1))).drop("rawPrediction", "prediction", "probability", "v")
    fitted = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(margin(fits).select("margin", "label"))
    drop(scratch)
    scored = fitted.transform(margin(rows)).drop("margin")
    return scored.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, features, score and predicted (1 if score >= threshold) of every row of docs.

    A lexicon of words and stems is learned from labelled rows that are not held out; trees over lexicon densities, nearness
    to second persons, capitals, marks and obfuscation are grown on three quarters of these rows and calibrated on the last.
    Ids only decide which rows are learned from. Null texts count as empty and get the score of a text without words;
    null ids are not held out; rows with equal ids are scored each by its own text, and learned from each; other columns are
    not read. An empty table gives no rows; without labels every score is 0.5.
    """
    docs = docs.select("doc_id", "text")
    scratch: list = []
    chosen = hinted(store(training_rows(docs, labels), scratch), 16)
    lexicon = learn_lexicon(docs.where("text is not null").join(chosen, "doc_id"))
    rows = store(measures(docs, lexicon))
    scored = score(rows, rows.join(chosen, "doc_id"))
    drop(scratch)
    return scored.select("doc_id", held_out().alias("held_out"), "features", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op12_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("features")
