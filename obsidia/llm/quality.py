"""Quality rules whose limits follow the corpus: quantile sketches per language and source instead of fixed cutoffs."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsidia.llm.common import cut, table, text_slices

SYMBOLS = "[#*$%&|<>]"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: feature -> the least distance from a quartile that counts as an outlier where quartiles coincide
FEATURES = {"symbol_rate": 0.02, "upper_rate": 0.1, "mark_rate": 0.05, "stutter_rate": 0.05, "dup_line_rate": 0.1, "repeat_rate": 0.1, "mean_word": 1.0}
#: Features that may be too low as well.
BOTH_SIDES = ("mean_word",)
#: Quartile distances, the group's or the corpus's if greater, beyond a quartile where a limit lies; groups under MIN_GROUP
#: take the language's quartiles, then the corpus's.
SPREAD, MIN_GROUP = 4.0, 40
#: Sketches count values in buckets whose bounds grow by this factor (values under LEAST in one): quantiles are exact but for
#: 1 %, any two sketches merge by adding counts, and the same rows give the same sketch in whatever order they come.
GAMMA, LEAST = 1.02, 1e-4
SPACES = b" \t\n\x0b\x0c\r"
BASE = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long, n_marks long, n_stutters long"


def _classes() -> np.ndarray:
    """Bits of each code point: 1 symbol, 2 upper case, 4 letter, 8 exclamation or question mark, 16 white space of the word rule."""
    out = np.zeros(0x3000, dtype=np.uint8)
    for i in range(len(out)):
        c = chr(i)
        out[i] = (c in SYMBOLS[1:-1]) + 2 * c.isupper() + 4 * c.isalpha() + 8 * (c in "!?") + 16 * (i < 128 and i in SPACES)
    return out


def _repeats(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the words that stand in a WINDOW-word window found twice or more in it, and those equal to the word before."""
    n = np.array([len(w) for w in words], dtype=np.int64)
    total = int(n.sum())
    out, stutters = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    if total < WINDOW:
        return out, np.array([sum(a == b for a, b in zip(w, w[1:])) for w in words], dtype=np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), dtype=np.uint64, count=total)
    doc = np.repeat(np.arange(len(words), dtype=np.uint64), n)
    np.add.at(stutters, doc[1:][(ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])].astype(np.int64), 1)
    with np.errstate(over="ignore"):
        h = ids * np.uint64(0x9E3779B97F4A7C15) ^ (doc << np.uint64(40)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        roll = h
        for width in (1, 2, 4):  # doubling: WINDOW is 8
            roll = roll[:-width] * np.uint64(0x94D049BB133111EB) + roll[width:]
            roll = roll ^ (roll >> np.uint64(31))
    whole = doc[: len(roll)] == doc[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.argsort(roll[at], kind="stable")]
    same = roll[order[1:]] == roll[order[:-1]]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    mark = np.zeros(total + 1, dtype=np.int32)
    np.add.at(mark, order[twice], 1)
    np.add.at(mark, order[twice] + WINDOW, -1)
    np.add.at(out, doc[np.flatnonzero(np.cumsum(mark)[:-1] > 0)].astype(np.int64), 1)
    return out, stutters


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x and x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _measure(batches):
    classes = _classes()
    for part in text_slices(batches, limit=1 << 20):
        texts = [t or "" for t in part.column("text").to_pylist()]
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.cumsum([0, *map(len, texts)])
        bits = classes[np.minimum(codes, len(classes) - 1)]
        count = lambda bit: np.diff(np.concatenate([[0], np.cumsum((bits & bit) > 0, dtype=np.int64)])[ends])
        repeats, stutters = _repeats(words)
        cols = [np.array([len(w) for w in words], dtype=np.int64), np.diff(ends) - count(16), count(1), np.array([_dup_lines(t) for t in texts], dtype=np.int64), repeats, count(2), count(4), count(8), stutters]
        names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_stutters"]
        yield pa.record_batch([*(part.column(c) for c in names[:3]), *(pa.array(c, pa.int64()) for c in cols)], names=names)


def measures(docs: DataFrame) -> DataFrame:
    """The base measures of every row and base_failed. Windows are compared by 64-bit hashes within one text."""
    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(_measure, BASE)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.withColumns({"base_failed": failed, "symbol_rate": rate("n_symbols", "word_chars"), "upper_rate": rate("n_upper", "n_letters"), "mark_rate": rate("n_marks", "n_words"), "stutter_rate": rate("n_stutters", "n_words"), "dup_line_rate": rate("n_dup_lines", "n_words") * 10, "repeat_rate": rate("n_repeat_words", "n_words"), "mean_word": rate("word_chars", "n_words")})


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, feature, bucket, n: the quantile sketches of the rows that pass the base rules, counted before the shuffle."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in FEATURES))).alias("e")
    bucket = F.when(F.col("e.v") < LEAST, F.lit(None)).otherwise(F.ceil(F.log(F.col("e.v")) / math.log(GAMMA)))
    values = rows.where("not base_failed").select("lang", "source", each).select("lang", "source", "e.feature", bucket.cast("int").alias("bucket"))
    return values.groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, feature, n, q25, q75 of sketches merged over all but keys."""
    merged = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    every = W.partitionBy(*keys, "feature")
    below = merged.withColumn("total", F.sum("n").over(every)).withColumn("upto", F.sum("n").over(every.orderBy(F.col("bucket").asc_nulls_first())))
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (1 + GAMMA)), F.lit(0.0))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    return below.groupBy(*keys, "feature").agg(F.max("total").alias("n"), at(0.25).alias("q25"), at(0.75).alias("q75"))


def limits(rows: DataFrame) -> DataFrame:
    """lang, source and, for each feature, its least and greatest value that is no outlier.

    Sketches are built per language and source and merged to those of languages and of the corpus, which stand in for
    groups under MIN_GROUP rows.
    """
    sketch = cut(sketches(rows))
    floor = F.element_at(F.create_map(*(F.lit(x) for pair in FEATURES.items() for x in pair)), F.col("feature"))
    corpus = quartiles(sketch).select("feature", F.col("q25").alias("c25"), F.col("q75").alias("c75"), floor.alias("floor"))
    by_lang = quartiles(sketch, "lang").select("lang", "feature", F.col("n").alias("ln"), F.col("q25").alias("l25"), F.col("q75").alias("l75"))
    group = quartiles(sketch, "lang", "source")
    # at most a row for each feature: the join by feature alone is with len(FEATURES) rows
    every = rows.select("lang", "source").distinct().withColumn("one", F.lit(1)).join(F.broadcast(corpus.withColumn("one", F.lit(1))), "one")
    joined = every.alias("e").join(group.alias("g"), F.col("e.lang").eqNullSafe(F.col("g.lang")) & F.col("e.source").eqNullSafe(F.col("g.source")) & (F.col("e.feature") == F.col("g.feature")), "left")
    joined = joined.join(by_lang.alias("l"), F.col("e.lang").eqNullSafe(F.col("l.lang")) & (F.col("e.feature") == F.col("l.feature")), "left")
    pick = lambda q: F.when(F.col("g.n") >= MIN_GROUP, F.col(f"g.q{q}")).when(F.col("ln") >= MIN_GROUP, F.col(f"l{q}")).otherwise(F.col(f"c{q}"))
    joined = joined.select("e.lang", "e.source", "e.feature", "floor", pick(25).alias("lo"), pick(75).alias("hi"), "c25", "c75")
    room = F.greatest(SPREAD * (F.col("hi") - F.col("lo")), SPREAD * (F.col("c75") - F.col("c25")), "floor")
    least = lambda f: F.max(F.when(F.col("feature") == f, F.col("lo") - room)).alias(f"least_{f}")
    most = lambda f: F.max(F.when(F.col("feature") == f, F.col("hi") + room)).alias(f"limit_{f}")
    return joined.groupBy("lang", "source").agg(*map(most, FEATURES), *map(least, BOTH_SIDES))


def quality(docs: DataFrame) -> DataFrame:
    """Every row with its measures, base_failed, the first rule that it breaks (`reason`, null if none) and kept.

    A row is kept if it passes the base rules and no feature lies beyond the limits of its language and source. Equal
    tables give equal results, whatever their partitions. Null
    and empty texts have no words and fail; null languages and sources are groups of their own; rows with equal
    ids are judged each; other columns are not read; an empty table gives no rows.
    """
    rows = cut(measures(docs))
    joined = rows.alias("r").join(limits(rows).alias("t"), F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source")), "left")
    above = [F.when(F.col(f"r.{f}") > F.col(f"t.limit_{f}"), F.lit(f)) for f in FEATURES]
    below = [F.when(F.col(f"r.{f}") < F.col(f"t.least_{f}"), F.lit(f)) for f in BOTH_SIDES]
    reason = F.coalesce(F.when(F.col("base_failed"), F.lit("base")), *above, *below)
    return joined.select("r.*", reason.alias("reason"), reason.isNull().alias("kept"))


def op2_quality_rules(spark, sf_dir):
    rows = quality(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")
