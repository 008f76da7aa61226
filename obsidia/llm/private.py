"""Personal data: spans of protected entities, and of terms that disclose them by corpus co-occurrence."""

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm.common import cut, hinted, store, table, text_slices

KINDS = ("email", "ip", "card", "phone", "term")
#: A term counts only if so few of the corpus's words, or fewer, are expected to share as many texts with an entity by chance.
CHANCE = 0.5
#: Share of an entity's information, -log p(entity), that a term may give, pointwise mutual information over it,
#: before it is generalised, and before it is removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Words, for terms: between white space and sentence marks, in either engine.
BREAK = r"""[ \t-\r.,;:!?()\[\]"']+"""

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match never starts inside a run of digits that failed as a whole, nor ends inside one, so looking behind and not
# giving back digits changes nothing but keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ \-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"""[^ \t-\r.,;:!?()\[\]"']+""")


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern's leftmost matches: a local part is the run of its characters before an @, from the last match on."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as in KINDS."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        at = text.find("+")
        while at >= 0:
            m = _PHONE.match(text, at)
            if m and 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
            at = text.find("+", m.end() if m else at + 1)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _entity(text: str, span) -> str:
    a, b, kind = span
    return f"{kind}:{text[a:b].lower() if kind == 'email' else re.sub('[^0-9.]', '', text[a:b])}"


def _words(text: str, spans) -> list[str]:
    """The distinct words of a text that may be terms: of three characters or more, where they touch no span."""
    out, i, reach = set(), 0, -1
    for m in _WORD.finditer(text):
        while i < len(spans) and spans[i][0] <= m.end():
            reach = max(reach, spans[i][1])
            i += 1
        if m.end() - m.start() > 2 and reach < m.start():
            out.add(m[0])
    return sorted(out)


def _held(batches):
    """Of texts that hold entities: digest, entities, and the words that may be terms."""
    for part in text_slices(batches):
        rows = []
        for copy, text in zip(part.column("copy").to_pylist(), part.column("text").to_pylist()):
            if spans := base_spans(text):
                rows.append((copy, sorted({_entity(text, s) for s in spans}), _words(text, spans)))
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.record_batch([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.list_(pa.string())) for c in cols[1:])], names=["copy", "entities", "words"])


def _share(n_term) -> F.Column:
    """Pointwise mutual information of a term and an entity over the entity's information."""
    return F.log(F.col("n") * F.col("n_docs") / (F.col("n_entity") * n_term)) / F.log(F.col("n_docs") / F.col("n_entity"))


def _by_chance(n_term, n_words) -> F.Column:
    """Log of a bound of how many of n_words words, in n_term texts each, share n texts with an entity by chance.

    If the entity's texts were drawn at random, n or more of them would hold the word with a probability of at most
    C(n_entity, n) * C(n_term, n) / C(n_docs, n) <= m ** n / n!, with m as below, as k * (k - 1) * ... (n factors) is at
    most (k - (n - 1) / 2) ** n and at least (k - n + 1) ** n; and n! >= sqrt(2 pi n) * (n / e) ** n.
    """
    n, half = F.col("n"), (F.col("n") - 1) / 2
    m = (F.col("n_entity") - half) * (n_term - half) / (F.col("n_docs") - n + 1)
    return F.log(n_words) + n * (F.log(m / n) + 1) - F.log(2 * math.pi * n) / 2


def _by_texts(rows: DataFrame, name: str, n: str) -> DataFrame:
    """rows (copy, name) with the texts that hold each name: their number n and, with it, a digest of their set."""
    every = rows.groupBy(name).agg(F.count("*").alias(n), *(F.bit_xor(F.xxhash64(F.lit(i), "copy")).alias(f"x{i}") for i in range(2)))
    return every.where(F.col(n) > 1).select(name, n, F.struct(n, "x0", "x1").alias(f"{name}_set"))


def _disclosing(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, entity_set) of the entities of two texts or more, and (entity_set, term, action).

    Entities of the same texts are one set, and so are words: texts of many entities and words pair only their sets.
    """
    docs = docs.select("text", F.xxhash64("text").alias("copy")).where("text is not null")
    held = store(docs.mapInArrow(_held, "copy long, entities array<string>, words array<string>").groupBy("copy").agg(F.any_value("entities").alias("entities"), F.any_value("words").alias("words")))
    copies = docs.groupBy("copy").agg(F.count("*").alias("times"))
    total = copies.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_docs"))
    in_text = held.select("copy", F.explode("entities").alias("entity"))
    entities = store(_by_texts(in_text, "entity", "n_entity").crossJoin(F.broadcast(total)).where("n_docs > n_entity"))
    risky = "entity_set struct<n_entity:bigint,x0:bigint,x1:bigint>, term string, action string"
    if entities.isEmpty():
        return entities.select("entity", "entity_set"), docs.sparkSession.createDataFrame([], risky)
    in_text = store(in_text.join(hinted(entities, 80 + F.length("entity")), "entity").select("copy", "entity_set", "n_entity", "n_docs").distinct())
    words = held.join(hinted(store(in_text.select("copy").distinct()), 16), "copy", "left_semi").select("copy", F.explode("words").alias("term"))
    n_words = words.agg(F.approx_count_distinct("term", 0.02).alias("n_words"))
    near = store(_by_texts(words, "term", "n_near"))
    sets = words.join(hinted(near, 64 + F.length("term")), "term").select("copy", "term_set", "n_near").distinct()
    # a term of n_near texts can share at most n_entity with an entity
    can = F.col("n_near") <= F.col("n_docs") ** (1 - GENERALISE) * F.col("n_entity") ** GENERALISE * (1 + 1e-9)
    both = in_text.join(sets, "copy").where(can).groupBy("entity_set", "term_set", "n_entity", "n_near", "n_docs").agg(F.count("*").alias("n")).where("n > 1")
    likely = (_share(F.col("n_near")) >= GENERALISE - 1e-9) & (_by_chance(F.col("n_near"), 0.9 * F.col("n_words")) <= math.log(CHANCE) + 1e-9)
    both = store(both.crossJoin(F.broadcast(n_words)).where(likely).drop("n_near", "n_words"))
    terms = store(near.join(hinted(store(both.select("term_set").distinct()), 64), "term_set", "left_semi").select("term", "term_set"))
    # each row of a text counts as its share of them, so that counts are partial before the shuffle: sums round to whole texts
    repeated = hinted(store(copies.where("times > 1")), 24)
    corpus = docs.join(repeated, "copy", "left").select((1 / F.coalesce("times", F.lit(1))).alias("part"), F.explode(F.array_distinct(F.split("text", BREAK))).alias("term"))
    counted = corpus.join(hinted(terms.select("term"), F.length("term") + 40), "term", "left_semi").groupBy("term").agg(F.sum("part").alias("n"))
    found = store(counted.select("term", F.round("n").cast("long").alias("n_term")))
    known = corpus.agg(F.approx_count_distinct("term", 0.02).alias("n_words"))
    scored = both.join(terms.join(found, "term"), "term_set").crossJoin(F.broadcast(known)).withColumn("share", _share(F.col("n_term")))
    scored = scored.where((F.col("share") >= GENERALISE) & (_by_chance(F.col("n_term"), F.col("n_words")) <= math.log(CHANCE)))
    return entities.select("entity", "entity_set"), store(scored.select("entity_set", "term", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("action")))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """entity, term, action: terms whose pointwise mutual information with the entity reaches the thresholds' share of
    the entity's information. Probabilities are document frequencies over the whole corpus, in which all documents with
    the same text are one; a term may stand anywhere in a document.

    A term counts if at most CHANCE of the corpus's words are expected to go with the entity as often by chance. One text
    in common is never evidence, as every word of it goes with its entities; two can be.

    A term's texts with entities bound its frequency from below, and the words of these texts the corpus's: terms
    which these already keep out, such as common words, are not counted in the corpus.
    """
    entities, risky = _disclosing(docs)
    return entities.join(risky, "entity_set").select("entity", "term", "action")


def _spans(batches, redact):
    for part in text_slices(batches):
        rows = []
        for doc, text, risky in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "risky"))):
            text = text or ""
            base = base_spans(text)
            action = {r["term"]: f"[{r['kind'].upper()} TERM]" if r["action"] == "generalise" else "" for r in risky or []}
            more = []
            if action:
                more = [(m.start(), m.end(), "term") for m in _WORD.finditer(text) if m[0] in action and not any(a < m.end() and m.start() < b for a, b, _ in base)]
            line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
            spans = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
            kinds = [k for *_, k in spans]
            clean = None
            if redact:
                clean, at = [], 0
                for a, b, kind in spans:
                    if b <= at:
                        continue
                    mark = f"[{kind.upper()}]" if kind != "term" else action[text[a:b]]
                    clean += [text[at : max(a, at)], mark]
                    at = b
                clean = "".join([*clean, text[at:]])
            rows.append((doc, *(kinds.count(k) for k in KINDS), hashlib.sha256(line(base).encode()).hexdigest(), line(spans), clean))
        cols = list(zip(*rows))
        kinds = [pa.int64()] * 6 + [pa.string()] * 3
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "clean_text"])


def _entities(batches):
    for part in text_slices(batches):
        out = {(d, _entity(t, s)) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) if t and d is not None for s in base_spans(t)}
        cols = list(zip(*out)) or [(), ()]
        yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names=["doc_id", "entity"])


def sanitise(docs: DataFrame, redact: bool = True) -> DataFrame:
    """Every row's spans, their numbers and, with redact, clean_text: base entities replaced by their kind, terms
    generalised to the least kind of entity that they disclose, as in [EMAIL TERM], or removed.

    Null texts count as empty and have no spans; a null doc_id keeps its base spans but gets no terms; rows with
    the same doc_id share their terms; copies of a text count once as evidence; other columns are
    not read; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    entities, risky = _disclosing(docs)
    if risky.isEmpty():
        joined = docs.withColumn("risky", F.lit(None).cast("array<struct<term:string,action:string,kind:string>>"))
    else:
        here = docs.mapInArrow(_entities, "doc_id long, entity string").join(hinted(entities, F.length("entity") + 60), "entity")
        here = here.select("doc_id", "entity_set", F.substring_index("entity", ":", 1).alias("kind")).distinct().join(hinted(risky, F.length("term") + 80), "entity_set")
        terms = here.groupBy("doc_id", "term").agg(F.max("action").alias("action"), F.min("kind").alias("kind"))
        terms = cut(terms.groupBy("doc_id").agg(F.collect_list(F.struct("term", "action", "kind")).alias("risky")))
        joined = docs.join(hinted(terms, 48 + 80 * F.size("risky")), "doc_id", "left")
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, clean_text string"
    return joined.select("doc_id", "text", "risky").mapInArrow(lambda it: _spans(it, redact), schema)


def op6_private_data(spark, sf_dir):
    return sanitise(table(spark, sf_dir, "documents"), redact=False).drop("clean_text")
