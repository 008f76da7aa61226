"""Benchmark decontamination with DataFrame functions only: size-partitioned MinHash containment search, then exact
shingle containment.

A document that holds an item has at least THRESHOLD of its shingles, so it misses few of them. Items are
partitioned by size, in powers of two. For a partition whose items have at most u shingles the sketch of an item is
its floor((1 - THRESHOLD) * u) + 1 least shingle hashes: a document that holds the item has one of them at least,
whatever its length, so bands of one row over these minima lose no item. (Signatures of the documents themselves would
have to see a 30-word item in 20,000 words, a Jaccard similarity near 0.001.)
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm.common import BROADCAST_BYTES, cut, hinted, store, table

WORDS, THRESHOLD = 5, 0.8
#: Words are runs of letters and digits, lower-cased.
BREAK = r"[^\p{L}\p{N}]+"


def shingled(df: DataFrame, key: str) -> DataFrame:
    """key and s, the word shingles of each text: one of all words if they are fewer, null without words.

    The words are a column of their own, so that they are split once for a text and not for each shingle.
    """
    words = df.select(key, F.filter(F.split(F.lower("text"), BREAK), lambda w: w != "").alias("w"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.greatest(F.size("w") - WORDS, F.lit(0))))
    # words by their places: slice() would copy the whole array for each shingle; concat_ws leaves out the nulls past the end
    return words.select(key, F.transform(starts, lambda i: F.concat_ws(" ", *(F.get("w", i + k) for k in range(WORDS)))).alias("s"))


def item_sketches(items: DataFrame) -> DataFrame:
    """item_id, s (distinct shingles), n (their number), sketch (the minima of the item's size partition), of items with words."""
    sets = shingled(items, "item_id").where("s is not null").groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("s").cast("double"))))
    least = F.floor((1 - THRESHOLD) * upper + 1e-9).cast("int") + 1
    order = F.array_sort(F.transform("s", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x"))))
    return sets.select("item_id", "s", F.size("s").alias("n"), F.transform(F.slice(order, 1, least), lambda e: e["x"]).alias("sketch"))


def candidates(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """doc_id, item_id: the pairs in which the document holds a shingle of the item's sketch."""
    rows = sketches.select(F.explode("sketch").alias("shingle"), "item_id")
    size = rows.agg(F.sum(F.length("shingle") * 2 + 48)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        keys = F.broadcast(rows.groupBy("shingle").agg(F.collect_list("item_id").alias("items")))
    else:  # many items: join them one by one, so that no list grows with the number of items that share a shingle
        keys = rows.select("shingle", F.array("item_id").alias("items"))
    # explode_outer: explode would have Spark filter on size(s) below, with the split inlined in every shingle
    found = shingled(docs, "doc_id").select("doc_id", F.explode_outer("s").alias("shingle"))
    return found.join(keys, "shingle").select("doc_id", F.explode("items").alias("item_id")).distinct()


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item: the pairs in which the document has at least THRESHOLD of the item's shingles.

    Sketches find the candidate pairs; only these are verified, on all shingles of either side.

    Null ids and texts are in no pair; texts without words neither; an item or document of one to four words is one
    shingle. Rows with the same doc_id are one document, with the same item_id one item, which have the shingles of all
    of them. Extra columns are not read. Empty tables give no rows.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    sketches = cut(item_sketches(items.where("item_id is not null").select("item_id", "text")))
    pairs = store(candidates(docs, sketches))
    held = docs.join(hinted(store(pairs.select("doc_id").distinct()), 16), "doc_id", "left_semi")
    both = shingled(held, "doc_id").join(pairs, "doc_id").join(hinted(sketches.select("item_id", "n", F.col("s").alias("item_s")), 64 * (1 + F.size("item_s"))), "item_id")
    both = both.select("doc_id", "item_id", "n", F.array_intersect("s", "item_s").alias("common"))
    shared = both.groupBy("doc_id", "item_id", "n").agg(F.size(F.array_distinct(F.flatten(F.collect_list("common")))).cast("long").alias("n_shared"))
    return shared.where(F.col("n_shared") >= F.ceil(THRESHOLD * F.col("n") - 1e-9)).select("doc_id", "item_id", "n_shared", F.col("n").cast("long").alias("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item. Every row is judged by its own text, so rows that share an id
    don't share a verdict. Rows with a null id or text stay."""
    key = F.when(docs["doc_id"].isNotNull() & docs["text"].isNotNull(), F.xxhash64(docs["text"]))
    bad = contamination(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("held")).distinct()
    return docs.join(bad, key == bad["held"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
with words as (
  select doc_id as id, 'd' as side, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w
  from documents where doc_id is not null and text is not null
  union all
  select item_id, 'i', list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')
  from benchmark where item_id is not null and text is not null),
s as (select distinct side, id, array_to_string(w[p : p + 4], ' ') as shingle
  from (select side, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from words where len(w) > 0)),
n as (select id, count(*) as n_item from s where side = 'i' group by 1)
select d.id as doc_id, i.id as item_id, count(*) as n_shared, n.n_item
from s d join s i on d.shingle = i.shingle and d.side = 'd' and i.side = 'i' join n on n.id = i.id
group by d.id, i.id, n.n_item having count(*) >= 0.8 * n.n_item
"""
