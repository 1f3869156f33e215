"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.llm.store import single_value, words, written

#: Rows of item shingles that are broadcast at a time (about 100 bytes each); more items take more passes over the documents.
BLOCK_ROWS = 100_000


def _shingles(text: Column, width: int) -> Column:
    """A text's word shingles in lower case, in order; the whole sequence if there are fewer words; none without words."""
    w = words(F.lower(text))

    def of(x: Column) -> Column:
        short = F.when(F.size(x) > 0, F.array(F.array_join(x, " "))).otherwise(F.array().cast("array<string>"))
        places = F.sequence(F.lit(0), F.size(x) - width)
        long = F.transform(places, lambda i: F.concat_ws(" ", *[F.get(x, i + k) for k in range(width)]))
        return F.when(F.size(x) < width, short).otherwise(long)

    return F.element_at(F.transform(F.array(w), of), 1)


def sketches(items: DataFrame, width: int, least: float) -> DataFrame:
    """(item, h, shingle, at, n, size_class, in_sketch): each item's distinct shingles by hash, and which are in its MinHash sketch.

    Items are partitioned by size (powers of two). In a class of sizes up to ``u`` the sketch has the
    floor((1 - least) * u) + 1 smallest hashes of an item: a document that lacks all of these lacks more than the
    share 1 - ``least`` of the item, so a search by sketch misses nothing.
    """
    rows = items.select("item_id", F.explode(_shingles(F.col("text"), width)).alias("shingle"))
    pair = F.struct(F.xxhash64("shingle").alias("h"), "shingle")
    sets = rows.groupBy("item_id").agg(F.sort_array(F.collect_set(pair)).alias("pairs"))
    size_class = F.ceil(F.log2(F.size("pairs").cast("double")))
    keep = F.floor(F.lit(1 - least) * F.pow(F.lit(2.0), F.col("size_class")) + 1e-9).cast("int") + 1
    sets = sets.withColumn("size_class", size_class)
    rows = sets.select(F.col("item_id").alias("item"), F.posexplode("pairs").alias("at", "pair"), F.size("pairs").alias("n"), "size_class", keep.alias("keep"))
    return rows.select("item", "pair.h", "pair.shingle", "at", "n", "size_class", (F.col("at") < F.col("keep")).alias("in_sketch"))


def _in_blocks(rows: DataFrame, found) -> DataFrame:
    """The union of ``found(block)`` over broadcast blocks of ``rows``, about BLOCK_ROWS each; rows are counted first, and dealt by hash."""
    blocks = max(1, -(-single_value(rows, F.count("*"))[0] // BLOCK_ROWS))
    dealt = F.pmod(F.xxhash64("h", "item"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [found(F.broadcast(rows.filter(dealt == k))) for k in range(blocks)])


def contained(
    docs: DataFrame, items: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_shingles, containment) of documents that hold an item.

    Containment is the share of the item's distinct ``width``-word shingles (lower case) that are in the document,
    at least ``least``. A document's sketch are its shingles of hash up to the largest in any item's sketch, so none
    that could meet one is left out; the sketches of the items come in blocks of bounded size and are broadcast, so
    documents aren't shuffled. The documents found are read again and verified by all the item's shingles, word for
    word. An item or a document of fewer words is one shingle.

    Null and empty texts match nothing; equal rows give one pair; null ids of documents or items are left out; other columns are ignored.
    """
    items = items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL")
    marked = written(sketches(items, width, least), "sketches")
    sketch = marked.filter("in_sketch").select("h", "item")
    (bound,) = single_value(sketch, F.max("h"))
    shingled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    shingles = F.explode(_shingles(F.col("text"), width)).alias("shingle")
    hashed = shingled.select("doc_id", shingles).select("doc_id", F.xxhash64("shingle").alias("h"))
    hashed = hashed.filter(F.col("h") <= F.lit(bound).cast("long"))
    found = _in_blocks(sketch, lambda block: hashed.join(block, "h").groupBy("doc_id", "item").count().select("doc_id", "item"))
    found = written(found.distinct(), "candidates")
    ids = found.select(F.col("doc_id").alias("k")).distinct()
    again = shingled.join(ids, shingled.doc_id == ids.k, "left_semi").select("doc_id", shingles).withColumn("h", F.xxhash64("shingle"))
    whole = marked.select("h", "item", "n", "at", F.col("shingle").alias("own"))
    pairs = _in_blocks(whole, lambda block: again.join(block, "h").filter("shingle = own").select("doc_id", "item", "n", "at").distinct())
    shared = pairs.groupBy("doc_id", "item", "n").agg(F.count_distinct("at").alias("n_shared"))
    return (
        shared.join(found, ["doc_id", "item"], "left_semi")
        .filter(F.col("n_shared") >= F.col("n") * F.lit(float(least)) - 1e-9)
        .select("doc_id", F.col("item").alias("item_id"), "n_shared", F.col("n").cast("long").alias("n_shingles"), (F.col("n_shared") / F.col("n")).alias("containment"))
    )


CONTAINED_SQL = r"""
WITH dw AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i : array_to_string(w[i : i + 4], ' '))) AS s FROM dw WHERE len(w) > 0),
iset AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i : array_to_string(w[i : i + 4], ' '))) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM iset GROUP BY id)
SELECT ds.id AS doc_id, iset.id AS item_id, count(*) AS n_shared, any_value(n.n) AS n_shingles,
       CAST(count(*) AS DOUBLE) / any_value(n.n) AS containment
FROM ds JOIN iset ON ds.s = iset.s JOIN n ON n.id = iset.id
GROUP BY ds.id, iset.id HAVING count(*) >= 0.8::DOUBLE * any_value(n.n) - 1e-9
"""
