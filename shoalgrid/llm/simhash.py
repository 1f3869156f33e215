"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.llm.components import SALTS, connected_components
from shoalgrid.llm.store import in_slices, written

#: Variant buckets with more distinct fingerprints go by the other exact way instead of by pairs.
PAIR_BUCKET = 24
#: A fingerprint is cut into this many segments: of 2 differing bits one segment has at most one.
SEGMENTS = 2
SEGMENT_BITS = 64 // SEGMENTS


def simhash(text: bytes, width: int = 3) -> int:
    """64-bit fingerprint of UTF-8 bytes: a bit is 1 if set in over half the XXH64 (seed 42) of the word shingles."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint's 64 bits in a long. Null, empty and blank texts get 0."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in in_slices(batches):
            fps = np.array([simhash(t.as_py() or b"", width) for t in batch.column(1)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return ids.mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under the keys of its segments with one bit deleted, SEGMENTS * SEGMENT_BITS of them."""
    mask = F.lit((1 << SEGMENT_BITS) - 1).cast("long")
    keys = []
    for s in range(SEGMENTS):
        segment = F.shiftrightunsigned("fp", s * SEGMENT_BITS).bitwiseAND(mask)
        keys += [
            segment.bitwiseAND(F.lit(~(1 << b)).cast("long")).bitwiseOR(F.lit((s << 61) | (b << SEGMENT_BITS)).cast("long"))
            for b in range(SEGMENT_BITS)
        ]
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    return spread.select(F.explode(F.array(*keys)).alias("key"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect exactly those at 2 or fewer differing bits.

    Of two such fingerprints one segment differs at one bit at most, so they share a variant of it: an equality
    join on the variants finds the pair and a count of differing bits verifies it. A variant shared by more
    than ``PAIR_BUCKET`` fingerprints is left to another exact way that makes no pairs: two fingerprints are
    at 2 bits or fewer just if some word is at one bit or less from both, so each is listed under itself and
    its 64 one-bit neighbours, and those under one word (65 at most) are linked to the smallest of them.
    """
    variants = _variants(fps)
    crowded = variants.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = written(variants.join(crowded.hint("merge"), "key"), "buckets")
    few = crowded.filter(F.col("n") <= PAIR_BUCKET)
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    pairs = a.join(b.hint("merge"), "key").filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v")
    many = crowded.filter(F.col("n") > PAIR_BUCKET).select("fp").distinct()
    near = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    around = many.select("fp", F.explode(near).alias("bit")).select(F.col("fp").bitwiseXOR(F.col("bit")).alias("word"), "fp")
    stars = around.groupBy("word").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u != v")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links of 2 bits or fewer.

    Fingerprints of ``width``-word shingles are grouped first, so exact copies never meet as pairs. Rows of one
    fingerprint are dealt to many tasks by a salt, both to find their smallest id and to get their component.
    Both sides of each join grow with the documents, so all are by shuffle at every size: the driver holds none.

    Null, empty and blank texts have fingerprint zero and link like any other; equal rows each come back; a null id
    is returned and takes the component of its fingerprint (null if that has no id at all); other columns are
    ignored; no rows give none.
    """
    prints = fingerprints(docs, id_col, text_col, width)
    prints = written(prints.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "fingerprints")
    shares = written(prints.groupBy("fp", "salt").agg(F.min("doc_id").alias("first_id")), "shares")
    groups = written(shares.groupBy("fp").agg(F.min("first_id").alias("first_id")), "groups")
    roots = written(connected_components(links(groups.select("fp"))), "roots")
    rooted = groups.join(roots.hint("merge"), groups.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = rooted.withColumn("s", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    least = rooted.groupBy("root", "s").agg(F.min("first_id").alias("first_id"))
    least = least.select("root", "s", F.min("first_id").over(Window.partitionBy("root")).alias("component_id"))
    firsts = rooted.join(least.hint("merge"), ["root", "s"]).select("fp", "component_id")
    firsts = written(shares.select("fp", "salt").join(firsts.hint("merge"), "fp"), "components")
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(firsts.hint("merge"), ["fp", "salt"]).select("doc_id", fingerprint, "component_id")
