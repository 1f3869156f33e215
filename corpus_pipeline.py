"""A corpus pipeline: documents through quality rules, near-duplicate removal, decontamination, redaction and mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm import decontaminate, mixing, quality, secrets, simhash
from shoalgrid.llm.store import table, written

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def _key() -> Column:
    """What tells rows apart: the doc_id, null after all others, and a hash of the text, for ids that stand for several texts."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"))


def _only(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose key is (``left_anti``: is not) in the one column of ``keys``.

    Keys grow with the documents, so the join is by shuffle at every size.
    """
    keys = keys.toDF("__key").hint("merge")
    return docs.join(keys, _key() == F.col("__key"), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the rules keep, each judged for itself: equal rows alike, texts of one id, or of none, apart.

    Null, empty and blank texts are rejected; an empty table stays empty; the other columns, whatever their names, come along.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    return quality.judge(rows, id_col="row").filter("kept").select("doc_id.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates by five-word shingles: one with the smallest doc_id, of the least text hash if that has several texts.

    Rows without an id are documents like others; one stays where its component has no id. Null, empty and blank
    texts are near-duplicates of each other; of equal rows one stays; an empty table stays empty.
    """
    near = simhash.near_duplicates(docs.withColumn("__id", _key()), "__id", width=SHINGLE)
    firsts = near.filter("doc_id = component_id").groupBy("doc_id").count()
    firsts = written(firsts.select("doc_id", (F.col("count") > 1).alias("again")), "firsts")
    kept = _only(docs, firsts.filter("not again").select("doc_id"))
    if firsts.filter("again").limit(1).count():
        again = _only(docs, firsts.filter("again").select("doc_id")).withColumn("__id", F.xxhash64("text"))
        kept = kept.unionByName(again.dropDuplicates(["doc_id", "__id"]).drop("__id"))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, with an id or without; of texts of one id each by itself.

    Null and empty texts hold none; with an empty benchmark all rows stay; an empty table stays empty.
    """
    items = table(spark, sf_dir, "benchmark")
    leaks = written(decontaminate.contained(docs.withColumn("__id", _key()), items, id_col="__id").select("doc_id").distinct(), "leaks")
    return _only(docs, leaks, "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark; n_chars follows the text. Null texts stay null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each text: the columns of ``mixing.mix``, a row for each row of ``docs``.

    ``mixing.mix(docs, keep=["text"])`` returns the texts, too; carrying them moves each three times more.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing to target weights", mixing_to_weights),
]

#: SQL has no XXH64 and no expectation-maximisation; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as a table in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
