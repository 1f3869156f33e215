"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.llm.store import written

#: Labelled documents, about, that the chain is fitted on.
TRAIN_DOCS = 12_000
FEATURES = 1 << 15
#: Partitions that the bounded sample is fitted in: sums of more than 5 take another stage in each iteration.
TRAIN_PARTITIONS = 4
FOLDS = 2
#: Best threshold for out-of-fold predictions on the given labels: 0.19 of about 12,000 rows.
THRESHOLD = 0.2
#: Absolute penalty of models fitted on TRAIN_DOCS rows: few of the terms count. It grows as 1 / sqrt(rows), the rate of
#: the noise in a term's gradient, so that a smaller sample doesn't leave a fit with terms that only separate its own rows.
PENALTY = 1e-4
#: Iterations that a fit may take; one that has not converged then is an error.
MOST_ITERATIONS = 500
#: Category: SQL over the labels, in the order of the chain. The labels hold two categories, and only the second is one of toxicity.
CATEGORIES: Mapping[str, str] = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


#: Lengths of the word beginnings that count as terms.
STARTS = (5, 7)


def terms(text: Column) -> Column:
    """Distinct words of a text in lower case, and their beginnings, each as often as words begin so."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    words = F.array_distinct(F.filter(words, lambda w: w != ""))
    starts = [
        F.transform(F.filter(words, lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.lit(f"{k}:"), F.substring(w, 1, k)))
        for k in STARTS
    ]
    return F.concat(words, *starts)


def _features(docs: DataFrame) -> DataFrame:
    tf = HashingTF(inputCol="terms", outputCol="counts", numFeatures=FEATURES)
    counted = tf.transform(docs.withColumn("terms", terms(F.col("text")))).drop("text", "terms")
    return Normalizer(inputCol="counts", outputCol="hashed").transform(counted).drop("counts")


class Chain:
    """Linear models of categories in order; each sees the text and the probabilities of the categories before it."""

    def __init__(self, names: list[str], models: list[LogisticRegressionModel | float]):
        """A number stands for a model where all labelled rows agree."""
        self.names, self.models = names, models

    @staticmethod
    def _assembled(rows: DataFrame, before: list[str]) -> DataFrame:
        if not before:
            return rows.withColumn("features", F.col("hashed").alias("features", metadata={}))
        plain = rows.withColumn("hashed", F.col("hashed").alias("hashed", metadata={}))
        sized = VectorSizeHint(inputCol="hashed", size=FEATURES, handleInvalid="optimistic").transform(plain)
        # Probabilities as small as a term of a normalised text is, or the search along a line takes many steps.
        for b in before:
            sized = sized.withColumn(f"small_{b}", F.col(f"p_{b}") / 16)
        small = [f"small_{b}" for b in before]
        out = VectorAssembler(inputCols=["hashed", *small], outputCol="features").transform(sized).drop(*small)
        # A description of every hashed term would travel with each plan.
        return out.withColumn("features", F.col("features").alias("features", metadata={}))

    @classmethod
    def _predicted(cls, rows: DataFrame, model: LogisticRegressionModel | float, name: str, before: list[str]) -> DataFrame:
        if isinstance(model, float):
            return rows.withColumn(f"p_{name}", F.lit(model))
        out = model.transform(cls._assembled(rows, before))
        return out.withColumn(f"p_{name}", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    @classmethod
    def _fitted(cls, rows: DataFrame, name: str, before: list[str]) -> LogisticRegressionModel | float:
        kinds = {r[0]: r[1] for r in rows.groupBy(f"y_{name}").count().collect()}
        if len(kinds) < 2:
            return float(*kinds) if kinds else 0.0
        penalty = PENALTY * math.sqrt(TRAIN_DOCS / sum(kinds.values()))
        lr = LogisticRegression(featuresCol="features", labelCol=f"y_{name}", maxIter=MOST_ITERATIONS, tol=1e-3, regParam=penalty, elasticNetParam=1.0, standardization=False)
        # The assembler describes every hashed term in its plan, which every iteration's tasks would carry: the fit reads a table.
        model = lr.fit(written(cls._assembled(rows, before), "assembled") if before else cls._assembled(rows, before))
        if model.summary.totalIterations >= MOST_ITERATIONS:
            raise RuntimeError(f"the model of {name} did not converge in {MOST_ITERATIONS} iterations")
        return model

    @classmethod
    def fit(cls, rows: DataFrame, names: list[str], folds: int = FOLDS, last: bool = True) -> tuple[Chain, DataFrame]:
        """The chain, and ``rows`` with out-of-fold p_<name> (of the last category, too, if ``last``); rows: doc_id, hashed, and y_<name> (0.0 or 1.0) for each category.

        What a later category's model learns from of an earlier one are out-of-fold predictions: each document's by
        a model fitted on the other folds, as good and as bad as those of unseen documents will be.
        """
        rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(folds)))
        models: list[LogisticRegressionModel | float] = []
        for k, name in enumerate(names):
            before = names[:k]
            models.append(cls._fitted(rows, name, before))
            if k + 1 == len(names) and not last:
                break
            parts = [cls._predicted(rows.filter(F.col("fold") == f), cls._fitted(rows.filter(F.col("fold") != f), name, before), name, before) for f in range(folds)]
            rows = written(reduce(DataFrame.unionByName, parts).coalesce(TRAIN_PARTITIONS), "chain")
        return cls(names, models), rows

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with p_<name> for each category."""
        for k, (name, model) in enumerate(zip(self.names, self.models)):
            rows = self._predicted(rows, model, name, self.names[:k])
        return rows


def best_threshold(rows: DataFrame, name: str) -> float:
    """The probability, in hundredths, from which on calling a document ``name`` has the largest F1 over out-of-fold predictions; 0.5 if none is."""
    counts = rows.groupBy(F.floor(F.col(f"p_{name}") * 100).cast("int").alias("at")).agg(F.sum(f"y_{name}").alias("hits"), F.count("*").alias("n"))
    found = sorted((r["at"], r["hits"], r["n"]) for r in counts.collect())
    total = sum(h for _, h, _ in found)
    scores = [(2 * sum(h for x, h, _ in found if x >= at) / max(1, total + sum(n for x, _, n in found if x >= at)), -at) for at in range(1, 100)]
    best = max(scores)
    return -best[1] / 100 if best[0] > 0 else 0.5


def classify(
    docs: DataFrame,
    labels: DataFrame,
    categories: Mapping[str, str] = CATEGORIES,
    train_docs: int = TRAIN_DOCS,
    threshold: float | None = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, p_<category> for each category and ``toxic`` (the last category's probability is ``threshold`` or more).

    Fits a classifier chain on about ``train_docs`` labelled documents, those of least hash of the id, and predicts
    every whole text. A threshold of None asks for the best one for out-of-fold predictions, with a fit more for each fold. Rows of ``labels`` with
    a null id or null in a category are not used; an id labelled twice takes the largest label, and other columns of
    theirs are ignored. Of documents of one id each learns that label.

    Null texts and those without a word get probability 0; with nothing to learn from all get 0; equal rows are
    predicted alike; null ids are predicted but not learned from; other columns are ignored.
    """
    names = list(categories)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = labels.select(F.col("doc_id").alias("id"), *[F.expr(sql).cast("double").alias(f"y_{name}") for name, sql in categories.items()])
    marked = marked.dropna().groupBy("id").agg(*[F.max(f"y_{name}").alias(f"y_{name}") for name in names])
    n = marked.count()
    place = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    marked = written(marked.filter(place < min(1.0, train_docs / max(1, n))), "labels")
    # The sample is bounded by train_docs, so it goes to the documents and these stay where they are.
    learned = rows.join(F.broadcast(marked), rows.doc_id == marked.id).drop("id").filter("text IS NOT NULL")
    sample = written(_features(learned), "toxicity")
    chain, unseen = Chain.fit(written(sample.repartition(TRAIN_PARTITIONS), "toxicity"), names, last=threshold is None)
    if threshold is None:
        threshold = best_threshold(unseen, names[-1])
    out = chain.predict(_features(rows.withColumn("blank", ~F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False)))))
    out = out.select("doc_id", *[F.when(F.col("blank"), 0.0).otherwise(F.col(f"p_{name}")).alias(f"p_{name}") for name in names])
    return out.withColumn("toxic", F.col(f"p_{names[-1]}") >= threshold)
