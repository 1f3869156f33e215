"""Depth models: fitting, folds, prediction and fusion on MLlib."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.operators.bootstrap import poisson
from shoalgrid.operators.metrics import regression_metrics
from shoalgrid.sources.shared import written

#: Models of squared error without bootstrap: all they read of the labels beside equal features is count, sum and sum of squares.
BY_MOMENTS = ("linear", "ridge", "lasso", "elastic_net", "tree", "boosted")
#: Fits that the driver has under way at once; each is a row of small jobs.
FITS = 4
#: Trees of a forest.
TREES = 20


def registry(label: str = "depth", weight: str | None = None, seed: int = 42) -> dict:
    """Regressors by name."""
    own = {"labelCol": label, "featuresCol": "features", "predictionCol": "y_pred"} | ({"weightCol": weight} if weight else {})
    return {
        "linear": LinearRegression(**own),
        "ridge": LinearRegression(**own, regParam=0.1),
        "lasso": LinearRegression(**own, regParam=0.05, elasticNetParam=1.0),
        "elastic_net": LinearRegression(**own, regParam=0.05, elasticNetParam=0.5),
        "huber": LinearRegression(**own, loss="huber", epsilon=1.35),
        "tree": DecisionTreeRegressor(**own, maxDepth=6, seed=seed),
        "forest": RandomForestRegressor(**own, numTrees=TREES, maxDepth=6, seed=seed),
        "boosted": GBTRegressor(**own, maxIter=10, maxDepth=4, seed=seed),
    }


def condensed(rows: DataFrame, features: Sequence[str], label: str = "depth", weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows of equal ``by`` and features as one or two with a weight ``_w``, whose weight, sum and sum of squares of the label are theirs.

    The two have the mean less and plus a deviation. Soundings share the features of their cell, so a survey of any
    length comes to two rows a cell; there are never more than before. A NULL label stays one.
    """
    w, y = F.col(weight).cast("double") if weight else F.lit(1.0), F.col(label).cast("double")
    mean = F.sum(w * y) / F.sum(w) if weight else F.avg(y)
    spread = F.greatest(F.sum(w * y * y) / F.sum(w) - F.pow(mean, F.lit(2.0)), F.lit(0.0)) if weight else F.var_pop(y)
    groups = rows.groupBy(*by, *features).agg(F.sum(w).alias("_all"), F.when(F.count(y) == F.count("*"), mean).alias("_mean"), F.sqrt(spread).alias("_sd"))
    labels = F.when(F.col("_sd") > 0, F.array(F.col("_mean") - F.col("_sd"), F.col("_mean") + F.col("_sd"))).otherwise(F.array("_mean"))
    return groups.withColumn("_labels", labels).select(*by, *features, F.explode("_labels").alias(label), (F.col("_all") / F.size("_labels")).alias("_w"))


def tally(rows: DataFrame, columns: Sequence[str], count: str | None = None) -> DataFrame:
    """Rows of equal ``columns`` as one with ``_n``, how many they are, or the sum of ``count``.

    Depths have a step (a centimetre, say), so a survey of any length comes to a row a cell and depth.
    """
    return rows.groupBy(*columns).agg((F.sum(count) if count else F.count("*")).alias("_n"))


def matched(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the other columns of ``table``, one row of which has each value of ``keys``; NULL meets NULL."""
    named = table.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return rows.join(named, same, "left").drop(*[f"_key_{k}" for k in keys])


def bagged(alike: DataFrame, features: Sequence[str], label: str = "depth", weight: str | None = None, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """``condensed`` rows of the bootstrap of each tree (``_tree``) of a forest over ``tally`` rows.

    A bootstrap takes each sounding a Poisson number of times with mean one, so ``_n`` equal soundings with mean ``_n``.
    Draws follow from the rows alone, not from their partitions.
    """
    own = list(dict.fromkeys([*by, *features, label, *([weight] if weight else [])]))
    dealt = alike.select(*own, "_n", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("_tree"))
    drawn = dealt.withColumn("_k", poisson(F.xxhash64(F.lit(seed), "_tree", *own), F.col("_n")))
    drawn = drawn.filter((F.col("_k") > 0) | F.col(label).isNull()).withColumn("_k", F.col("_k") * (F.col(weight) if weight else 1.0))
    return condensed(drawn, features, label, "_k", [*by, "_tree"])


class Forest(Model):
    """The mean of trees, each fitted to its own bootstrap; importances are the mean of the trees', as MLlib has them."""

    def __init__(self, trees: Sequence):
        super().__init__()
        self.trees = list(trees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = [t.getPredictionCol() for t in self.trees]
        for tree in self.trees:
            dataset = tree.transform(dataset)
        return dataset.withColumn("y_pred", sum(F.col(n) for n in names) / len(names)).drop(*names)

    @property
    def featureImportances(self):  # noqa: N802  MLlib's name
        total = sum(t.featureImportances.toArray() for t in self.trees)
        return Vectors.dense(total / (total.sum() or 1.0))


def _forest(bags: DataFrame, assembler: VectorAssembler, label: str, seed: int = 42) -> PipelineModel:
    """A forest over ``bagged`` rows, several trees at a time; a tree whose bootstrap is empty is left out."""

    def tree(k: int):
        one = RandomForestRegressor(labelCol=label, weightCol="_w", predictionCol=f"_tree_{k}", numTrees=1, bootstrap=False, featureSubsetStrategy="onethird", maxDepth=6, seed=seed + k)
        return one.fit(assembler.transform(bags.filter(F.col("_tree") == k)))

    drawn = sorted(r[0] for r in bags.select("_tree").distinct().collect())
    if not drawn:
        raise ValueError("no rows")
    with ThreadPool(FITS) as pool:
        return PipelineModel(stages=[assembler, Forest(pool.map(tree, drawn))])


def prepared(rows: DataFrame, features: Sequence[str], names: Sequence[str] | None = None, label: str = "depth", weight: str | None = None, count: str | None = None, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables that models are fitted to, written once: ``moments`` (``condensed``), ``alike`` (``tally`` with ``_m``, count times weight) and ``bags`` (``bagged``), each if some model needs it.

    None of them has more rows than features and labels (moments, bags: features) have distinct values, a tree each for bags.
    """
    names, out = set(registry(label) if names is None else names), {}
    weights = [weight] if weight else []
    if names - set(BY_MOMENTS):
        rows, count = tally(rows, dict.fromkeys([*by, *features, label, *weights]), count), "_n"
        rows = out["alike"] = written(rows.withColumn("_m", F.col("_n") * (F.col(weight) if weight else 1.0)), "alike")
    if names & set(BY_MOMENTS):
        both = rows.withColumn("_m", F.col(count) * F.col(weight)) if count and weight else rows
        out["moments"] = written(condensed(both, features, label, "_m" if count and weight else count or weight, by), "moments")
    if "forest" in names:
        out["bags"] = written(bagged(rows, features, label, weight, by), "bags")
    return out


def fitted(tables: Mapping[str, DataFrame], features: Sequence[str], names: Sequence[str] | None = None, label: str = "depth", where: Column | None = None) -> dict:
    """Pipelines by name, fitted to the rows of ``prepared`` tables ``where`` that holds; a model that fails is left out, and if all do that is an error."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    tables = {k: t if where is None else t.filter(where) for k, t in tables.items()}
    found, last = {}, None
    for name in registry(label):
        if names is None or name in names:
            try:
                if name == "forest":
                    found[name] = _forest(tables["bags"], assembler, label)
                else:
                    table, own = ("moments", "_w") if name in BY_MOMENTS else ("alike", "_m")
                    found[name] = Pipeline(stages=[assembler, registry(label, own)[name]]).fit(tables[table])
            except Exception as e:  # noqa: BLE001  the others may still fit
                last = e
    if not found:
        raise RuntimeError("no model could be fitted") from last
    return found


def fit(rows: DataFrame, features: Sequence[str], names: Sequence[str] | None = None, label: str = "depth", weight: str | None = None, count: str | None = None) -> dict:
    """Fitted pipelines by name; a model that fails is left out, and if all do that is an error.

    ``count``: how many soundings a row stands for. ``rows`` are read once. Models of squared error and Huber's loss are
    the same as over all rows; a forest has trees of the same kind, each over a bootstrap of all soundings.
    """
    return fitted(prepared(rows, features, names, label, weight, count), features, names, label)


def leaderboard(fitted: Mapping, rows: DataFrame, label: str = "depth") -> DataFrame:
    """A row of metrics per model on ``rows``."""
    out = None
    for name, model in fitted.items():
        part = model.transform(rows).select(F.lit(name).alias("model"), F.col(label).alias("y_true"), "y_pred")
        out = part if out is None else out.unionByName(part)
    return regression_metrics(out, ["model"])


def held_out(rows: DataFrame, folds: int = 5, tile: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rows to fit on and rows to score on: the blocks of cells in the first of ``folds`` are left for scoring.

    Rows whose blocks are all in one fold are all of both.
    """
    marked = tile_folds(rows, folds, tile)
    score, learn = marked.filter("fold = 0").drop("fold"), marked.filter("fold <> 0").drop("fold")
    return (learn, score) if learn.limit(1).count() and score.limit(1).count() else (rows, rows)


def compare(rows: DataFrame, features: Sequence[str], names: Sequence[str] | None = None, label: str = "depth") -> DataFrame:
    """A row of metrics per model, on blocks of cells that none of them was fitted on."""
    learn, score = held_out(rows)
    return leaderboard(fit(learn, features, names, label), score, label)


def predict(model, cells: DataFrame, features: Sequence[str]) -> DataFrame:
    """``cells`` with ``y_pred``, NULL where a feature is NULL."""
    missing = F.lit(False)
    for f in features:
        missing = missing | F.col(f).isNull()
    filled = cells.withColumn("_missing", missing).fillna(0.0, list(features))
    out = model.transform(filled).drop("features")
    return out.withColumn("y_pred", F.when(~F.col("_missing"), F.col("y_pred"))).drop("_missing")


def tile_folds(rows: DataFrame, folds: int = 5, tile: int = 8) -> DataFrame:
    """``rows`` with ``fold`` by blocks of cells, so that neighbours are held out together."""
    block = F.floor(F.col("r") / tile) * 1_000_003 + F.floor(F.col("c") / tile)
    return rows.withColumn("fold", F.pmod(block, F.lit(folds)).cast("int"))


def kmeans_folder(rows: DataFrame, folds: int = 5, seed: int = 42, count: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """What gives rows their ``fold`` by clusters of the places of ``rows``; a place counts as often as it has rows, but the rounds see it once."""
    assembler = VectorAssembler(inputCols=["r", "c"], outputCol="_place")
    n = F.sum(count) if count else F.count("*")
    places = assembler.transform(rows.groupBy("r", "c").agg(n.cast("double").alias("_n")))
    model = KMeans(k=folds, seed=seed, featuresCol="_place", predictionCol="fold", weightCol="_n").fit(places)
    return lambda x: model.transform(assembler.transform(x)).drop("_place")


def kmeans_folds(rows: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` with ``fold`` by clusters of places."""
    return kmeans_folder(rows, folds, seed)(rows)


def cluster_deep_water(cells: DataFrame, bands: Sequence[str], k: int = 3, seed: int = 42) -> DataFrame:
    """``cells`` with ``deep``: in the cluster whose centre is darkest in the first two bands."""
    data = VectorAssembler(inputCols=list(bands), outputCol="_f").transform(cells)
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="_k").fit(data)
    dark = min(range(k), key=lambda i: sum(model.clusterCenters()[i][:2]))
    return model.transform(data).withColumn("deep", F.col("_k") == dark).drop("_f", "_k")


def feature_importance(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Share of each feature in a fitted pipeline: the tree's own, or the magnitude of coefficients."""
    last = model.stages[-1]
    own = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    total = own.sum() or 1.0
    return sorted(((f, float(v / total)) for f, v in zip(features, own)), key=lambda x: (-x[1], x[0]))


def year_matrix(rows: DataFrame, least: int = 10) -> DataFrame:
    """Rows of years with ``least`` rows or more, the year as a feature."""
    n = rows.groupBy(F.col("year").alias("_y")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return rows.join(F.broadcast(n), F.col("year") == F.col("_y"), "left_semi").withColumn("year_feature", F.col("year").cast("double"))


def uncertainty(rows: DataFrame, cells: DataFrame, features: Sequence[str], label: str = "depth", count: str | None = None) -> DataFrame:
    """``cells`` with ``u``: a forest of 1.96 times the magnitude of a forest's residual.

    The first forest predicts each value of the features once.
    """
    tables = prepared(rows, features, ["forest"], label, count=count)
    first = fitted(tables, features, ["forest"], label)["forest"]
    known = written(first.transform(tables["alike"].select(*features).distinct()).select(*features, "y_pred"), "known")
    errors = matched(tables["alike"], known, features).select(*features, (1.96 * F.abs(F.col(label) - F.col("y_pred"))).alias("_u"), "_n")
    return predict(fit(errors, features, ["forest"], "_u", count="_n")["forest"], cells, features).withColumnRenamed("y_pred", "u")


def benthic(labelled: DataFrame, cells: DataFrame, features: Sequence[str], label: str, erased: Sequence[int] = (2, 3), seed: int = 42) -> DataFrame:
    """``cells`` with ``benthic_class`` of a forest fitted on labelled cells; some classes become NULL."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", predictionCol="_class", numTrees=20, seed=seed)
    out = Pipeline(stages=[assembler, forest]).fit(labelled).transform(cells)
    own = F.col("_class").cast("int")
    return out.withColumn("benthic_class", F.when(~own.isin(*erased), own)).drop("features", "rawPrediction", "probability", "_class")
