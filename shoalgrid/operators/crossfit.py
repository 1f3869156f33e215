"""Models and folds: predictions of rows left out of a fit, importances by permutation, and searches over parameters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.operators import models
from shoalgrid.operators.metrics import regression_metrics
from shoalgrid.sources.shared import written

#: Rows of a bucket of hash order, in which ranks are counted by a window.
BUCKET_ROWS = 100_000


def with_folds(rows: DataFrame, folds: int = 5, kind: str = "tiles", seed: int = 42) -> DataFrame:
    """``rows`` with ``fold``: blocks of cells, or clusters of places; written once, as every fold is read by several fits."""
    if kind == "tiles":
        return written(models.tile_folds(rows, folds), "folds")
    return written(models.kmeans_folds(written(rows, "rows"), folds, seed), "folds")


def _left_out(tables: Mapping[str, DataFrame], features: Sequence[str], names: Sequence[str], label: str) -> DataFrame:
    """(fold, features, p_<name>): predictions for each value of the features in a fold by models fitted on the other folds' rows of ``models.prepared``.

    Folds are fitted several at a time. A single fold can't be left out and is an error.
    """
    values = tables["alike" if "alike" in tables else "moments"].select("fold", *features).distinct()
    folds = sorted(r[0] for r in values.select("fold").distinct().collect())
    if len(folds) < 2:
        raise ValueError("all rows are in one fold")

    def one(k: int) -> DataFrame:
        part = values.filter(F.col("fold") == k)
        for name, model in models.fitted(tables, features, names, label, F.col("fold") != k).items():
            part = models.predict(model, part, features).withColumnRenamed("y_pred", f"p_{name}")
        return written(part, "left-out")

    out = None
    with ThreadPool(models.FITS) as pool:
        for part in pool.map(one, folds):
            out = part if out is None else out.unionByName(part)
    return out


def out_of_fold(marked: DataFrame, features: Sequence[str], names: Sequence[str], label: str = "depth", weight: str | None = None) -> DataFrame:
    """``marked`` (with ``fold``) with ``p_<name>``: each row's prediction by a model fitted on the other folds alone.

    A value of the features is predicted once a fold and joined to its rows. A single fold can't be left out and is an error.
    """
    tables = models.prepared(marked, features, names, label, weight, by=["fold"])
    return models.matched(marked, _left_out(tables, features, names, label), ["fold", *features])


def _reduced(rows: DataFrame, features: Sequence[str], label: str, folds: int, kind: str, count: str | None, moments: bool, seed: int = 42) -> tuple[DataFrame, str, Callable[[DataFrame], DataFrame]]:
    """(rows reduced to their places, features and labels or ``moments`` of labels; the column that counts them; what gives a fold to them and to all rows).

    This is the only pass over all rows; the table is written once.
    """
    at, n = list(dict.fromkeys(["r", "c", *features])), "_w" if moments else "_n"
    own = [x for x in ("r", "c") if x not in features]
    few = models.condensed(rows, features, label, count, own) if moments else models.tally(rows, [*at, label], count)
    few = written(few, "reduced")
    return few, n, (lambda x: models.tile_folds(x, folds)) if kind == "tiles" else models.kmeans_folder(few, folds, seed, n)


def stacked(rows: DataFrame, cells: DataFrame, features: Sequence[str], names: Sequence[str], label: str = "depth", folds: int = 5, kind: str = "kmeans", count: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, cells) with ``y_pred`` of a ridge over the predictions of some models.

    The ridge learns from predictions of rows left out, so a model that only remembers its rows gains nothing; rows are
    predicted from those, cells by the models fitted on all rows. ``count``: how many soundings a row stands for.
    """
    few, n, mark = _reduced(rows, features, label, folds, kind, count, set(names) <= set(models.BY_MOMENTS))
    tables = models.prepared(mark(few), features, names, label, count=n, by=["fold"])
    known = _left_out(tables, features, names, label)
    own, keys = [f"p_{x}" for x in names], ["fold", *features]
    reduced, n = (tables["alike"], "_n") if "alike" in tables else (tables["moments"], "_w")
    top = models.fit(models.matched(reduced, known, keys), own, ["ridge"], label, count=n)["ridge"]
    for name, model in models.fitted(tables, features, names, label).items():
        cells = models.predict(model, cells, features).withColumnRenamed("y_pred", f"p_{name}")
    return tuple(models.predict(top, x, own).drop(*own, "fold") for x in (models.matched(mark(rows), known, keys), cells))


def cross_scores(rows: DataFrame, features: Sequence[str], names: Sequence[str] | None = None, label: str = "depth", folds: int = 5, kind: str = "kmeans", count: str | None = None) -> DataFrame:
    """A row of metrics per model over all rows, each predicted by fits that left its fold out. ``count``: how many soundings a row stands for."""
    names = list(names or models.registry(label))
    few, n, mark = _reduced(rows, features, label, folds, kind, count, False)
    known = _left_out(models.prepared(mark(few), features, names, label, count=n, by=["fold"]), features, names, label)
    found = models.matched(mark(few), known, ["fold", *features])
    long = found.select(n, F.col(label).alias("y_true"), F.explode(F.create_map(*[x for m in names if f"p_{m}" in found.columns for x in (F.lit(m), F.col(f"p_{m}"))])).alias("model", "y_pred"))
    return regression_metrics(long, ["model"], n)


def hash_ranks(rows: DataFrame, order: Column, name: str, ties: Sequence[str]) -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2, ... in the order of a hash (64 bits) and then ``ties``, exactly and without one task for all.

    Hashes fall evenly into buckets of their top bits; counts of buckets are added up, a row a bucket, and ranks inside
    a bucket come from a window of its own.
    """
    n = rows.count()
    bits = max(0, (n // BUCKET_ROWS).bit_length())
    marked = rows.withColumn("_h", order)
    marked = marked.withColumn("_bucket", F.shiftright("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy("_h", *ties)
    ranked = marked.withColumn("_own", F.row_number().over(inside)).join(counts, F.col("_bucket") == F.col("_b"))
    return ranked.withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_h", "_bucket", "_b", "_before", "_own")


def permuted(rows: DataFrame, column: str, key: str, seed: int = 0) -> DataFrame:
    """``rows`` with the values of one column dealt anew: of two hash orders of the rows the k-th of one takes the value of the k-th of the other.

    ``key`` tells rows apart. Ranks are exact, so every value is used once, and the join is by equality.
    """
    mark = lambda which: F.xxhash64(F.lit(f"{seed}:{column}:{which}"), F.col(key))
    takes = hash_ranks(rows, mark("takes"), "_rank", [key]).drop(column)
    gives = hash_ranks(rows.select(key, column), mark("gives"), "_rank", [key]).select("_rank", column)
    return takes.join(gives.hint("merge"), "_rank").select(*rows.columns)


def permutation_importance(model, rows: DataFrame, features: Sequence[str], key: str, label: str = "depth", repeats: int = 3) -> DataFrame:
    """(feature, importance): the share of each feature in what a model's R2 loses when its values are dealt anew, none below 0.

    Every row is used. A feature's turn is a query of its own that gives one number, so neither plans nor what the
    driver keeps of their stages grow with features and repeats.
    """
    rows = written(rows.select(key, label, *features), "rows")

    def r2(part: DataFrame) -> float | None:
        scored = models.predict(model, part, features).select(F.col(label).alias("y_true"), "y_pred")
        return regression_metrics(scored).select("r2").first()[0]

    base = r2(rows)
    lost = {}
    for f in features:
        turns = [r2(permuted(rows, f, key, k)) for k in range(repeats)] if base is not None else []
        known = [base - x for x in turns if x is not None]
        lost[f] = max(sum(known) / len(known), 0.0) if known else 0.0
    total = sum(lost.values())
    return rows.sparkSession.createDataFrame([(f, v / total if total > 0 else 0.0) for f, v in lost.items()], "feature string, importance double")


def importance(model, rows: DataFrame, features: Sequence[str], key: str, label: str = "depth") -> DataFrame:
    """(feature, importance): a fitted pipeline's own importances, the shares of its coefficients' magnitudes, of several pipelines the mean, or else by permutation."""
    several = list(model.values()) if isinstance(model, Mapping) else [model]
    own = []
    for m in several:
        last = m.stages[-1]
        if hasattr(last, "featureImportances") or hasattr(last, "coefficients"):
            own.append(dict(models.feature_importance(m, features)))
    if own:
        mean = [(f, sum(x[f] for x in own) / len(own)) for f in features]
        return rows.sparkSession.createDataFrame(mean, "feature string, importance double")
    return permutation_importance(model, rows, features, key, label)


def _uniform(*parts) -> float:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13


def grid(space: Mapping[str, Sequence]) -> list[dict]:
    """All combinations; a list of two rising numbers is a range: up to five points of it, whole ones for whole numbers."""
    out: list[dict] = [{}]
    for name, values in space.items():
        if len(values) == 2 and _is_range(values):
            low, high = values
            n = min(5, high - low + 1) if isinstance(low, int) and isinstance(high, int) else 5
            steps = [low + (high - low) * k / (n - 1) for k in range(n)]
            values = [int(s) for s in steps] if isinstance(low, int) and isinstance(high, int) else steps
        out = [{**o, name: v} for o in out for v in values]
    return out


def draws(space: Mapping[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """``n`` draws by a hash of seed, turn and name: evenly from a range of two rising numbers (whole ones, both ends in, for whole numbers), else one of the list.

    Lists alone have a bounded number of combinations: ``n`` of these are drawn, none twice, all if there are fewer.
    """
    if not any(len(v) == 2 and _is_range(v) for v in space.values()):
        every = grid(space)
        return [every[k] for k in sorted(range(len(every)), key=lambda k: (_uniform(seed, k), k))[:n]]
    out = []
    for k in range(n):
        own = {}
        for name, values in space.items():
            u = _uniform(seed, k, name)
            if len(values) == 2 and _is_range(values):
                low, high = values
                own[name] = low + int(u * (high - low + 1)) if isinstance(low, int) and isinstance(high, int) else low + u * (high - low)
            else:
                own[name] = values[int(u * len(values))]
        out.append(own)
    return out


def _is_range(values: Sequence) -> bool:
    return all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values) and values[0] < values[1]


def _least_by_weight(candidate: Mapping, n: float) -> dict:
    """The parameters for ``n`` rows that are condensed: the least rows of a tree's node as a share of the weight, halfway to one row less; a tree that they leave no split has no depth."""
    own = dict(candidate)
    least = own.pop("minInstancesPerNode", 1)
    if 2 * least > n:
        return {**own, "maxDepth": 0} if least > 1 else own
    return {**own, "minWeightFractionPerNode": (least - 0.5) / n} if least > 1 else own


def _weighted_r2() -> Column:
    w, t, e = F.col("_w"), F.col("y_true"), F.col("y_pred") - F.col("y_true")
    spread = F.sum(w * t * t) - F.sum(w * t) * F.sum(w * t) / F.sum(w)
    return F.when(spread > 0, 1 - F.sum(w * e * e) / spread).alias("r2")


def search(rows: DataFrame, features: Sequence[str], name: str, candidates: Sequence[Mapping], label: str = "depth", folds: int = 4, kind: str = "tiles", halving: bool = False, make: Callable | None = None, count: str | None = None, refit: bool = False) -> DataFrame | tuple[DataFrame, PipelineModel]:
    """(candidate, parameters, folds, r2, best): each candidate's mean R2 over the folds that it was scored on, the first best of equals.

    Every candidate is scored on every fold, unless ``halving`` is asked for: there the better half of the candidates
    goes on to twice as many folds, beginning with one. With ``refit`` the best candidate is fitted to all rows, too,
    and comes with the table, whose row of it has ``r2_refit``, its R2 over all rows. A fold's
    candidates are scored in one plan, a row each, on ``models.condensed`` rows, whose R2 is that of all; models of
    squared error are fitted to those, too, several at a time, and all rows are read once. ``count``, for those models
    alone: how many soundings a row stands for.
    """
    by_moments = make is None and name in models.BY_MOMENTS
    if count and not by_moments:
        raise ValueError("rows that stand for several are for models of squared error")
    if by_moments:
        reduced, n, mark = _reduced(rows, features, label, folds, kind, count, True)
        marked, few = None, written(models.condensed(mark(reduced), features, label, n, ["fold"]), "moments")
    else:
        marked = with_folds(rows, folds, kind)
        few = written(models.condensed(marked, features, label, by=["fold"]), "moments")
    spark, names = rows.sparkSession, sorted(r[0] for r in few.select("fold").distinct().collect())
    if len(names) < 2:
        raise ValueError("all rows are in one fold")
    make = make or (lambda n: models.registry(label, "_w" if by_moments else None)[n])

    def fit(k: int, learn: DataFrame, n: float | None) -> PipelineModel:
        model = make(name)
        own = _least_by_weight(candidates[k], n) if by_moments else candidates[k]
        model = model.copy({model.getParam(p): v for p, v in own.items()})
        return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), model]).fit(learn)

    def scored(k: int, fitted: PipelineModel, test: DataFrame) -> DataFrame:
        return models.predict(fitted, test, features).select(F.lit(k).alias("k"), F.col(label).alias("y_true"), "y_pred", "_w")

    def r2(pairs: DataFrame) -> dict[int, float]:
        found = pairs.filter("y_true IS NOT NULL AND y_pred IS NOT NULL").groupBy("k").agg(_weighted_r2()).collect()
        return {r["k"]: float("-inf") if r["r2"] is None else r["r2"] for r in found}

    weight = lambda learn: learn.agg(F.sum("_w")).first()[0] if by_moments else None
    scores: dict[int, list[float]] = {k: [] for k in range(len(candidates))}
    left, seen = list(scores), 0
    upto = 1 if halving else len(names)
    while seen < len(names):
        for fold in names[seen:upto]:
            learn, test, out = (few if by_moments else marked).filter(F.col("fold") != fold), few.filter(F.col("fold") == fold), None
            n = weight(learn)
            with ThreadPool(models.FITS if by_moments else 1) as pool:
                found = pool.map(lambda k, learn=learn, n=n: fit(k, learn, n), left)
            for k, fitted in zip(left, found):
                part = scored(k, fitted, test)
                out = part if out is None else out.unionByName(part)
            for k, v in r2(out).items():
                scores[k].append(v)
        seen = upto
        mean = {k: sum(scores[k]) / len(scores[k]) for k in left if scores[k]}
        left = sorted(left, key=lambda k: (-round(mean[k], 12) if k in mean and math.isfinite(mean[k]) else float("inf"), k))
        if halving and seen < len(names):
            left = left[: max(1, (len(left) + 1) // 2)]
            upto = min(len(names), 2 * seen)
    text = lambda c: ", ".join(f"{p}={c[p]:.12g}" if isinstance(c[p], float) else f"{p}={c[p]}" for p in sorted(c))
    table = [(k, text(candidates[k]), len(s), sum(s) / len(s) if s else None, k == left[0]) for k, s in scores.items()]
    schema = "candidate int, parameters string, folds int, r2 double, best boolean"
    if not refit:
        return spark.createDataFrame(table, schema)
    every = few if by_moments else marked
    model = fit(left[0], every, weight(every))
    own = r2(scored(left[0], model, few))
    return spark.createDataFrame([(*t, own.get(t[0])) for t in table], f"{schema}, r2_refit double"), model
