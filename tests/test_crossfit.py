"""Folds left out, importances by permutation and searches, on made-up soundings."""

import random

import pytest
from pyspark.sql import functions as F

from shoalgrid.operators import crossfit, models


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = []
    for k in range(900):
        a, b, noise = r.uniform(0, 1), r.uniform(0, 1), r.uniform(0, 1)
        data.append((k, r.randrange(40), r.randrange(40), a, b, noise, -3.0 * a - b + r.gauss(0, 0.1)))
    return spark.createDataFrame(data, "k long, r int, c int, a double, b double, noise double, depth double").repartition(3).cache()


def test_predictions_leave_their_fold_out(spark, rows):
    marked = crossfit.with_folds(rows, 3)
    got = {r.k: (r.fold, r.p_linear, r.p_tree) for r in crossfit.out_of_fold(marked, ["a", "b"], ["linear", "tree"]).collect()}
    assert len(got) == 900 and len({f for f, *_ in got.values()}) == 3
    for fold in {f for f, *_ in got.values()}:
        fitted = models.fit(marked.filter(F.col("fold") != fold), ["a", "b"], ["linear", "tree"])
        for place, name in ((1, "linear"), (2, "tree")):
            for r in fitted[name].transform(marked.filter(F.col("fold") == fold)).select("k", "y_pred").limit(40).collect():
                assert got[r.k][place] == pytest.approx(r.y_pred)
    with pytest.raises(ValueError):
        crossfit.out_of_fold(rows.withColumn("fold", F.lit(1)), ["a"], ["linear"])


def test_stacking_is_not_fooled_by_memory(spark, rows):
    """A deep tree on noise remembers its rows; the ridge over predictions of rows left out still follows the line."""
    on_rows, on_cells = crossfit.stacked(rows, rows.drop("depth"), ["a", "b"], ["linear", "tree"], folds=3)
    error = lambda df: df.select(F.sqrt(F.avg(F.pow(F.col("depth") - F.col("y_pred"), F.lit(2.0))))).first()[0]
    assert error(on_rows) < 0.2 and error(on_cells.join(rows.select("k", "depth"), "k")) < 0.2
    assert "p_tree" not in on_cells.columns and on_cells.count() == 900
    board = {r.model: r.r2 for r in crossfit.cross_scores(rows, ["a", "b"], ["linear", "tree"], folds=3).collect()}
    assert board["linear"] > board["tree"] > 0.5


def test_permutation(spark, rows, monkeypatch):
    monkeypatch.setattr(crossfit, "BUCKET_ROWS", 100)
    ranks = crossfit.hash_ranks(rows, F.xxhash64("k"), "rank", ["k"]).orderBy("rank").select("rank", F.xxhash64("k")).collect()
    assert [r[0] for r in ranks] == list(range(900)) and [r[1] for r in ranks] == sorted(r[1] for r in ranks)
    dealt = crossfit.permuted(rows, "a", "k").select("k", "a", "b").collect()
    own = {r.k: (r.a, r.b) for r in rows.collect()}
    assert sorted(r.a for r in dealt) == sorted(a for a, _ in own.values()) and all(own[r.k][1] == r.b for r in dealt)
    assert sum(own[r.k][0] == r.a for r in dealt) < 20 and dealt != crossfit.permuted(rows, "a", "k", 1).select("k", "a", "b").collect()


def test_importance(spark, rows):
    names = ["a", "b", "noise"]
    fitted = models.fit(rows, names, ["linear", "forest"])
    got = {r.feature: r.importance for r in crossfit.permutation_importance(fitted["linear"], rows, names, "k").collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["noise"] < 0.01 and got["a"] > 0.8 > got["b"] > 0.05
    one = {r.feature: r.importance for r in crossfit.importance(fitted["linear"], rows, names, "k").collect()}
    both = {r.feature: r.importance for r in crossfit.importance(fitted, rows, names, "k").collect()}
    forest = dict(models.feature_importance(fitted["forest"], names))
    assert all(both[f] == pytest.approx((one[f] + forest[f]) / 2) for f in names)


def test_candidates():
    assert crossfit.grid({"a": [1, 3], "b": [0.0, 1.0], "c": ["x"]})[:2] == [{"a": 1, "b": 0.0, "c": "x"}, {"a": 1, "b": 0.25, "c": "x"}]
    assert len(crossfit.grid({"a": [1, 3], "b": [0.0, 1.0]})) == 15 and crossfit.grid({"a": [3, 1]}) == [{"a": 3}, {"a": 1}]
    some = crossfit.draws({"a": [1, 3], "b": [0.5, 2.5], "c": ["x", "y", "z"]}, 300)
    assert {d["a"] for d in some} == {1, 2, 3} and {d["c"] for d in some} == {"x", "y", "z"} and all(0.5 <= d["b"] < 2.5 for d in some)
    assert abs(sum(d["b"] for d in some) / 300 - 1.5) < 0.1 and some == crossfit.draws({"a": [1, 3], "b": [0.5, 2.5], "c": ["x", "y", "z"]}, 300)


def test_search(spark, rows):
    candidates = [{"regParam": 0.0}, {"regParam": 5.0}, {"regParam": 0.01}, {"regParam": 50.0}]
    all_folds = {r.candidate: r for r in crossfit.search(rows, ["a", "b"], "ridge", candidates, folds=4).collect()}
    assert [all_folds[k].folds for k in range(4)] == [4] * 4 and (all_folds[0].best or all_folds[2].best) and all_folds[1].r2 < all_folds[0].r2
    halved = {r.candidate: r for r in crossfit.search(rows, ["a", "b"], "ridge", candidates, folds=4, halving=True).collect()}
    assert sorted(r.folds for r in halved.values()) == [1, 1, 2, 4] and sum(r.best for r in halved.values()) == 1 and halved[3].folds == 1


@pytest.fixture(scope="module")
def surveyed(spark):
    """Many soundings a cell: 108 pairs of features, each in both of two folds of tiles, 4,800 rows."""
    r = random.Random(4)
    data = []
    for k in range(4800):
        i, j = r.randrange(12), r.randrange(9)
        data.append((k, 8 * (k % 2) + i % 8, j % 8, i / 12, j / 9, -3.0 * i / 12 - (j / 9) ** 2 + r.gauss(0, 0.4)))
    return spark.createDataFrame(data, "k long, r int, c int, a double, b double, depth double").repartition(3).cache()


def fitted_to_all(model, learn):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), model]).fit(learn)


def test_condensed_fits_are_those_of_all_rows(surveyed):
    few = models.condensed(surveyed, ["a", "b"])
    n, w, s, q = few.agg(F.count("*"), F.sum("_w"), F.sum(F.col("_w") * F.col("depth")), F.sum(F.col("_w") * F.col("depth") * F.col("depth"))).first()
    assert n <= 216 and (w, s, q) == pytest.approx(surveyed.agg(F.count("*"), F.sum("depth"), F.sum(F.col("depth") * F.col("depth"))).first())
    fitted = models.fit(surveyed, ["a", "b"], models.BY_MOMENTS)
    cells = surveyed.select("a", "b").distinct()
    for name in models.BY_MOMENTS:
        want = {(r.a, r.b): r.y_pred for r in fitted_to_all(models.registry()[name], surveyed).transform(cells).collect()}
        got = {(r.a, r.b): r.y_pred for r in fitted[name].transform(cells).collect()}
        assert got == {k: pytest.approx(v, rel=1e-6, abs=1e-6) for k, v in want.items()}, name
    weighed = surveyed.withColumn("w", 1.0 + F.col("k") % 3)
    line = models.fit(weighed, ["a", "b"], ["linear"], weight="w")["linear"].stages[-1]
    assert line.coefficients.toArray() == pytest.approx(fitted_to_all(models.registry(weight="w")["linear"], weighed).stages[-1].coefficients.toArray())


def test_search_on_condensed_rows_scores_all_rows(surveyed):
    """R2 and the least soundings of a node are those of all rows, also where they leave no split."""
    candidates = [{"maxDepth": 4, "minInstancesPerNode": m} for m in (1, 90, 400, 5000)]
    got = {r.candidate: r.r2 for r in crossfit.search(surveyed, ["a", "b"], "tree", candidates, folds=2).collect()}
    marked = models.tile_folds(surveyed, 2)
    for k, own in enumerate(candidates):
        scores = []
        for fold in (0, 1):
            model = models.registry()["tree"]
            found = fitted_to_all(model.copy({model.getParam(p): v for p, v in own.items()}), marked.filter(F.col("fold") != fold)).transform(marked.filter(F.col("fold") == fold))
            scores.append(crossfit.regression_metrics(found.withColumnRenamed("depth", "y_true")).first()["r2"])
        assert got[k] == pytest.approx(sum(scores) / 2, abs=1e-9)


def test_places_are_clustered_by_weight(spark, surveyed):
    """Each row is in the cluster of its place, and clusters hold their nearest rows."""
    marked = models.kmeans_folds(surveyed, 3).select("r", "c", "fold").collect()
    centres = {f: [sum(x) / len(x) for x in zip(*[(m.r, m.c) for m in marked if m.fold == f])] for f in {m.fold for m in marked}}
    assert len(marked) == 4800 and len(centres) == 3
    near = [min(centres, key=lambda f: (m.r - centres[f][0]) ** 2 + (m.c - centres[f][1]) ** 2) == m.fold for m in marked]
    assert sum(near) > 4600


def test_permutations_are_plans_of_their_own(spark, surveyed, monkeypatch):
    """One permutation a plan, joined by shuffle, so the driver's share doesn't grow with features, repeats or rows."""
    plans, own = [], crossfit.regression_metrics

    def noted(pairs, *args):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return own(pairs, *args)

    monkeypatch.setattr(crossfit, "regression_metrics", noted)
    line = models.fit(surveyed, ["a", "b"], ["linear"])["linear"]
    got = {r.feature: r.importance for r in crossfit.permutation_importance(line, surveyed, ["a", "b"], "k").collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["a"] > got["b"] > 0
    assert len(plans) == 7 and all(p.count("- Window [") <= 4 and "Union" not in p for p in plans) and all("SortMergeJoin" in p for p in plans[1:])


def test_poisson_draws_follow_from_their_marks():
    """Means and variances of draws of small and large means; a mark gives one number wherever it stands."""
    import numpy as np

    from shoalgrid.operators.bootstrap import poisson_draws

    marks = np.random.Generator(np.random.PCG64(1)).integers(-(1 << 63), 1 << 63, 4000, dtype=np.int64)
    for mean in (1.0, 7.0, 64.0, 65.0, 3000.0):
        got = poisson_draws(marks, np.full(4000, mean))
        assert abs(got.mean() - mean) < 5 * (mean / 4000) ** 0.5 and abs(got.var() / mean - 1) < 0.15
        assert (poisson_draws(marks[::-1], np.full(4000, mean))[::-1] == got).all()
    assert list(poisson_draws(np.array([-(1 << 63), -1, 0], dtype=np.int64), np.array([1.0, 1.0, 0.5]))[[0, 2]]) == [1, 0]


def test_forests_are_grown_on_bootstraps_of_all_soundings(spark, surveyed, monkeypatch):
    """A tree's bootstrap has as many soundings as there are, give or take, whether rows are counted or not, and the rows that fits read have no more rows than cells."""
    alike = models.tally(surveyed, ["a", "b", "depth"])
    drawn = models.bagged(alike, ["a", "b"]).groupBy("_tree").agg(F.sum("_w").alias("w"), F.count("*").alias("n")).collect()
    assert len(drawn) == models.TREES and all(abs(d.w - 4800) < 350 and d.n <= 216 for d in drawn) and len({d.w for d in drawn}) > 15
    again = models.bagged(alike.repartition(7), ["a", "b"]).groupBy("_tree").agg(F.sum("_w").alias("w")).collect()
    assert {(d["_tree"], d.w) for d in drawn} == {(d["_tree"], d.w) for d in again}
    fold = models.tile_folds(surveyed, 2)
    mean = {(r.a, r.b): r.m for r in surveyed.groupBy("a", "b").agg(F.avg("depth").alias("m")).collect()}
    forest = models.fit(fold, ["a", "b"], ["forest"])["forest"]
    own = {(r.a, r.b): r.y_pred for r in forest.transform(surveyed.select("a", "b").distinct()).collect()}
    want = {(r.a, r.b): r.y_pred for r in fitted_to_all(models.registry()["forest"], surveyed).transform(surveyed.select("a", "b").distinct()).collect()}
    off = lambda p: (sum((p[k] - mean[k]) ** 2 for k in mean) / len(mean)) ** 0.5
    assert off(own) < 1.3 * off(want) + 0.05 and sum(forest.stages[-1].featureImportances.toArray()) == pytest.approx(1.0)


def test_counted_rows_score_as_all_rows(spark, surveyed, monkeypatch):
    """Soundings rounded to a step, once as rows and once as counted rows: every model's metrics are the same, and fits read reduced tables only."""
    rows = surveyed.withColumn("depth", F.round("depth", 1))
    read, own = [], models.prepared

    def noted(x, *args, **kwargs):
        read.append(x.count())
        return own(x, *args, **kwargs)

    monkeypatch.setattr(models, "prepared", noted)
    names = ["linear", "huber", "forest"]
    all_rows = {r.model: r for r in crossfit.cross_scores(rows, ["a", "b"], names, folds=2, kind="tiles").collect()}
    few = models.tally(rows, ["r", "c", "a", "b", "depth"])
    counted = {r.model: r for r in crossfit.cross_scores(few, ["a", "b"], names, folds=2, kind="tiles", count="_n").collect()}
    assert set(read) == {few.count()} and few.count() < 3600
    for name in names:
        assert all_rows[name].n == counted[name].n == 4800
        assert counted[name].asDict() == {k: v if k in ("model", "n") else pytest.approx(v, rel=1e-6, abs=1e-6) for k, v in all_rows[name].asDict().items()}
    marked, e = models.tile_folds(rows, 2), []
    for fold in (0, 1):
        huber = fitted_to_all(models.registry()["huber"], marked.filter(F.col("fold") != fold))
        e += [r.depth - r.y_pred for r in huber.transform(marked.filter(F.col("fold") == fold)).collect()]
    assert counted["huber"].mae == pytest.approx(sum(map(abs, e)) / 4800, rel=1e-3)


def test_soundings_are_joined_once(spark, surveyed):
    """A search, a stack and scores read the rows they are given once, however many folds, rounds and models there are."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = surveyed.mapInArrow(note, surveyed.schema)
    for run in (
        lambda: crossfit.search(rows, ["a", "b"], "tree", [{"maxDepth": 2}, {"maxDepth": 3}], folds=4, kind="kmeans", halving=True),
        lambda: crossfit.stacked(rows, surveyed.drop("depth"), ["a", "b"], ["linear", "tree"], folds=3)[1],
        lambda: crossfit.cross_scores(rows, ["a", "b"], ["linear", "forest"], folds=3),
    ):
        before = seen.value
        assert run().count() > 0 and seen.value - before == 4800


def test_random_search_scores_every_candidate_on_every_fold(spark):
    """No draw is given up after some folds; the first of the best by the mean of all folds is fitted to all rows."""
    from shoalgrid.plans import contract

    got = sorted(contract.queries()["random_search"](spark, "/root/testdata/sf0.001").collect())
    assert [r.candidate for r in got] == list(range(8)) and [r.folds for r in got] == [4] * 8
    top = max(round(r.r2, 12) for r in got)
    assert [r.candidate for r in got if r.best] == [next(r.candidate for r in got if round(r.r2, 12) == top)]
    assert all((r.r2_refit is not None) == r.best for r in got) and next(r for r in got if r.best).r2_refit >= -1e-9


def test_a_late_winner_is_found(spark):
    """A candidate that is the worst on the first fold, which is noise, and the best on all of them wins; halving gives it up."""
    data = [(8 * fold + i % 8, 0, i / 40, (-10.0 if i < 20 else 10.0) if fold else (-20.0 if i % 2 else 20.0)) for fold in range(4) for i in range(40)]
    rows = spark.createDataFrame(data, "r int, c int, a double, depth double")
    candidates = [{"maxDepth": 0}, {"maxDepth": 0}, {"maxDepth": 1}]
    whole = {r.candidate: r for r in crossfit.search(rows, ["a"], "tree", candidates, folds=4).collect()}
    halved = {r.candidate: r for r in crossfit.search(rows, ["a"], "tree", candidates, folds=4, halving=True).collect()}
    assert [whole[k].folds for k in range(3)] == [4] * 3 and [k for k in whole if whole[k].best] == [2] and whole[2].r2 > 0.5
    assert halved[2].folds == 1 and [k for k in halved if halved[k].best] == [0]


def test_the_best_candidate_is_fitted_to_all_rows(spark, surveyed):
    candidates = [{"maxDepth": 1}, {"maxDepth": 4, "minInstancesPerNode": 90}, {"maxDepth": 0}]
    table, model = crossfit.search(surveyed, ["a", "b"], "tree", candidates, folds=2, refit=True)
    got = {r.candidate: r for r in table.collect()}
    best = models.registry()["tree"]
    want = fitted_to_all(best.copy({best.getParam(p): v for p, v in candidates[1].items()}), surveyed)
    cells = surveyed.select("a", "b").distinct()
    known = {(r.a, r.b): r.y_pred for r in want.transform(cells).collect()}
    assert {(r.a, r.b): r.y_pred for r in model.transform(cells).collect()} == {k: pytest.approx(v) for k, v in known.items()}
    r2 = crossfit.regression_metrics(want.transform(surveyed).withColumnRenamed("depth", "y_true")).first().r2
    assert got[1].best and got[1].r2_refit == pytest.approx(r2) and got[0].r2_refit is got[2].r2_refit is None
    plain = crossfit.search(surveyed, ["a", "b"], "tree", candidates, folds=2)
    assert plain.columns == table.columns[:-1] and {r.candidate: r.r2 for r in plain.collect()} == {k: pytest.approx(r.r2) for k, r in got.items()}


def test_lists_alone_are_drawn_without_replacement():
    space = {"a": ["x", "y", "z"], "b": [3, 1], "c": [1, 2, 4]}
    some = crossfit.draws(space, 12)
    assert len(some) == 12 == len({tuple(d.values()) for d in some}) and some == crossfit.draws(space, 12) != crossfit.draws(space, 12, 7)
    assert sorted(crossfit.draws(space, 100), key=str) == sorted(crossfit.grid(space), key=str)
