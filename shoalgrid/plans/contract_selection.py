"""Contract queries of model choice, residuals and the order of scenes."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgrid.operators import metrics, robust, scenes, selection
from shoalgrid.plans.contract_points import _BOARD, _DRAW, _WEIGHTS, _score, pairs
from shoalgrid.plans.fixtures import view
from shoalgrid.plans.registry import query, r6

_SCORES = f"""{_BOARD}, w AS (SELECT k AS round, {', '.join(f"{x}::DOUBLE * ({_DRAW.format(m=7 + 6 * i, a=i)}) AS w_{m}" for i, (m, x) in enumerate(_WEIGHTS.items()))} FROM range(0, 20) t(k)),
  x AS (SELECT *, {_score('b', 'w', 'PARTITION BY w.round')} AS score FROM b CROSS JOIN w),
  y AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY round(score, 6) DESC, model) AS p FROM x),
  st AS (SELECT model, count(*) FILTER (WHERE p = 1) / 20.0::DOUBLE AS wins, avg(score) AS mean_score FROM y GROUP BY model),
  sc AS (SELECT b.*, {_score('b')} AS score FROM b),
  z AS (SELECT model, round(r2, 9) AS r2, round(rmse, 9) AS rmse, round(mae, 9) AS mae, round(bias, 9) AS bias, round(wmape, 9) AS wmape, round(score, 6) AS score, wins, round(mean_score, 6) AS mean_score FROM sc JOIN st USING (model))"""


def _order(strategy: str) -> str:
    return ", ".join((c[1:] + " DESC" if c[0] == "-" else c).replace("abs_bias", "abs(bias)") for c in selection.STRATEGIES[strategy]) + ", model"


@query(
    "leaderboard_strategies",
    f"WITH {_SCORES} " + " UNION ALL ".join(f"SELECT '{s}' AS strategy, model, row_number() OVER (ORDER BY {_order(s)}) AS place FROM z" for s in selection.STRATEGIES),
    "pairs",
)
def _(spark, sf):
    board = metrics.composite_score(metrics.regression_metrics(pairs(spark, sf), ["model"]), _WEIGHTS)
    k = F.col("id")
    draws = [(F.lit(x) * (1 + ((k * (7 + 6 * i) + i) % 71 - 35) / F.lit(100.0))).alias(f"w_{m}") for i, (m, x) in enumerate(_WEIGHTS.items())]
    stable = metrics.winner_stability(board.drop("score"), spark.range(20).select(k.alias("round"), *draws), list(_WEIGHTS))
    both = board.join(stable, "model").select("model", *[F.round(c, 9).alias(c) for c in ("r2", "rmse", "mae", "bias", "wmape")], F.round("score", 6).alias("score"), "wins", F.round("mean_score", 6).alias("mean_score"))
    parts = [selection.ranked(both, s).select(F.lit(s).alias("strategy"), "model", "place") for s in selection.STRATEGIES]
    return reduce(DataFrame.unionByName, parts)


_CONFIG = selection.score_config(weights={"r2": 70, "rmse": 30, "mae": 20}, variation=40)


@query(
    "score_config",
    f"WITH {_BOARD}, c(metric, weight, low, high) AS (VALUES {', '.join(f'''('{m}', {w!r}::DOUBLE, {_CONFIG.ranges[m][0]!r}::DOUBLE, {_CONFIG.ranges[m][1]!r}::DOUBLE)''' for m, w in _CONFIG.weights.items())}), "
    "v AS (SELECT model, 'r2' AS metric, -round(r2, 9) AS x FROM b UNION ALL SELECT model, 'rmse', round(rmse, 9) FROM b UNION ALL SELECT model, 'mae', round(mae, 9) FROM b) "
    "SELECT metric, round(weight, 6) AS weight, round(low, 6) AS low, round(high, 6) AS high, arg_min(model, struct_pack(x := x, m := model)) AS best_model FROM c JOIN v USING (metric) GROUP BY ALL",
    "pairs",
)
def _(spark, sf):
    board = metrics.regression_metrics(pairs(spark, sf), ["model"])
    rows = [
        board.select(F.lit(m).alias("metric"), F.round(F.lit(w), 6).alias("weight"), *[F.round(F.lit(x), 6).alias(n) for n, x in zip(("low", "high"), _CONFIG.ranges[m])], "model", F.round(-F.col(m) if m == "r2" else F.col(m), 9).alias("x"))
        for m, w in _CONFIG.weights.items()
    ]
    return reduce(DataFrame.unionByName, rows).groupBy("metric", "weight", "low", "high").agg(F.min_by("model", F.struct("x", "model")).alias("best_model"))


@query("centred_residuals", "SELECT model, round(avg(e - m), 6) + 0.0 AS mean, round(stddev_pop(e - m), 6) + 0.0 AS std, count(*) AS n FROM (SELECT model, CAST(y_true AS DOUBLE) - CAST(y_pred AS DOUBLE) AS e, avg(CAST(y_true AS DOUBLE) - CAST(y_pred AS DOUBLE)) OVER () AS m FROM fx_pairs) GROUP BY model", "pairs")
def _(spark, sf):
    rows = robust.centred_residuals(pairs(spark, sf))
    return rows.groupBy("model").agg(r6(F.avg("residual")).alias("mean"), r6(F.stddev_pop("residual")).alias("std"), F.count("*").alias("n"))


@query("chronological_scene_order", "SELECT scene_key, row_number() OVER (ORDER BY acq_ts, scene_key) AS place FROM fx_scenes", "scenes")
def _(spark, sf):
    return scenes.chronological(view(spark, sf, "scenes"), "acq_ts", "scene_key").select("scene_key", "place")
