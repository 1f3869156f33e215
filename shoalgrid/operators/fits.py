"""Robust fits of many groups at once: every round is one aggregate of sums for all groups, whose few numbers are solved on the driver.

Groups are years or scenes: a row each comes back to the driver, whatever the rows they have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.operators.quantiles import exact_median
from shoalgrid.sources.shared import written

#: Where a residual, in units of the scale, stops counting by its square, and the weight of the squared coefficients.
EPSILON, ALPHA = 1.35, 1e-4
ROUNDS = 100


def _design(features: Sequence[Column]) -> list[Column]:
    return [F.lit(1.0), *features]


def _linear(terms: Sequence[Column], names: Sequence[str]) -> Column:
    out = F.lit(0.0)
    for t, n in zip(terms, names):
        out = out + t * F.col(n)
    return out


def _same(by: Sequence[str]) -> Column:
    out = F.lit(True)
    for b in by:
        out = out & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return out


def _with_numbers(rows: DataFrame, by: Sequence[str], numbers: dict, names: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the numbers of their group as columns ``names``; ``numbers``: a tuple by the group's key."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"_{b} {kinds[b]}" for b in by), *(f"{n} double" for n in names)])
    small = rows.sparkSession.createDataFrame([(*k, *(float(x) for x in v)) for k, v in numbers.items()], schema)
    if not by:
        return rows.crossJoin(F.broadcast(small))
    return rows.join(F.broadcast(small), _same(by), how).drop(*[f"_{b}" for b in by])


def huber_fits(rows: DataFrame, features: Sequence[Column], y: Column, by: Sequence[str] = (), least: int = 10, epsilon: float = EPSILON, alpha: float = ALPHA) -> dict:
    """{group: (intercept, coefficients..., scale)} of robust linear fits, of groups with ``least`` rows or more.

    It minimises sum(s + h(r / s) s) + alpha |w|^2 over the intercept, the coefficients w and the scale s, with
    h the square up to ``epsilon`` and a tangent beyond. With the rows beyond ``epsilon`` held as they are the best
    fit is linear in the scale and the scale a quadratic's root, all from sums; that step is taken as long as it
    lowers the objective, else weighted least squares, which always does. Rows with a null or NaN are left out.
    """
    import numpy as np

    terms = _design([f.cast("double") for f in features])
    names = [f"_t{k}" for k in range(len(terms))]
    held = rows.select(*by, *[t.alias(n) for t, n in zip(terms, names)], y.cast("double").alias("_y"))
    for n in [*names, "_y"]:
        held = held.filter(F.col(n).isNotNull() & ~F.isnan(n))
    held = written(held, "fit")
    p, pairs = len(terms), [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    beta = [f"_b{k}" for k in range(p)]
    ts = [F.col(n) for n in names]
    r = F.col("_y") - _linear(ts, beta)
    inside = F.abs(r) <= epsilon * F.col("_s")
    weight = F.when(inside, 1.0).otherwise(epsilon * F.col("_s") / F.abs(r))
    off = F.when(inside, 0.0).otherwise(F.signum(r))
    some = lambda x: F.sum(F.when(inside, x).otherwise(0.0))
    sums = [
        F.count("*").alias("n"), F.sum(F.when(inside, 0).otherwise(1)).alias("out"), some(F.col("_y") * F.col("_y")).alias("yy"), some(r * r).alias("rr"), F.sum(F.when(inside, 0.0).otherwise(F.abs(r))).alias("far"),
        *[some(ts[i] * ts[j]).alias(f"a{i}{j}") for i, j in pairs], *[some(ts[i] * F.col("_y")).alias(f"g{i}") for i in range(p)], *[F.sum(off * ts[i]).alias(f"d{i}") for i in range(p)],
        *[F.sum(weight * ts[i] * ts[j]).alias(f"w{i}{j}") for i, j in pairs], *[F.sum(weight * ts[i] * F.col("_y")).alias(f"v{i}") for i in range(p)],
    ]

    def matrix(row, letter):
        a = np.zeros((p, p))
        for i, j in pairs:
            a[i, j] = a[j, i] = row[f"{letter}{i}{j}"]
        return a

    penalty = np.diag([0.0] + [alpha] * (p - 1))
    keys = [tuple(k[b] for b in by) for k in held.groupBy(*by).count().filter(F.col("count") >= least).collect()] if by else ([()] if held.limit(least).count() >= least else [])
    now = {k: (np.zeros(p), 1e300) for k in keys}  # at first all rows are inside: plain least squares
    best: dict = {}
    done: dict = {}
    for turn in range(ROUNDS):
        if not now:
            return done
        numbers = {k: (*b, s) for k, (b, s) in now.items()}
        for row in _with_numbers(held, by, numbers, [*beta, "_s"]).groupBy(*by).agg(*sums).collect():
            key = tuple(row[b] for b in by)
            b, s = now[key]
            value = row["n"] * s + row["rr"] / s + 2 * epsilon * row["far"] - epsilon**2 * row["out"] * s + b @ penalty @ b
            if turn > 1 and value > best[key][0] + 1e-12 * abs(best[key][0]):
                now[key] = best[key][2]  # the plain step from the best so far
                continue
            a, g, d = matrix(row, "a"), np.array([row[f"g{i}"] for i in range(p)]), np.array([row[f"d{i}"] for i in range(p)])
            scale = s if turn else 0.0
            w = np.linalg.lstsq(matrix(row, "w") + penalty * scale, np.array([row[f"v{i}"] for i in range(p)]), rcond=None)[0]
            free = row["n"] - epsilon**2 * row["out"]
            plain = (w, np.sqrt(row["rr"] / free) if free > 0 and row["rr"] > 0 else s / 2)
            if turn == 0:
                plain = (w, np.sqrt(max(row["yy"] - 2 * g @ w + w @ a @ w, 0) / row["n"]))
            step = plain
            if turn and free > 0:
                solved = np.linalg.lstsq(a + penalty * scale, np.stack([g, epsilon * d], 1), rcond=None)[0]
                b0, b1 = solved[:, 0], solved[:, 1]
                e0, e1, e2 = row["yy"] - 2 * g @ b0 + b0 @ a @ b0, -2 * g @ b1 + 2 * b0 @ a @ b1, free - b1 @ a @ b1
                root = e1 * e1 + 4 * e2 * max(e0, 0)
                if e2 > 0 and root >= 0 and (e1 + np.sqrt(root)) > 0:
                    new = (e1 + np.sqrt(root)) / (2 * e2)
                    step = (b0 + new * b1, new)
            if turn:
                best[key] = (value, (b, s), plain)
            size = np.abs(b).max() + s
            if step[1] <= 1e-12 * (1 + np.sqrt(row["yy"] / row["n"])):
                done[key] = (*step[0], step[1])  # an exact fit
            elif turn > 1 and np.abs(step[0] - b).max() <= 1e-9 * size and abs(step[1] - s) <= 1e-9 * size:
                done[key] = (*b, s)
            else:
                now[key] = step
        now = {k: v for k, v in now.items() if k not in done}
    raise RuntimeError(f"robust fits of {sorted(map(str, now))[:5]} did not settle in {ROUNDS} rounds")


def huber_by_group(points: DataFrame, cells: DataFrame, by: Sequence[str], z: str = "z", least: int = 10) -> DataFrame:
    """``cells`` with depth moved, in each group, by the mean residual (observed less predicted) and by a robust line of what is left of it on the predicted depth.

    Groups with fewer than ``least`` points keep their depths.
    """
    e = F.col("y_true") - F.col("y_pred")
    valid = points.filter(e.isNotNull() & ~F.isnan(e))
    bias = {tuple(r[b] for b in by): (r["m"],) for r in valid.groupBy(*by).agg(F.avg(e).alias("m"), F.count("*").alias("n")).filter(F.col("n") >= least).collect()}
    centred = _with_numbers(valid, by, bias, ["_m"])
    lines = huber_fits(centred, [F.col("y_pred")], e - F.col("_m"), by, least)
    moves = {k: (v[0] + bias[k][0], v[1]) for k, v in lines.items()}
    out = _with_numbers(cells, by, moves, ["_a", "_c"], "left" if by else "inner") if moves or by else cells.withColumn("_a", F.lit(None)).withColumn("_c", F.lit(None))
    return out.withColumn(z, F.col(z) + F.coalesce(F.col("_a") + F.col("_c") * F.col(z), F.lit(0.0))).drop("_a", "_c")


def polynomial_ransac(points: DataFrame, x: str, y: str, key: str, degree: int = 2, trials: int = 20, share: int = 10, threshold: float | None = None) -> DataFrame:
    """``points`` with ``residual`` of the polynomial of most inliers, fitted again on them, and ``inlier``.

    Each trial fits the points whose hashed key falls in it, one in ``share``. Sums of powers of all trials come from one
    aggregate and the inliers of all from another, a sum a trial; draws depend on keys alone. The threshold is the median
    distance of y from its median by default. Powers are of x less its mean by its deviation.
    """
    import numpy as np

    p = degree + 1
    rows = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    middle, spread = rows.agg(F.avg(x), F.stddev_pop(x)).first()
    if middle is None:
        return points.withColumn("residual", F.lit(None).cast("double")).withColumn("inlier", F.lit(False))
    u = (F.col(x) - float(middle)) / float(spread or 1.0)
    if threshold is None:
        centre = exact_median(rows, y, "m").first()[0]
        threshold = exact_median(rows, F.abs(F.col(y) - float(centre)), "m").first()[0]
    number = lambda t: F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), t.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = F.explode(F.filter(F.sequence(F.lit(0), F.lit(trials - 1)), lambda t: F.pmod(number(t), F.lit(share)) == 0))
    sums = [*[F.sum(F.pow(F.col("_u"), F.lit(float(k)))).alias(f"s{k}") for k in range(2 * degree + 1)], *[F.sum(F.pow(F.col("_u"), F.lit(float(k))) * F.col("_y")).alias(f"t{k}") for k in range(p)]]
    powers = rows.select(u.alias("_u"), F.col(y).cast("double").alias("_y"), F.col(key))

    def solved(r):
        a = np.array([[r[f"s{i + j}"] for j in range(p)] for i in range(p)])
        return [float(v) for v in np.linalg.lstsq(a, np.array([r[f"t{i}"] for i in range(p)]), rcond=None)[0]]

    def value(c, at):
        out = F.lit(0.0)
        for k in reversed(c):
            out = out * at + F.lit(k)
        return out

    fits = {r["trial"]: solved(r) for r in powers.select("_u", "_y", drawn.alias("trial")).groupBy("trial").agg(*sums).collect() if r["s0"] >= p}
    near = lambda c: F.abs(F.col("_y") - value(c, F.col("_u"))) <= float(threshold)
    if fits:
        order = sorted(fits)
        counts = powers.agg(*[F.count_if(near(fits[t])).alias(f"n{t}") for t in order]).first()
        best = fits[max(order, key=lambda t: (counts[f"n{t}"], -t))]
        inliers = powers.filter(near(best))
    else:
        inliers = powers
    final = solved(inliers.agg(*sums).first()) if inliers.limit(p).count() >= p else [0.0] * p
    out = points.withColumn("residual", F.col(y) - value(final, u))
    return out.withColumn("inlier", F.coalesce(F.abs("residual") <= float(threshold), F.lit(False)))


def huber_variance(points: DataFrame, x: str, y: str, key: str, times: float = 3.0, least: float = 0.0025, trials: int = 20) -> DataFrame:
    """``points`` with ``residual`` of a quadratic of most inliers, ``sigma`` and ``accepted`` (within ``times`` sigma).

    Sigma's square is a robust fit of the inliers' squared residual on depth and its square, ``least`` at least.
    """
    fitted = polynomial_ransac(points, x, y, key, 2, trials)
    depth = F.col(y).cast("double")
    lines = huber_fits(fitted.filter("inlier"), [depth, depth * depth], F.col("residual") * F.col("residual"), least=3)
    a, b, c = lines[()][:3] if lines else (least, 0.0, 0.0)
    sigma = F.sqrt(F.greatest(F.lit(float(a)) + F.lit(float(b)) * depth + F.lit(float(c)) * depth * depth, F.lit(least)))
    return fitted.withColumn("sigma", sigma).withColumn("accepted", F.abs("residual") <= times * F.col("sigma")).drop("inlier")
