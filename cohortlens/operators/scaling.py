"""Feature scaling: standard (population std), robust, quantile-normal, Yeo-Johnson.

Fitting is one aggregate pass (a single row of statistics per model);
applying is a column expression.  Lazy forms use scalar subqueries so the
statistics are computed once per query without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import sketch


@dataclass
class LinearScaler:
    """``z = (x - center) / scale`` per feature (standard and robust scalers)."""
    kind: str
    features: list[str]
    center: list[float]
    scale: list[float]
    n_rows: int | None = None  # rows seen when fitting (saves a count pass downstream)

    def transform_cols(self, prefix: str = "z_") -> list[Column]:
        return [((F.col(f) - F.lit(c)) / F.lit(s)).alias(f"{prefix}{f}")
                for f, c, s in zip(self.features, self.center, self.scale)]

    def transform(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        return df.select("*", *self.transform_cols(prefix))

    def inverse(self, point) -> list[float]:
        """Map a point (e.g. a cluster center) back to original units."""
        return [float(v) * s + c for v, c, s in zip(point, self.center, self.scale)]

    def to_dict(self) -> dict:
        return {"kind": self.kind, "features": self.features, "center": self.center, "scale": self.scale}

    @staticmethod
    def from_dict(d: dict) -> "LinearScaler":
        return LinearScaler(d["kind"], list(d["features"]), list(d["center"]), list(d["scale"]))

    @property
    def n_features_in(self) -> int:
        return len(self.features)


def _nonzero(s) -> float:
    s = float(s) if s is not None else 0.0
    return s if s > 0 and math.isfinite(s) else 1.0


def fit_standard(df: DataFrame, features=S.FEATURES) -> LinearScaler:
    """Mean and POPULATION standard deviation (a zero scale becomes 1)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in features:
        aggs += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")]
    row = df.agg(*aggs).first()
    return LinearScaler("standard", list(features), [float(row[f"m_{f}"]) for f in features],
                        [_nonzero(row[f"s_{f}"]) for f in features], int(row["_n"]))


def standard_scale_lazy(df: DataFrame, features=S.FEATURES, prefix: str = "z_") -> DataFrame:
    """J1 as one lazy plan: the moments are scalar subqueries over ``df``."""
    cols = []
    for f in features:
        mean = df.select(F.avg(f)).scalar()
        std = df.select(F.stddev_pop(f)).scalar()
        std = F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std)
        cols.append(((F.col(f) - mean) / std).alias(f"{prefix}{f}"))
    return df.select("*", *cols)


def exact_quantiles(df: DataFrame, features, probabilities, bins: int = 1024) -> dict[str, list[float]]:
    """Exact quantiles (linear between ranks) in bounded memory, a few passes for all features at once.

    Each wanted rank starts with the whole value range.  A pass counts the values
    of every range in ``bins`` bins, and the range shrinks to the bin of its rank,
    until it holds one value.  The driver gets one row per range and bin.
    """
    first = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]).first()
    ranges = {}  # (feature, rank) -> [low, high, rows below low]
    for c in features:
        n = int(first[f"n_{c}"] or 0)
        for p in probabilities if n else []:
            at = p * (n - 1)
            for rank in (math.floor(at), math.ceil(at)):
                ranges[c, rank] = [float(first[f"lo_{c}"]), float(first[f"hi_{c}"]), 0]
    while open_ := {(c, lo, hi) for (c, _), (lo, hi, _) in ranges.items() if lo < hi}:
        cells = []
        for c, lo, hi in sorted(open_):
            v = F.col(c).cast("double")
            b = F.least(F.lit(bins - 1), F.floor((v - lo) / F.lit((hi - lo) / bins))).cast("int")
            cells.append(F.when(v.between(lo, hi), F.struct(F.lit(c).alias("c"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                                                            b.alias("b"), v.alias("v"))))
        counted = (df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
                   .groupBy("c", "lo", "hi", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
                   .orderBy("c", "lo", "hi", "b").collect())
        for (c, rank), state in ranges.items():
            below = state[2]
            for r in (r for r in counted if (r["c"], r["lo"], r["hi"]) == (c, state[0], state[1])):
                if below + r["n"] > rank:
                    ranges[c, rank] = [r["min"], r["max"], below]
                    break
                below += r["n"]
    out: dict[str, list[float]] = {}
    for c in features:
        n = int(first[f"n_{c}"] or 0)
        out[c] = []
        for p in probabilities if n else []:
            at = p * (n - 1)
            low, high = ranges[c, math.floor(at)][0], ranges[c, math.ceil(at)][0]
            out[c].append(low + (high - low) * (at - math.floor(at)))
    return out


def fit_robust(df: DataFrame, features=S.FEATURES) -> LinearScaler:
    """Median and inter-quartile range, exact."""
    found = exact_quantiles(df, list(features), [0.25, 0.5, 0.75])
    center = [found[f][1] for f in features]
    return LinearScaler("robust", list(features), center, [_nonzero(found[f][2] - found[f][0]) for f in features])


# ---------------------------------------------------------------------------
# J3 quantile -> normal
# ---------------------------------------------------------------------------
_BOUND = 1e-7

# Coefficients of Acklam's rational approximation of the
# inverse standard normal CDF (public algorithm).
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
      1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
      6.680131188771972e01, -1.328068155288572e01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
      -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def norm_ppf_col(p: Column) -> Column:
    """Inverse standard normal CDF as a column expression (rational approximation, |rel err| < 1.2e-9)."""
    def poly(coefficients: list[float], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + F.lit(c)
        return out

    def tail(side: Column) -> Column:
        q = F.sqrt(-2 * F.log(side))
        return poly(_C, q) / poly([*_D, 1.0], q)

    lo = 0.02425
    q = p - 0.5
    return (F.when(p < lo, tail(p)).when(p > 1 - lo, -tail(1 - p))
            .otherwise(poly(_A, q * q) * q / poly([*_B, 1.0], q * q)))


def _doubles(values: list[float]) -> Column:
    """A literal array (folded by the planner), whatever its length."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _count_knots(knots: Column, n: int, x: Column, equal: bool) -> Column:
    """How many of ``n`` ascending knots lie below ``x``, with ``equal`` also at it: by bisection."""
    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        up = F.get(knots, mid) <= x if equal else F.get(knots, mid) < x
        return (F.when(acc["lo"] >= acc["hi"], acc)
                .when(up, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))
                .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi"))))

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), start, halve)["lo"]


def empirical_cdf_col(x: Column, knots: list[float], references: list[float]) -> Column:
    """The share at ``x`` by interpolation between knots; at repeated knots the middle of their shares; NULL for NaN."""
    q, r, n = _doubles(knots), _doubles(references), len(knots)

    def share(at: Column) -> Column:
        le, lt = at["le"], at["lt"]
        a, b = F.get(q, le - 1), F.get(q, le)
        slope = (F.get(r, le) - F.get(r, le - 1)) / (b - a)
        return F.when(le > lt, (F.get(r, le - 1) + F.get(r, lt)) / 2).otherwise(F.get(r, le - 1) + slope * (x - a))

    counts = F.struct(_count_knots(q, n, x, True).alias("le"), _count_knots(q, n, x, False).alias("lt"))
    inside = F.get(F.transform(F.array(counts), share), F.lit(0))  # counted once a row
    return (F.when(F.isnan(x), F.lit(None).cast("double")).when(x <= float(knots[0]), 0.0)
            .when(x >= float(knots[-1]), 1.0).when(x.isNotNull(), inside))


@dataclass
class QuantileNormal:
    """Map each feature through its empirical CDF, then the normal quantile function."""
    features: list[str]
    references: list[float]
    quantiles: dict[str, list[float]] = field(default_factory=dict)

    kind = "quantile_normal"

    @property
    def n_features_in(self) -> int:
        return len(self.features)

    def to_dict(self) -> dict:
        return {"kind": self.kind, "features": self.features, "references": self.references, "quantiles": self.quantiles}

    def inverse(self, point) -> list[float]:
        """The normal CDF, then the value at that quantile."""
        p = [0.5 * (1 + math.erf(float(v) / math.sqrt(2))) for v in point]
        return [float(np.interp(q, self.references, self.quantiles[f])) for q, f in zip(p, self.features)]

    def transform(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        def normal(share: Column) -> Column:  # greatest() skips nulls, which are to stay
            return F.when(share.isNotNull(), norm_ppf_col(F.greatest(F.lit(_BOUND), F.least(F.lit(1 - _BOUND), share))))

        def make(f: str) -> Column:
            share = empirical_cdf_col(F.col(f).cast("double"), self.quantiles[f], self.references)
            return F.get(F.transform(F.array(share), normal), F.lit(0))  # the share is made once a row

        return df.select("*", *[make(f).alias(f"{prefix}{f}") for f in self.features])


def fit_quantile_normal(df: DataFrame, features=S.FEATURES) -> QuantileNormal:
    """Quantile knots of a mergeable sketch, filled in one pass over all rows."""
    from ..session import materialize
    return quantile_normal_of(materialize(sketch.sketch(df, list(features)), "quantile-sketch"))


def quantile_normal_of(state: DataFrame) -> QuantileNormal:
    """The scaler of a stored sketch state; ``n_quantiles = max(10, min(1000, n))``, knots linear between ranks."""
    n = sketch.counts(state)
    if not all(n.values()):
        raise ValueError("a quantile scaler needs at least one value of each feature")
    nq = max(10, min(1000, max(n.values())))
    return QuantileNormal(list(n), [i / (nq - 1) for i in range(nq)], sketch.knots(state, dict.fromkeys(n, nq), n))


# ---------------------------------------------------------------------------
# J4 Yeo-Johnson
# ---------------------------------------------------------------------------
def yeo_johnson_col(x: Column, lmbda: float) -> Column:
    pos = x >= 0
    if abs(lmbda) < 1e-12:
        yp = F.log1p(x)
    else:
        yp = (F.pow(x + 1, F.lit(lmbda)) - 1) / F.lit(lmbda)
    if abs(lmbda - 2) < 1e-12:
        yn = -F.log1p(-x)
    else:
        yn = -(F.pow(-x + 1, F.lit(2 - lmbda)) - 1) / F.lit(2 - lmbda)
    return F.when(pos, yp).otherwise(yn)


def yeo_johnson_inverse(y: float, lmbda: float) -> float:
    """The x with yeo_johnson(x) = y; values beyond the transform's range give its limit."""
    if y >= 0:
        return math.expm1(y) if abs(lmbda) < 1e-12 else max(y * lmbda + 1, 1e-300) ** (1 / lmbda) - 1
    if abs(lmbda - 2) < 1e-12:
        return -math.expm1(-y)
    return 1 - max(1 - (2 - lmbda) * y, 1e-300) ** (1 / (2 - lmbda))


@dataclass
class YeoJohnson:
    features: list[str]
    lambdas: list[float]
    means: list[float]
    stds: list[float]
    kind = "power_yeo_johnson"

    @property
    def n_features_in(self) -> int:
        return len(self.features)

    def to_dict(self) -> dict:
        return {"kind": self.kind, "features": self.features, "lambdas": self.lambdas, "means": self.means, "stds": self.stds}

    def inverse(self, point) -> list[float]:
        """Undo the standardisation, then the power transform."""
        return [yeo_johnson_inverse(float(v) * s + m, lm)
                for v, m, s, lm in zip(point, self.means, self.stds, self.lambdas)]

    def transform(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        cols = []
        for f, lm, m, s in zip(self.features, self.lambdas, self.means, self.stds):
            cols.append(((yeo_johnson_col(F.col(f), lm) - F.lit(m)) / F.lit(s)).alias(f"{prefix}{f}"))
        return df.select("*", *cols)


def _phi(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(e^t - 1) / t and its first two derivatives; near 0 by their series, where the quotients cancel."""
    near = np.abs(t) < 0.5
    far = np.where(near, 1.0, t)
    e = np.exp(far)
    p0 = np.expm1(far) / far
    p1 = (e - p0) / far
    p2 = (e - 2 * p1) / far
    small = np.where(near, t, 0.0)
    term = [1 / math.factorial(k + 1) for k in range(16)]
    return tuple(np.where(near, np.polyval(c[::-1], small), p) for c, p in (
        (term, p0), ([k * v for k, v in enumerate(term)][1:], p1), ([k * (k - 1) * v for k, v in enumerate(term)][2:], p2)))


def _yj_part(X, points):
    """Sums over a task's rows, per feature: n, the Jacobian's log, and for each lambda those of y and y^2 with two derivatives."""
    out = []
    for x, lambdas in zip(X.T, points):
        u, pos = np.log1p(np.abs(x)), x >= 0
        out += [float(len(x)), float((np.sign(x) * u).sum())]
        sign = np.where(pos, 1.0, -1.0)
        for lm in lambdas:  # y = sign * u * phi(m u) with m = lambda, or 2 - lambda below 0
            p0, p1, p2 = _phi(np.where(pos, lm, 2 - lm) * u)
            y, d1, d2 = sign * u * p0, u ** 2 * p1, sign * u ** 3 * p2
            out += [float(v.sum()) for v in (y, d1, d2, y * y, y * d1, d1 * d1 + y * d2)]
    return np.array(out)


def _yj_pass(df: DataFrame, features, points: list[list[float]], tasks: int) -> list[list[tuple[float, float, float]]]:
    """(profile log-likelihood, first, second derivative) at every feature's lambdas, all in ONE pass."""
    from .partials import batch_sums
    width = sum(2 + 6 * len(p) for p in points)
    sums, out, at = batch_sums(df, list(features), _yj_part, width, points, tasks), [], 0
    for lambdas in points:
        n, jac = sums[at], sums[at + 1]
        found = []
        for i, lm in enumerate(lambdas):
            s0, s1, s2, q0, q1, q2 = (v / n for v in sums[at + 2 + 6 * i:at + 8 + 6 * i])
            var = max(q0 - s0 * s0, 1e-300)
            v1, v2 = 2 * (q1 - s0 * s1) / var, 2 * (q2 - s1 * s1 - s0 * s2) / var
            found.append((-0.5 * n * math.log(var) + (lm - 1) * jac, -0.5 * n * v1 + jac, -0.5 * n * (v2 - v1 * v1)))
        out.append(found)
        at += 2 + 6 * len(lambdas)
    return out


def fit_yeo_johnson(df: DataFrame, features=S.FEATURES, lo: float = -3.0, hi: float = 3.0,
                    steps: int = 13, passes: int = 6, close: float = 1e-9) -> YeoJohnson:
    """Lambda by maximum likelihood: one pass over a coarse grid, then Newton steps for all features together.

    A step that leaves the bracket around the best grid point, or that the curvature does not support, halves the
    bracket instead.  A maximum at an end of [lo, hi] gives that end.  At most ``passes`` passes in all.
    """
    from .partials import task_count
    tasks = task_count(df)
    grid = [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]
    state = []  # per feature: lambda, its derivatives, bracket, done
    for found in _yj_pass(df, features, [grid] * len(features), tasks):
        k = int(np.argmax([f[0] for f in found]))
        state.append([grid[k], found[k][1], found[k][2], grid[max(k - 1, 0)], grid[min(k + 1, steps - 1)], False])
    for left in range(passes - 1, -1, -1):
        for st in state:
            lm, d1, d2, a, b, done = st
            if done:
                continue
            a, b = (lm, b) if d1 > 0 else (a, lm)
            new = lm - d1 / d2 if d2 < 0 else 0.5 * (a + b)
            if not a <= new <= b:
                new = b if b == hi and d1 > 0 else a if a == lo and d1 < 0 else 0.5 * (a + b)
            st[:] = [new, d1, d2, a, b, abs(new - lm) <= close]
        if left == 0 or all(st[5] for st in state):
            break
        for st, found in zip(state, _yj_pass(df, features, [[st[0]] for st in state], tasks)):
            st[1:3] = found[0][1:]
    return yeo_johnson_at(df, [st[0] for st in state], features)


def yeo_johnson_at(df: DataFrame, lambdas: list[float], features=S.FEATURES) -> YeoJohnson:
    """J4 at given lambdas: the transformed features' mean and population deviation (one aggregate)."""
    stats = df.agg(*[F.avg(yeo_johnson_col(F.col(f), lm)).alias(f"m{i}")
                     for i, (f, lm) in enumerate(zip(features, lambdas))],
                   *[F.stddev_pop(yeo_johnson_col(F.col(f), lm)).alias(f"s{i}")
                     for i, (f, lm) in enumerate(zip(features, lambdas))]).first()
    return YeoJohnson(list(features), list(lambdas), [float(stats[f"m{i}"]) for i in range(len(features))],
                      [_nonzero(stats[f"s{i}"]) for i in range(len(features))])


def scaler_from_dict(d: dict) -> "LinearScaler | QuantileNormal | YeoJohnson":
    """The fitted preprocessor that ``to_dict`` described."""
    if d["kind"] == QuantileNormal.kind:
        return QuantileNormal(list(d["features"]), list(d["references"]), {f: list(v) for f, v in d["quantiles"].items()})
    if d["kind"] == YeoJohnson.kind:
        return YeoJohnson(list(d["features"]), list(d["lambdas"]), list(d["means"]), list(d["stds"]))
    return LinearScaler.from_dict(d)
