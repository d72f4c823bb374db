"""Boundary semantics of the column expressions, rounding helpers and naming."""
from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.functions import columns as C
from cohortlens.functions import distance as D
from cohortlens.operators import naming as NM


def test_rule_segment_boundaries(spark):
    rows = [(70, 60), (70, 59), (69, 100), (40, 1), (39, 55), (39, 54), (100, 59), (0, 100)]
    df = spark.createDataFrame(rows, "income_k int, score int")
    got = [r[0] for r in df.select(C.rule_segment()).collect()]
    assert got == [S.VIP, S.NEW, S.LOYAL, S.LOYAL, S.DISCOUNT, S.AT_RISK, S.NEW, S.DISCOUNT]


def test_band_boundaries(spark):
    df = spark.createDataFrame([(60, 30, 70), (59, 31, 69), (35, 45, 45), (34, 46, 44)],
                               "score int, age int, income_k int")
    got = [tuple(r) for r in df.select(C.r_band(), C.f_band(), C.m_band()).collect()]
    assert got == [("High", "High", "High"), ("Moderate", "Moderate", "Moderate"),
                   ("Moderate", "Moderate", "Moderate"), ("Low", "Low", "Low")]


def test_exact_half_up_rounding(spark):
    df = spark.createDataFrame([(1, 8), (3, 8), (1005, 1000), (2, 3), (0, 7)], "num long, den long")
    got = [tuple(r) for r in df.select(C.ratio_round("num", "den", 2), C.pct_round("num", "den", 1),
                                       C.int_round("num", "den")).collect()]
    # 1/8 = 0.125 -> 0.13 (half up, where binary half-even would give 0.12)
    assert got[0] == (0.13, 12.5, 0)
    assert got[1] == (0.38, 37.5, 0)
    assert got[2] == (1.01, 100.5, 1)   # 1.005 -> 1.01 exactly
    assert got[3] == (0.67, 66.7, 1)
    assert got[4] == (0.0, 0.0, 0)


def test_gender_and_number_normalisation(spark):
    df = spark.createDataFrame([(" female ",), ("MALE\t",), (None,), ("NA",), ("",), ("robot",)], "g string")
    assert [r[0] for r in df.select(C.normalize_gender("g")).collect()] == \
        ["Female", "Male", "Nan", "Nan", "Nan", "Robot"]
    nums = spark.createDataFrame([("66.0",), (" 12 ",), ("NaN",), ("abc",), (None,), ("-3",)], "x string")
    assert [r[0] for r in nums.select(C.to_number("x")).collect()] == [66.0, 12.0, None, None, None, -3.0]


def test_nearest_center_ties_go_to_lowest_id(spark):
    df = spark.createDataFrame([(26.0, 50.0), (87.0, 82.0)], "x double, y double")
    centers = [[87, 82], [88, 17], [55, 50], [26, 79], [26, 21]]
    idx, d2 = D.nearest(["x", "y"], centers)
    got = [tuple(r) for r in df.select(idx, d2).collect()]
    assert got[0][0] == 2 and got[0][1] == 29.0 ** 2   # equidistant from centers 2, 3 and 4
    assert got[1] == (0, 0.0)


def test_greedy_naming_is_a_bijection_with_lowest_id_ties():
    cents = [(86.5, 82.1), (26.3, 20.9), (88.2, 17.1), (25.7, 79.4), (55.3, 49.5)]
    assert NM.greedy_names(cents) == {0: S.VIP, 1: S.AT_RISK, 2: S.NEW, 3: S.DISCOUNT, 4: S.LOYAL}
    assert NM.greedy_names([(50.0, 50.0)] * 5) == dict(enumerate([S.VIP, S.AT_RISK, S.NEW, S.DISCOUNT, S.LOYAL]))


def test_yeo_johnson_lambda_is_the_maximum_in_six_passes(spark, monkeypatch):
    """Against a golden-section search of the likelihood itself, for skewed, signed and constant features."""
    import math
    import numpy as np
    from cohortlens.operators import scaling

    rng = np.random.default_rng(5)
    cols = {"skewed": rng.lognormal(1, 0.7, 400), "signed": rng.normal(-1, 2, 400), "left": -rng.gamma(2, 3, 400),
            "steep": np.full(400, 1.0) + 1e-3 * rng.random(400) ** 8}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols.values())], list(cols)).repartition(3)
    seen = []
    one_pass = scaling._yj_pass
    monkeypatch.setattr(scaling, "_yj_pass", lambda *a: seen.append(1) or one_pass(*a))
    model = scaling.fit_yeo_johnson(df, list(cols))
    assert len(seen) <= 6

    def loglik(x, lm):
        y = np.where(x >= 0, (np.power(np.abs(x) + 1, lm) - 1) / lm, -(np.power(np.abs(x) + 1, 2 - lm) - 1) / (2 - lm))
        return -0.5 * len(x) * math.log(y.var()) + (lm - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    for name, x in list(cols.items())[:3]:
        a, b, g = -2.99, 2.99, (math.sqrt(5) - 1) / 2
        for _ in range(60):
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if loglik(x, c) > loglik(x, d) else (c, b)
        got = model.lambdas[list(cols).index(name)]
        assert abs(got - a) < 1e-5  # the search itself is flat to about 1e-7 there
        slope = one_pass(df, [name], [[got]], 3)[0][0][1]
        assert abs(slope) < 1e-6
    assert model.lambdas[3] == -3.0  # a likelihood that rises to the end of the range


def test_quantile_normal_as_columns_equals_interpolation_and_the_normal_quantile(spark):
    """Repeated knots, values at, between and beyond them, nulls and NaN; no Python worker in the plan."""
    from statistics import NormalDist
    import numpy as np
    from cohortlens.operators.scaling import QuantileNormal

    knots = [-2.0, -2.0, 0.0, 0.5, 0.5, 0.5, 3.0, 7.0, 7.0, 10.0]
    refs = [i / 9 for i in range(10)]
    values = [-5.0, -2.0, -1.9, -1e-9, 0.0, 0.2, 0.5, 0.50001, 2.9, 3.0, 6.0, 7.0, 9.999999, 10.0, 11.0]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double").repartition(2)
    out = QuantileNormal(["x"], refs, {"x": knots}).transform(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {str(r.x): r.z_x for r in out.collect()}
    q, r = np.array(knots), np.array(refs)
    for v in values:
        p = 0.5 * (np.interp(v, q, r) - np.interp(-v, -q[::-1], -r[::-1]))
        p = 0.0 if v <= q[0] else 1.0 if v >= q[-1] else p
        want = NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7))
        assert abs(got[str(v)] - want) < 1e-8 * max(1, abs(want)), v
    assert got["None"] is None and got["nan"] is None
