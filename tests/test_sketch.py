"""Quantile sketches: exact while small, bounded rank error beyond, merged increments that run twice, nulls and NaN."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import scaling as SC
from cohortlens.operators import sketch
from cohortlens.session import fresh_path


def test_knots_are_exact_while_the_sketch_holds_all_values(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.lognormal(0, 2, 700), np.repeat(2.5, 200)])
    rows = [(float(v), float(round(v))) for v in x] + [(None, 4.0), (float("nan"), None)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(7)
    state = sketch.sketch(df, ["a", "b"])
    n = sketch.counts(state)
    assert n == {"a": 900, "b": 901}
    found = sketch.knots(state, {"a": 11, "b": 30}, n)
    assert np.allclose(found["a"], np.quantile(x, np.linspace(0, 1, 11)), rtol=1e-12, atol=0)
    assert np.allclose(found["b"], np.quantile(np.append(np.round(x), 4.0), np.linspace(0, 1, 30)))


def test_increments_merge_and_replay(spark):
    df = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(500))).cast("double").alias("x"), "id")
    base = fresh_path(spark, "test-sketch")
    for step in (0, 1, 1, 2):  # the second step runs again after a crash
        state = sketch.take_increment(df.filter(F.col("id") % 3 == step), ["x"], base, step)
    whole = SC.fit_quantile_normal(df, ["x"])
    assert SC.quantile_normal_of(state).to_dict() == whole.to_dict() and sketch.counts(state) == {"x": 3000}


def test_rank_error_beyond_the_sketch(spark):
    n = 1_500_000  # distinct values 0..n-1, so a value is its own rank
    df = spark.range(n).select(F.col("id").cast("double").alias("x"), "id")
    parts = [sketch.sketch(df.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == i), ["x"]) for i in range(3)]
    state = sketch.merge(sketch.merge(parts[0], parts[1]), parts[2])
    knots = sketch.knots(state, {"x": 1000}, {"x": n})["x"]
    assert max(abs(v - i * (n - 1) / 999) for i, v in enumerate(knots)) / n < 1e-4


def test_a_feature_without_values_has_no_scaler(spark):
    df = spark.createDataFrame([(1.0, None)], "x double, y double")
    with pytest.raises(ValueError, match="at least one value"):
        SC.fit_quantile_normal(df, ["x", "y"])
    with pytest.raises(ValueError, match="at least one value"):
        SC.fit_quantile_normal(df.limit(0), ["x", "y"])
