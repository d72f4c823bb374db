"""Quantile sketches as stored state: one mergeable KLL sketch per feature.

A task folds its rows into one sketch per feature (Spark's own aggregate); sketches of tasks, files or days merge
into one of the same size, so a new day is read once and the days before it never again.  Up to ``SKETCH_K`` values a
sketch holds them all and its answers are exact; beyond, a quantile's rank is off by less than 1e-4 of the rows.
Nulls and NaN are not counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_K = 65_535
_FAN_IN = 64


def sketch(df: DataFrame, features, k: int = SKETCH_K) -> DataFrame:
    """One row with a sketch per feature, in two levels: at most ``_FAN_IN`` merged sketches meet in the last task."""
    parts = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(_FAN_IN)).alias("part")).agg(
        *[F.kll_sketch_agg_double(F.nanvl(F.col(f).cast("double"), F.lit(None)), k).alias(f) for f in features])
    return parts.agg(*[F.kll_merge_agg_double(f, k).alias(f) for f in features])


def merge(one: DataFrame, two: DataFrame, k: int = SKETCH_K) -> DataFrame:
    return one.unionByName(two).agg(*[F.kll_merge_agg_double(f, k).alias(f) for f in one.columns])


def take_increment(df: DataFrame, features, base: str, number: int, k: int = SKETCH_K) -> DataFrame:
    """Version ``number`` of the sketches below ``base``: the version before it and the rows of ``df``.

    Run again, a step starts from the version below its number and replaces its own.
    """
    from ..sinks import versions
    new, old = sketch(df, features, k), versions.before(df.sparkSession, base, number)
    return versions.write(new if old is None else merge(old, new, k), base, number)


def counts(state: DataFrame) -> dict[str, int]:
    row = state.select(*[F.kll_sketch_get_n_double(f).alias(f) for f in state.columns]).first()
    return {f: int(row[f] or 0) for f in state.columns}


def order_statistics(state: DataFrame, ranks: dict[str, list[int]], n: dict[str, int]) -> dict[str, list[float]]:
    """Per feature the values at the given ranks (from 0) of its ``n`` sorted values; none for a feature without values."""
    asked = [f for f in ranks if n[f]]
    # the middle of a rank's share of the rows, so that no rounding moves it to a neighbour
    shares = {f: F.split(F.lit(",".join(repr((r + 0.5) / n[f]) for r in ranks[f])), ",").cast("array<double>") for f in asked}
    if not asked:
        return {f: [] for f in ranks}
    row = state.select(*[F.kll_sketch_get_quantile_double(F.col(f), shares[f]).alias(f) for f in asked]).first()
    return {f: [float(v) for v in row[f]] if f in asked else [] for f in ranks}


def knots(state: DataFrame, n_knots: dict[str, int], n: dict[str, int]) -> dict[str, list[float]]:
    """Evenly spaced quantiles of each feature, linear between ranks (the ranks themselves are whole-number arithmetic)."""
    places = {}
    for f in n:
        step = n_knots[f] - 1
        places[f] = [divmod(i * (n[f] - 1), step) for i in range(n_knots[f])] if n[f] else []
    found = order_statistics(state, {f: [r for at, rest in p for r in (at, at + (rest > 0))] for f, p in places.items()}, n)
    out = {}
    for f, p in places.items():
        pairs = zip(found[f][::2], found[f][1::2])
        out[f] = [low + (high - low) * (rest / (n_knots[f] - 1)) for (low, high), (_, rest) in zip(pairs, p)]
    return out
