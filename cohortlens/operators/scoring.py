"""Scoring: request validation, nearest center, segment label, confidence, similar customers.

A fitted segmentation is small driver-side state (k centers, 2 scales, k
names), exactly like a Spark ML model; scoring inlines it as literals so a
batch (or a stream) is scored by one projection plus a broadcast join with
the k-row cluster map, with no exchange.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..functions import distance as D
from . import lookups
from .cluster import MixtureFit, mixture_label
from .scaling import LinearScaler, QuantileNormal, YeoJohnson, scaler_from_dict


@dataclass
class SegmentModel:
    """Centers in ORIGINAL units, the scaler used for assignment, and cluster names.

    ``scaled_centers`` are the centers (or mixture means) in scaled units, needed
    where the scaler is not linear; ``mixture`` assigns by posterior instead of by
    distance.
    """
    scaler: LinearScaler | QuantileNormal | YeoJohnson
    centers: list[list[float]]
    segment_map: dict[int, str] = field(default_factory=dict)
    variant: str = "kmeans"
    n_iter: int = 0
    inertia: float | None = None
    scaled_centers: list[list[float]] | None = None
    mixture: MixtureFit | None = None

    @property
    def features(self) -> list[str]:
        return self.scaler.features

    @property
    def k(self) -> int:
        return len(self.centers)

    def to_json(self) -> str:
        return json.dumps({"scaler": self.scaler.to_dict(), "centers": self.centers,
                           "segment_map": {str(k): v for k, v in self.segment_map.items()},
                           "variant": self.variant, "n_iter": self.n_iter, "inertia": self.inertia,
                           "scaled_centers": self.scaled_centers,
                           "mixture": None if self.mixture is None else vars(self.mixture)})

    @staticmethod
    def from_json(text: str) -> "SegmentModel":
        d = json.loads(text)
        return SegmentModel(scaler_from_dict(d["scaler"]), [list(map(float, c)) for c in d["centers"]],
                            {int(k): v for k, v in d["segment_map"].items()}, d.get("variant", "kmeans"),
                            int(d.get("n_iter", 0)), d.get("inertia"), d.get("scaled_centers"),
                            MixtureFit(**d["mixture"]) if d.get("mixture") else None)


class IncompatibleModel(RuntimeError):
    pass


def check_compatible(model: SegmentModel, features: list[str]) -> None:
    """The scaler width must equal the feature count and the names must be the five segments."""
    if model.scaler.n_features_in != len(features):
        raise IncompatibleModel(f"scaler expects {model.scaler.n_features_in} features, got {len(features)}")
    if set(model.segment_map.values()) != set(S.SEGMENTS):
        raise IncompatibleModel(f"segment names {sorted(model.segment_map.values())} are not the expected five")


def fixed_center_model(scaler: LinearScaler) -> SegmentModel:
    """The five reference centers with their names (cluster ids in list order)."""
    centers = [[x, y] for _, x, y in S.FIXED_CENTERS]
    names = {i: n for i, (n, _, _) in enumerate(S.FIXED_CENTERS)}
    return SegmentModel(scaler, centers, names, variant="fixed")


# ---------------------------------------------------------------------------
# C12 request validation
# ---------------------------------------------------------------------------
def request_reject_reason(age="age", income="income", score="score") -> Column:
    """First failing range check (NaN never lies in a range, so it is rejected too)."""
    a, i, s = F.col(age), F.col(income), F.col(score)
    return (
        F.when(a.isNull() | F.isnan(a) | ~a.between(S.AGE_MIN, S.AGE_MAX), S.MSG_REQ_AGE)
        .when(i.isNull() | F.isnan(i) | ~i.between(0, S.REQUEST_INCOME_MAX), S.MSG_REQ_INCOME)
        .when(s.isNull() | F.isnan(s) | ~s.between(S.SCORE_MIN, S.SCORE_MAX), S.MSG_REQ_SCORE)
    )


def validate_requests(req: DataFrame) -> DataFrame:
    return req.withColumn("reject_reason", request_reject_reason())


# ---------------------------------------------------------------------------
# F6 / K15 / K16 scoring
# ---------------------------------------------------------------------------
def assign(df: DataFrame, model: SegmentModel, cols: list[str] | None = None,
           scaled: bool = True, centers: list[list[float]] | None = None) -> DataFrame:
    """Add ``cluster`` (nearest center, ties to the lowest id) and ``d2`` (its squared distance).

    ``scaled`` measures distance in standardised units, ``(x - c) / s``, the
    space the model was fitted in; otherwise in original units.
    """
    cols = cols or model.features
    if scaled and (model.mixture is not None or not isinstance(model.scaler, LinearScaler)):
        return _assign_scaled(df, model, cols)
    scales = model.scaler.scale if scaled else None
    d = D.distance_array(cols, centers if centers is not None else model.centers, scales)
    out = df.withColumn("_d", d)
    return (out.withColumn("cluster", D.nearest_index(F.col("_d")))
            .withColumn("d2", F.array_min(F.col("_d"))).drop("_d"))


def _assign_scaled(df: DataFrame, model: SegmentModel, cols: list[str]) -> DataFrame:
    """Assignment in the scaler's own units: posterior of a mixture, else distance to the scaled centers."""
    names = df.columns
    z = [f"_z_{f}" for f in model.features]
    named = df.select("*", *[F.col(c).alias(f"_x_{f}") for c, f in zip(cols, model.features)])
    renamed = named.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(names)],
                           *[F.col(f"_x_{f}").alias(f) for f in model.features])
    out = model.scaler.transform(renamed, prefix="_z_").select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(names)], *z)
    d = F.array(*[sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(z, center)), F.lit(0.0))
                  for center in model.scaled_centers])
    cluster = mixture_label(z, model.mixture) if model.mixture is not None else D.nearest_index(d)
    return out.withColumn("cluster", cluster).withColumn("d2", F.element_at(d, F.col("cluster") + 1)).drop(*z)


def label(df: DataFrame, model: SegmentModel) -> DataFrame:
    """cluster id -> segment name, broadcast left join with the k-row map."""
    return df.join(lookups.cluster_map(df.sparkSession, model.segment_map), "cluster", "left")


def own_center_distance(model: SegmentModel, cols: list[str] | None = None) -> Column:
    """Euclidean distance in ORIGINAL units to the assigned center."""
    cols = cols or model.features
    idx = F.col("cluster") + 1
    total = None
    for j, c in enumerate(cols):
        cj = F.element_at(F.array(*[F.lit(float(ctr[j])) for ctr in model.centers]), idx)
        term = (F.col(c) - cj) * (F.col(c) - cj)
        total = term if total is None else total + term
    return F.sqrt(total)


def score(df: DataFrame, model: SegmentModel, cols: list[str] | None = None) -> DataFrame:
    """K15 + K16: cluster, segment, distance to its center and confidence."""
    out = assign(df, model, cols)
    out = out.withColumn("dist", own_center_distance(model, cols)).withColumn("confidence", C.confidence("dist"))
    return label(out, model)


def similar_table(customers: DataFrame, n: int = S.SIMILAR_LIMIT) -> DataFrame:
    """First ``n`` customers (by id) of every cluster, one row per cluster (k rows).

    The window runs with a rank limit, so each map task forwards at most n
    rows per cluster; the result is bounded by k * n and safe to broadcast.
    """
    from .reports import first_per_group
    top = first_per_group(customers, "cluster", n=n,
                          cols=[S.CUSTOMER_ID, S.GENDER, S.AGE, S.INCOME, S.SCORE, "cluster"])
    return top.groupBy("cluster").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", S.CUSTOMER_ID, S.GENDER, S.AGE, S.INCOME, S.SCORE))),
            lambda x: x.dropFields("rank")).alias("similar"))


def score_with_similar(requests: DataFrame, customers_scored: DataFrame, model: SegmentModel) -> DataFrame:
    """Scored record with strategy, action, color, behaviour and 5 similar customers."""
    scored = score(requests, model)
    attrs = lookups.segment_attributes(requests.sparkSession)
    sim = F.broadcast(similar_table(customers_scored))
    return (scored.join(attrs, "segment", "left").join(sim, "cluster", "left"))
