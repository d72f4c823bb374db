"""Distance and nearest-center expressions over a small, driver-known center list.

The k centers (k is 2..10 here) are literals inlined into the expression, the
way Spark ML ships model centers to executors: there is no join and no
exchange, and the expression stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sq_dist(cols: Sequence, center: Sequence[float], scales: Sequence[float] | None = None) -> Column:
    """Squared Euclidean distance of ``cols`` to ``center``.

    With ``scales`` given, every axis is divided by its scale first, so the
    distance is measured in standardised units while the center stays in
    original units (``(x - m)/s - (c - m)/s == (x - c)/s``).
    """
    terms = []
    for i, (col, c) in enumerate(zip(cols, center)):
        diff = _c(col) - F.lit(float(c))
        if scales is not None:
            diff = diff / F.lit(float(scales[i]))
        terms.append(diff * diff)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def distance_array(cols: Sequence, centers: Sequence[Sequence[float]],
                   scales: Sequence[float] | None = None) -> Column:
    return F.array(*[sq_dist(cols, c, scales) for c in centers])


def nearest_index(dists: Column) -> Column:
    """0-based position of the first minimum (ties go to the lowest center id)."""
    return (F.array_position(dists, F.array_min(dists)) - F.lit(1)).cast("int")


def nearest(cols: Sequence, centers: Sequence[Sequence[float]],
            scales: Sequence[float] | None = None) -> tuple[Column, Column]:
    """(cluster id, squared distance) of the nearest center."""
    d = distance_array(cols, centers, scales)
    return nearest_index(d), F.array_min(d)
