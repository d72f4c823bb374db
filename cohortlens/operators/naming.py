"""Unique segment names for k centroids by greedy argmax.

Round by round, the remaining centroid maximising the round's key gets the
round's name (ties to the lowest cluster id); whatever remains is Loyal.
The k centroids are a fitted model's state on the driver.
"""

from __future__ import annotations

from .. import schema as S

# Naming order, and the weights (income, score) of the key each round maximises.
KEYS = [(S.VIP, 1.0, 1.0), (S.AT_RISK, -0.25, -2.0), (S.NEW, 1.0, -1.1), (S.DISCOUNT, -1.0, 1.4)]


def greedy_names(centroids: list[tuple[float, float]]) -> dict[int, str]:
    """Cluster position to name, for (income, score) centroids in original units."""
    remaining = list(range(len(centroids)))
    out: dict[int, str] = {}
    for name, income, score in KEYS:
        if not remaining:
            break
        best = max(remaining, key=lambda c: (centroids[c][0] * income + centroids[c][1] * score, -c))
        out[best] = name
        remaining.remove(best)
    if remaining:
        out[remaining[0]] = S.LOYAL
    return out
