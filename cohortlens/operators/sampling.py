"""S-1: fixed-size sample without replacement, reproducible across engines.

Rows are ranked by ``md5(key || seed)`` (ties by key) and the first ``n``
are kept; a table no larger than ``n`` is returned whole.  A plain
``orderBy().limit(n)`` makes every task ship its own top ``n`` to one task,
which at thousands of partitions is a large single-task merge.  So the
hash space is first cut at a threshold chosen from the row count, keeping a
few times ``n`` candidates (hex prefixes compare like numbers), and only
those are ranked.  The sample is written once to the shared folder; if the
cut was ever too tight the uncut ranking is used instead, so the result is
always exactly the first ``n`` by hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

_PREFIX = 12  # hex digits compared for the cut (48 bits)


def sample_hash(key, seed: int = S.SAMPLE_SEED) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(str(seed))))


def ranked_sample(df: DataFrame, n: int, key: str = S.CUSTOMER_ID, seed: int = S.SAMPLE_SEED,
                  cut: str | None = None) -> DataFrame:
    """The lazy plan: optional hash cut, then a top-n by (hash, key)."""
    h = sample_hash(key, seed)
    cand = df.withColumn("_h", h)
    if cut is not None:
        cand = cand.filter(F.substring("_h", 1, _PREFIX) < F.lit(cut))
    return cand.orderBy("_h", key).limit(n).drop("_h")


def _cut_for(n: int, total: int, oversample: float = 3.0) -> str | None:
    frac = (oversample * n + 12 * math.sqrt(n) + 64) / total
    if frac >= 1.0:
        return None
    return format(math.ceil(frac * 16 ** _PREFIX), f"0{_PREFIX}x")


def exact_sample(df: DataFrame, n: int, key: str = S.CUSTOMER_ID, seed: int = S.SAMPLE_SEED,
                 total: int | None = None) -> DataFrame:
    """Exactly ``min(n, total)`` rows; ``total`` may be passed when already known."""
    if total is None:
        total = df.count()
    if total <= n:
        return df
    cut = _cut_for(n, total)
    sample = ranked_sample(df, n, key, seed, cut)
    from ..session import materialize
    sample = materialize(sample, "sample")  # one computation, written to the shared folder
    if cut is not None and sample.count() < n:
        sample = materialize(ranked_sample(df, n, key, seed, None), "sample")
    return sample
