"""Small, fixed-size lookup tables (segment attributes, offer matrix, cluster map).

Each has a proven size bound (5 segments, 5 x 5 offers, k <= 10 clusters),
so broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(v)


def local_table(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str] | None = None) -> DataFrame:
    """A small literal table planned as a JVM ``LocalTableScan`` (no Python round trip)."""
    body = ", ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    if types:
        df = df.select(*[F.col(n).cast(t).alias(n) for n, t in zip(names, types)])
    return df


ATTR_SCHEMA = T.StructType([
    T.StructField("segment", T.StringType(), False),
    T.StructField("color", T.StringType(), False),
    T.StructField("strategy", T.StringType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("rfm_behavior", T.StringType(), False),
])


def segment_attributes(spark: SparkSession) -> DataFrame:
    rows = [(s, S.SEGMENT_COLORS[s], S.SEGMENT_STRATEGIES[s], S.SEGMENT_ACTIONS[s], S.SEGMENT_BEHAVIOR[s])
            for s in S.SEGMENTS]
    return F.broadcast(local_table(spark, rows, [f.name for f in ATTR_SCHEMA.fields]))


def offer_matrix(spark: SparkSession) -> DataFrame:
    """Segment x offer match levels as (segment, offer, level) rows, via ``stack``."""
    wide = local_table(spark, [(s, *S.OFFER_MATCH[s]) for s in S.SEGMENTS],
                       ["segment"] + [f"o{i}" for i in range(len(S.OFFERS))])
    pairs = ", ".join(f"'{o}', o{i}" for i, o in enumerate(S.OFFERS))
    return F.broadcast(wide.selectExpr("segment", f"stack({len(S.OFFERS)}, {pairs}) AS (offer, level)"))


def cluster_map(spark: SparkSession, mapping: dict[int, str]) -> DataFrame:
    """cluster id -> segment name (k rows)."""
    return F.broadcast(local_table(spark, sorted(mapping.items()), ["cluster", "segment"], ["int", "string"]))
