"""Sharding by balanced label propagation over groups of equal texts.

Documents with equal texts are linked.  Linked documents start on hashed shards
and move, round by round, to the shard where most of their neighbours are, as far
as the target's free bytes and the bytes that leave it in the same round allow; when
the rounds no longer move much, the groups still cut are dealt along the room that is left
without them, and documents without links then level the sizes.

All documents of a group have the same size, so the state of the propagation is
one row per (group, shard) with a count, never more than ``shards`` rows per
group.  A group larger than half a shard is split into parts that vote apart.
Only DataFrame functions are used.

Defined results: a null text counts as empty; empty texts form one group; rows
with a repeated or null ``doc_id`` are kept, one output row per input row; an
empty table gives no rows.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import add_prefix, buckets_for, materialize, read_table
from .registry import register

SHARDS = 40
ROW_OVERHEAD = 16  # bytes a row counts besides its text
STALLED = 0.02  # share of the wished bytes below which a round is not worth its passes
SNAP = 0.01  # share of a shard by which a group may pass a shard's end and stay whole


def _uniform(*cols):
    """A hash of ``cols`` spread over [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _bytes_by_shard(df: DataFrame, shards: int, value) -> list[int]:
    """Sum of ``value`` per shard: a list of ``shards`` numbers."""
    load = [0] * shards
    for shard, total in df.groupBy("shard").agg(F.sum(value)).collect():
        load[shard] = int(total or 0)
    return load


def _pick(values: list[float], index):
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (index + 1).cast("int"))


def _granted(free: list[float], demand: list[list[int]]) -> list[float]:
    """Per target, the share of the bytes wished into it that keeps every shard within its capacity.

    ``demand[s][t]``: bytes that would go from s to t.  What leaves a shard counts as
    its room, so equal bytes are swapped between full shards.  Starts from all
    wishes and lowers the shares until each shard's arrivals fit.
    """
    demand = np.array(demand, float)
    wished, share = demand.sum(axis=0), np.ones(len(free))
    for _ in range(1000):
        room = np.maximum(0.0, np.array(free) + demand @ share)
        lower = np.minimum(share, room / np.maximum(wished, 1.0))
        if np.abs(share - lower).max() < 1e-4:
            break
        share = lower
    return [float(x) for x in lower]


def propagate(cells: DataFrame, shards: int, capacity: float) -> DataFrame:
    """Move linked documents towards their neighbours' shards under byte quotas.

    ``cells``: (g, shard, n, size), one row per group and shard.  Each round sums
    the shards' loads, lets every group part choose the shard that holds most of
    it (ties by a hash), and asks to move the other documents of the part there;
    of the demand each cell moves the share that fits (``_granted``), fractions
    rounded by a hash.  Each move makes the sum of n * n larger, so the rounds end:
    when nothing is wished, or the granted bytes are a small share of the wished
    ones.  Parts that are cut then are dealt whole (``_deal``).
    """
    whole = W.partitionBy("g")
    parts = F.least(F.lit(shards), F.greatest(F.lit(1), F.ceil(
        F.sum(F.col("n") * F.col("size")).over(whole) / F.lit(max(capacity, 1) / 2))))
    cells = materialize(
        cells.withColumn("part", F.floor(F.col("shard") * parts / F.lit(shards)).cast("int")), "shard-cells")
    turn = 0
    while True:
        free = [capacity - x for x in _bytes_by_shard(cells, shards, F.col("n") * F.col("size"))]
        part = W.partitionBy("g", "part")
        best = part.orderBy(F.col("n").desc(), F.xxhash64("g", "part", "shard"))
        wish = (cells.withColumn("target", F.first("shard").over(best))
                .withColumn("moves", F.col("target") != F.col("shard")))
        demand = [[0] * shards for _ in range(shards)]
        for source, target, size in wish.filter("moves").groupBy("shard", "target").agg(
                F.sum(F.col("n") * F.col("size"))).collect():  # at most shards x shards rows
            demand[source][target] = int(size)
        wished = [sum(x) for x in zip(*demand)]
        if not any(wished):
            break
        granted = _granted(free, demand)
        if sum(x * w for x, w in zip(granted, wished)) < STALLED * sum(wished):
            cells = _deal(cells, shards, capacity)
            break
        share = _pick(granted, F.col("target"))
        going = F.when(F.col("moves"), F.least("n", F.floor(
            F.col("n") * share + _uniform("g", "part", "shard", F.lit(turn))))).otherwise(F.lit(0)).cast("long")
        wish = wish.withColumn("going", going)
        arrived = wish.filter("going > 0").select("g", "part", F.col("target").alias("shard"),
                                                  F.col("going").alias("n"), "size")
        stayed = wish.select("g", "part", "shard", (F.col("n") - F.col("going")).alias("n"), "size").filter("n > 0")
        cells = materialize(stayed.unionByName(arrived).groupBy("g", "part", "shard", "size")
                            .agg(F.sum("n").alias("n")), "shard-cells")
        turn += 1
    return cells.groupBy("g", "shard").agg(F.sum("n").alias("n"))


def _deal(cells: DataFrame, shards: int, capacity: float) -> DataFrame:
    """Put the parts that lie on several shards on one each, along the rooms that the whole parts leave.

    The rooms stand one after the other, and each part takes the next bytes of them.  A part
    that meets a room's end goes where its middle is; only one larger than
    ``SNAP`` of a shard is cut there, between documents.
    """
    of = W.partitionBy("g", "part")
    marked = materialize(cells.withColumn("cut", F.count(F.lit(1)).over(of) > 1), "shard-cells")
    rest = marked.filter("cut").groupBy("g", "part", "size").agg(F.sum("n").alias("n"))
    count, extra = rest.agg(F.count(F.lit(1)), F.sum(F.col("n") * F.col("size"))).first()
    load = _bytes_by_shard(marked.filter(~F.col("cut")), shards, F.col("n") * F.col("size"))
    ends = np.cumsum(_water_level(load, int(extra))).tolist()
    rest = add_prefix(rest, [], ["g", "part"], {"at": F.col("n") * F.col("size")}, buckets_for(count))
    length = F.col("n") * F.col("size")
    snap = F.col("at") + length / 2
    # documents of the part whose middle lies before a room's end; the last end takes all
    before = [F.when(length <= F.lit(2 * SNAP * capacity), F.when(snap < F.lit(e), F.col("n")).otherwise(F.lit(0)))
              .otherwise(F.least(F.col("n"), F.greatest(F.lit(0), F.ceil((F.lit(e) - F.col("at")) / F.col("size") - 0.5))))
              .cast("long") for e in ends[:-1]] + [F.col("n")]
    dealt = (rest.withColumn("upto", F.array(*before))
             .select("g", "part", "size", "upto", F.posexplode("upto").alias("shard", "last"))
             .withColumn("n", F.col("last") - F.when(F.col("shard") > 0, F.element_at(
                 "upto", F.greatest(F.col("shard"), F.lit(1)))).otherwise(F.lit(0))).filter("n > 0"))
    return materialize(marked.filter(~F.col("cut")).select("g", "part", "shard", "n", "size").unionByName(
        dealt.select("g", "part", "shard", "n", "size")), "shard-cells")


def _water_level(load: list[int], extra: int) -> list[float]:
    """Room of each shard below the level that ``extra`` more bytes would reach."""
    rest, level = sorted(load), 0.0
    for k in range(1, len(rest) + 1):
        level = (sum(rest[:k]) + extra) / k
        if k == len(rest) or level <= rest[k]:
            break
    return [max(0.0, level - x) for x in load]


def _even_level(rows: DataFrame, total: int, shards: int) -> float:
    """Bytes of an even shard, when documents larger than that have shards of their own."""
    level, known = total / shards, 0
    while known < shards:
        n, large = rows.filter(F.col("size") > level).agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if n <= known or n >= shards:
            break
        level, known = (total - large) / (shards - n), n
    return level


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law ``bytes``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g")), "shard-rows")
    rows, total = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    capacity = _even_level(base, total, shards)
    buckets = buckets_for(rows)
    # Documents of a group are ranked within (group, sub); sub also gives the first shard.
    subs = shards * buckets_for(rows, 2_000_000)
    base = base.withColumn("sub", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(subs)).cast("int"))
    per_sub = base.groupBy("g", "sub").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    by_shard = per_sub.groupBy("g", (F.col("sub") % shards).alias("shard"), "size").agg(F.sum("n").alias("n"))
    linked = (by_shard.withColumn("all", F.sum("n").over(W.partitionBy("g"))).filter("all > 1").drop("all"))
    placed = materialize(propagate(linked, shards, capacity), "shard-groups")

    # A group's documents in rank order fill its shards' counts one after the other.
    upto = F.sum("n").over(W.partitionBy("g").orderBy("shard"))
    plan = (placed.withColumn("upto", upto).groupBy("g")
            .agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("plan")))
    before = W.partitionBy("g").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = (per_sub.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n", "size")
               .join(plan, "g", "left"))
    rank = F.row_number().over(W.partitionBy("g", "sub").orderBy("doc_id")) - 1
    ranked = base.withColumn("rank", rank).join(offsets, ["g", "sub"])
    at = F.col("offset") + F.col("rank")
    first = F.filter("plan", lambda c: c["upto"] > at)[0]["shard"]
    ranked = materialize(ranked.withColumn("shard", first).select(
        "doc_id", "size", "text_crc32", "shard"), "shard-linked")

    # The others level the sizes, large ones first, each class along the rooms below the water level.
    done = ranked.filter("shard is not null")
    load = _bytes_by_shard(done, shards, F.col("size"))
    single = ranked.filter("shard is null").drop("shard")
    mean = total / max(rows, 1)
    klass = (F.when(F.col("size") > 8 * mean, 0).when(F.col("size") > 2 * mean, 1)
             .when(F.col("size") > mean / 2, 2).otherwise(3))
    single = add_prefix(single.withColumn("klass", klass), ["klass"], ["doc_id", "text_crc32"],
                        {"at": F.col("size")}, buckets)
    single = materialize(single, "shard-singles")
    for k in range(4):
        own = single.filter(F.col("klass") == k)
        room = _water_level(load, int(own.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]))
        ends, end = [], 0.0
        for x in room:
            end += x
            ends.append(end)
        middle = F.col("at") + F.col("size") / 2
        shard = F.least(F.lit(shards - 1), F.size(F.filter(
            F.array(*[F.lit(x) for x in ends]), lambda e: e <= middle))).cast("int")
        own = own.select("doc_id", "size", "text_crc32", shard.alias("shard"))
        load = [a + b for a, b in zip(load, _bytes_by_shard(own, shards, F.col("size")))]
        done = done.unionByName(own)
    done = add_prefix(done, ["shard"], ["doc_id", "text_crc32"], {"slot": F.lit(1)}, buckets)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
                       F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"))


@register("op7_shard_documents")
def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: all documents in shards 0 to 39 of near equal bytes, equal texts together where they fit."""
    return shard_documents(read_table(spark, sf_dir, "documents"))
