"""Nearest neighbours by cosine with an inverted multi-index.

Vectors are scaled to length 1 and cut into two halves; each half is quantised to
one of ``CENTROIDS`` centroids (k-means on at most about ``FIT_ROWS`` vectors), and
the pair of centroids is a vector's cell.  A query takes cells in the order of the
summed distance of its halves to the two centroids, by a heap over the two sorted
lists, until they hold the wanted share of all vectors.  Every vector is indexed.

The share is measured, not guessed: on the fitted sample it is the least that
reaches ``RECALL`` of the true neighbours of at most ``TUNE_QUERIES`` queries.
Vectors without structure need a large share (about half for random directions).

Entries are dealt by the first half's centroid, queries go once to each such group
with the set of second centroids they want there; entries and queries of large
groups are dealt on to blocks, so no task holds a large group.  Each block's best
are reranked exactly, in double precision, on the original vectors.

Defined results: vectors that are null, empty, zero, hold a null or non-finite
component, or have another length than most take no part (as query or candidate).
Ties go to the smaller id.  Rows with the query's own id are not its neighbours;
other rows with a repeated id are one candidate.  A null id takes no part.  Fewer
candidates than ``k`` give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, materialize, read_table
from .registry import register

CENTROIDS = 32
FIT_ROWS, FIT_ROUNDS = 10_000, 12
TUNE_QUERIES, RECALL = 400, 0.97
BLOCK_ENTRIES, BLOCK_QUERIES = 8192, 2048
NEAREST = 5


def _matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centroids of the bounded sample ``x``; a centroid without vectors stays where it was."""
    centroids = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds if x.shape[1] else 0):
        own = _distances(x, centroids).argmin(axis=1)
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


class MultiIndex:
    """Two sets of centroids, the entries of each cell, and the share of entries a query takes."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.centroids = (first, second)
        self.counts = np.zeros((len(first), len(second)), np.int64)
        self.share = 1.0

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.centroids[0].shape[1]
        unit = _unit(x)
        return unit[:, :cut], unit[:, cut:]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_distances(h, c).argmin(axis=1) for h, c in zip(self.halves(x), self.centroids))

    def traverse(self, a: np.ndarray, b: np.ndarray):
        """Pairs (i, j) by the sum a[i] + b[j], smallest first."""
        order_a, order_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b = np.sort(a).tolist(), np.sort(b).tolist()
        heap, row_end = [(a[0] + b[0], 0, 0)], 0
        while heap:
            _, i, j = heapq.heappop(heap)
            yield order_a[i], order_b[j]
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if i == row_end and i + 1 < len(a):  # a row opens when the one before it gives its first pair
                row_end += 1
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))

    def visits(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: float) -> dict[int, list[int]]:
        """Second centroids to visit by first centroid, until the cells hold ``wanted`` entries."""
        found: dict[int, list[int]] = {}
        have = 0
        for i, j in self.traverse(a, b):
            if counts[i, j]:
                found.setdefault(i, []).append(j)
                have += int(counts[i, j])
                if have >= wanted:
                    break
        return found


def fit(sample: np.ndarray, centroids: int = CENTROIDS, k: int = NEAREST) -> MultiIndex:
    """Centroids from a sample of vectors, and the share of entries that reaches RECALL on it."""
    unit = _unit(sample)
    cut = max(1, unit.shape[1] // 2)
    index = MultiIndex(kmeans(unit[:, :cut], centroids), kmeans(unit[:, cut:], centroids))
    if len(sample) <= k + 1:
        return index
    queries = np.linspace(0, len(sample) - 1, min(TUNE_QUERIES, len(sample))).astype(int)
    i, j = index.cells(sample)
    width = index.counts.shape[1]
    counts = np.bincount(i * width + j, minlength=index.counts.size)
    da, db = (_distances(h[queries], c) for h, c in zip(index.halves(sample), index.centroids))
    order = np.argsort((da[:, :, None] + db[:, None, :]).reshape(len(queries), -1), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(queries), 0), 1)
    upto = np.cumsum(counts[order], axis=1)  # entries in the cells up to and with each place
    near = unit[queries] @ unit.T
    near[np.arange(len(queries)), queries] = -2
    best = np.argpartition(-near, k, axis=1)[:, :k]
    at = np.take_along_axis(place, (i * width + j)[best], 1)
    needed = np.sort((np.take_along_axis(upto, at, 1) / len(sample)).ravel())
    index.share = float(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))])
    return index


def _best_of_block(k: int):
    """The ``k`` nearest entries of one block for each of its queries, by the exact cosine."""
    def best(key, entries, queries):
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not entries.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = (_matrix(t.column("vector").combine_chunks()) for t in (entries, queries))
        ids, query_ids = entries.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        second = entries.column("second").to_numpy()
        norm_x, norm_q = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        unit_x, unit_q = x / norm_x[:, None], q / norm_q[:, None]
        out = []
        for n, (query, wanted) in enumerate(zip(query_ids.tolist(), queries.column("seconds").to_pylist())):
            mine = np.zeros(int(second.max()) + 1, bool)
            mine[[j for j in wanted if j < len(mine)]] = True
            rows = np.flatnonzero(mine[second] & (ids != query))
            if not len(rows):
                continue
            near = unit_x[rows] @ unit_q[n]
            if len(rows) > k:  # a little more than the k best: ties and the last digits are settled below
                rows = rows[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9]
            exact = (x[rows] * q[n]).sum(axis=1) / (norm_x[rows] * norm_q[n])
            for r in np.lexsort((ids[rows], -exact))[:k + 1]:
                out.append((query, int(ids[rows[r]]), float(exact[r])))
        return pa.table(list(zip(*out)) if out else [[], [], []], schema=schema)
    return best


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector): rows that take part, one per id, vectors as doubles of the commonest length."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    v = v.filter("vec_id is not null and vector is not null").filter(
        (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    v = v.withColumn("norm", norm).filter((F.col("norm") > 0) & (F.col("norm") < float("inf"))).drop("norm")
    sizes = v.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    v = v.filter(F.size("vector") == (sizes["size"] if sizes else 0))
    return v.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score); ``vectors`` and ``queries``: (vec_id, vector), queries among the vectors."""
    spark = vectors.sparkSession
    total = vectors.count()
    share = F.pmod(F.xxhash64("vec_id", F.lit(10)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = vectors.filter(share < min(1.0, FIT_ROWS / max(total, 1))).orderBy("vec_id").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(_matrix(sample.column("vector").combine_chunks()), k=k)
    shared = spark.sparkContext.broadcast(index)

    def quantise(batch: pa.RecordBatch) -> pa.RecordBatch:
        i, j = shared.value.cells(_matrix(batch.column("vector")))
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(i.astype(np.int32)),
                                           pa.array(j.astype(np.int32))], ["vec_id", "vector", "first", "second"])

    entries = materialize(arrow_map(vectors, quantise, "vec_id long, vector array<double>, first int, second int"), "ann-entries")
    counts = np.zeros_like(index.counts)
    for r in entries.groupBy("first", "second").count().collect():  # at most one row per cell
        counts[r["first"], r["second"]] = r["count"]
    cells = spark.sparkContext.broadcast(counts)
    wanted = index.share * total

    def route(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        x = _matrix(batch.column("vector"))
        da, db = (_distances(h, c) for h, c in zip(shared.value.halves(x), shared.value.centroids))
        out = [(n, i, js) for n in range(len(x)) for i, js in shared.value.visits(da[n], db[n], cells.value, wanted).items()]
        rows, first, seconds = zip(*out)
        taken = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([*taken.columns, pa.array(first, pa.int32()), pa.array(seconds, pa.list_(pa.int32()))],
                                          ["vec_id", "vector", "first", "seconds"])

    asked = materialize(arrow_map(queries.select("vec_id", "vector"), route,
                                  "vec_id long, vector array<double>, first int, seconds array<int>"), "ann-queries")
    # Blocks of a first centroid: entries and queries in so many parts that each is bounded.
    parts = (entries.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ENTRIES)).cast("int").alias("es"))
             .join(asked.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_QUERIES)).cast("int").alias("qs")), "first"))
    parts = F.broadcast(parts)  # at most one row per centroid

    def part_of(name: str, salt: int):
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(name)).cast("int").alias(name[0])

    def all_parts(name: str):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1)).alias(name[0])

    left = entries.join(parts, "first").select("first", part_of("es", 1), all_parts("qs"), "vec_id", "vector", "second")
    right = asked.join(parts, "first").select("first", part_of("qs", 2), all_parts("es"), "vec_id", "vector", "seconds")
    block = ["first", "e", "q"]
    found = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(
        _best_of_block(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@register("op10_nearest_vectors")
def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10: the five nearest vectors of each row whose id is divisible by 50."""
    vectors = materialize(usable(read_table(spark, sf_dir, "embeddings")), "ann-vectors")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))
