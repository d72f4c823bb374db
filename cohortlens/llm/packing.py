"""Best-fit packing of documents into sequences, by a grouping genetic algorithm.

A document is its token ids and one id 0.  Documents longer than a sequence are
cut so that all pieces but the first are full; a full piece is a sequence of its
own.  The others are dealt by hash to groups of about ``GROUP_PIECES`` pieces, and
each group is packed on several islands at once.

An island holds a population of packings of its group.  A child takes a run of
well-filled bins of one parent; bins of the other parent that share a piece with
them are dissolved (so no piece is twice there), and the pieces that this
displaces are traded for smaller ones of the bins that stay (one or two for one or two, if
the bin gets fuller), then go, largest first, to the bins that they fit best.  Fewer bins are
fitter, then a larger sum of squared fills.  After an epoch each island's elite
migrates to the next island (a Spark grouping by island), and the best packing
of all islands is the group's.  A search ends early when a packing needs no more
bins than the sum of sizes does, so its budget is spent where best fit leaves a gap.

A random group has the sizes of the whole, so what is lost against one packing of
everything is about half a bin per group.

Ids are those of the ``tokenizers`` library for the given file; they are computed
with the same vocabulary and merges by ``tiktoken``, which is faster (tests hold
both against each other).

Defined results: a null or empty text is one piece, the id 0; rows with a repeated
or null id are documents of their own; an empty table gives no rows.  Columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import bisect
import json
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, buckets_for, materialize, read_table
from .registry import register

CAPACITY = 2048
GROUP_PIECES = 8192
ISLANDS, EPOCHS, CHILDREN, POPULATION, ELITES = 2, 3, 32, 8, 2
SEED = 4
END_TEXT = "<|endoftext|>"
#: How the byte-level vocabulary splits texts before merging (the public pattern of that vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def load_tokenizer(path: str, cache: dict = {}):  # noqa: B006 - one per worker
    """An encoding with the vocabulary of a byte-level BPE file of the ``tokenizers`` library."""
    if path not in cache:
        import tiktoken
        # The file writes each byte as a printable character: itself if printable, else 256 and up in order.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in own}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        cache[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return cache[path]


def encode(text: str, tokenizer) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit numbers; a special token's string is that token."""
    if any(s in text for s in tokenizer.special_tokens_set):
        return np.array(tokenizer.encode(text, allowed_special="all"), "<u4")
    return tokenizer.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): one row per piece."""
    def cut(batch: pa.RecordBatch) -> pa.Table:
        coder = load_tokenizer(tokenizer)
        out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = np.append(encode(text or "", coder), np.zeros(1, "<u4")).astype("<u4", copy=False)
            n = len(ids)
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                own = ids[a:b]
                row = (doc, k, a, b - a, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None)
                for column, value in zip(out.values(), row):
                    column.append(value)
        if not with_ids:
            del out["ids"]
        types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(),
                 "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
        return pa.table({n: pa.array(v, types[n]) for n, v in out.items()})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
                     + (", ids array<int>" if with_ids else ""))


class Packing:
    """Bins of one group: each a list of piece numbers, with the free room of each bin."""

    def __init__(self, bins: list[list[int]], room: list[int]):
        self.bins, self.room = bins, room

    def fitness(self, capacity: int) -> tuple[int, int]:
        return -len(self.bins), sum((capacity - r) ** 2 for r in self.room)

    def assignment(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        for b, own in enumerate(self.bins):
            out[own] = b
        return out

    @classmethod
    def of(cls, assignment: np.ndarray, sizes: list[int], capacity: int) -> Packing:
        bins: list[list[int]] = [[] for _ in range(int(assignment.max()) + 1)]
        for i, b in enumerate(assignment.tolist()):
            bins[b].append(i)
        return cls(bins, [capacity - sum(sizes[i] for i in own) for own in bins])


def best_fit(packing: Packing, items: list[int], sizes: list[int], capacity: int) -> Packing:
    """Put ``items`` in the given order each into the bin with the least room that is enough, or a new bin."""
    bins, room = packing.bins, packing.room
    open_bins = sorted((r, b) for b, r in enumerate(room) if r)
    for i in items:
        size = sizes[i]
        at = bisect.bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            left, b = open_bins.pop(at)
            left -= size
            bins[b].append(i)
            room[b] = left
        else:
            b, left = len(bins), capacity - size
            bins.append([i])
            room.append(left)
        if left:
            bisect.insort(open_bins, (left, b))
    return packing


def trade(bins: list[list[int]], room: list[int], displaced: list[int], sizes: list[int], capacity: int,
          rng: random.Random) -> list[int]:
    """Swap displaced pieces for smaller ones of bins with room where that fills the bin further; what is displaced then.

    A bin gives one or two of its pieces for the one or two displaced that fill their place best: of
    two, the first is drawn and the second is the largest that fits beside it.
    """
    pool = sorted((sizes[i], i) for i in displaced)
    for b in rng.sample(range(len(bins)), len(bins)):
        own = bins[b]
        if not room[b] or not pool:
            continue
        offers = [(i,) for i in own] + [tuple(rng.sample(own, 2)) for _ in range(min(3, len(own) - 1))]
        for out in offers:
            given = sum(sizes[i] for i in out)
            place = room[b] + given
            best, take = given, ()
            at = bisect.bisect_right(pool, (place, len(sizes))) - 1
            if at >= 0 and pool[at][0] > best:
                best, take = pool[at][0], (at,)
            if at >= 1 and best < place:
                first = rng.randrange(at + 1)
                second = bisect.bisect_right(pool, (place - pool[first][0], len(sizes))) - 1
                second -= second == first
                if second >= 0 and pool[first][0] + pool[second][0] > best:
                    best, take = pool[first][0] + pool[second][0], (first, second)
            if take:
                moved = [pool[t][1] for t in take]
                for t in sorted(take, reverse=True):
                    del pool[t]
                own = bins[b] = [i for i in own if i not in out] + moved
                room[b] = place - best
                for i in out:
                    bisect.insort(pool, (sizes[i], i))
                break
    return [i for _, i in pool]


def child_of(giver: Packing, taker: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """A run of the giver's best-filled bins, the taker's bins free of their pieces, the displaced pieces best-fit."""
    ranked = sorted(range(len(giver.bins)), key=lambda b: (giver.room[b], rng.random()))
    good = ranked[:max(1, len(ranked) * 3 // 4)]
    n = rng.randint(1, max(1, len(good) // 2))
    at = rng.randint(0, len(good) - n)
    chosen = good[at:at + n]
    inside = {i for b in chosen for i in giver.bins[b]}
    bins, room, displaced = [list(giver.bins[b]) for b in chosen], [giver.room[b] for b in chosen], []
    for own, left in zip(taker.bins, taker.room):
        if inside.isdisjoint(own):
            bins.append(list(own))
            room.append(left)
        else:
            displaced += [i for i in own if i not in inside]
    displaced = trade(bins, room, displaced, sizes, capacity, rng)
    # Pieces are numbered from the largest down, so their numbers are the best-fit order.
    return best_fit(Packing(bins, room), sorted(displaced), sizes, capacity)


def evolve(population: list[Packing], sizes: list[int], capacity: int, children: int, size: int,
           rng: random.Random) -> list[Packing]:
    """``children`` crossovers, each child replacing the least fit of the population; fittest first.

    Stops early when a packing needs no more bins than the sum of sizes does.
    """
    least = -(-sum(sizes) // capacity)
    population = sorted(population, key=lambda p: p.fitness(capacity), reverse=True)[:size]
    for _ in range(children):
        if len(population[0].bins) <= least or len(population) < 2:
            break
        giver, taker = rng.sample(population, 2)
        population.append(child_of(giver, taker, sizes, capacity, rng))
        population.sort(key=lambda p: p.fitness(capacity), reverse=True)
        population = population[:size]
    return population


def _first_population(sizes: list[int], capacity: int, rng: random.Random) -> list[Packing]:
    """Best-fit decreasing, and best fit in orders that a little noise disturbs."""
    order = list(range(len(sizes)))
    found = [best_fit(Packing([], []), order, sizes, capacity)]
    for k in range(1, POPULATION):
        noise = 0.05 * k
        shuffled = sorted(order, key=lambda i: -sizes[i] * (1 + noise * rng.random()))
        found.append(best_fit(Packing([], []), shuffled, sizes, capacity))
    return found


def _sorted_items(table: pa.Table) -> pa.Table:
    return table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"),
                          ("start", "ascending"), ("ids_crc32", "ascending")])


def _elite_rows(group: int, island: int, population: list[Packing], n: int) -> pa.Table:
    """The elite, for its own island and for the next one."""
    best = [p.assignment(n).tobytes() for p in population[:ELITES]]
    to = [island] * len(best) + [(island + 1) % ISLANDS] * len(best)
    return pa.table({"group": pa.array([group] * len(to), pa.int64()), "island": pa.array(to, pa.int32()),
                     "bins": pa.array(best * 2, pa.binary())})


def _epoch(capacity: int, epoch: int):
    def first(key, items):
        group, island = (k.as_py() for k in key)
        sizes = _sorted_items(items).column("length").to_pylist()
        rng = random.Random(f"{SEED} {group} {island} {epoch}")
        found = evolve(_first_population(sizes, capacity, rng), sizes, capacity, CHILDREN, POPULATION, rng)
        return _elite_rows(group, island, found, len(sizes))

    def later(key, items, elite):
        group, island = (k.as_py() for k in key)
        sizes = _sorted_items(items).column("length").to_pylist()
        rng = random.Random(f"{SEED} {group} {island} {epoch}")
        population = [Packing.of(np.frombuffer(b, np.int32), sizes, capacity)
                      for b in sorted(set(elite.column("bins").to_pylist()))]
        population += _first_population(sizes, capacity, rng)[1:]
        found = evolve(population, sizes, capacity, CHILDREN, POPULATION, rng)
        return _elite_rows(group, island, found, len(sizes))

    return later if epoch else first


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _place(capacity: int):
    """The best packing of a group over its islands, as rows."""
    def place(key, items, elite):
        items = _sorted_items(items)
        sizes = items.column("length").to_pylist()
        options = [Packing.of(np.frombuffer(b, np.int32), sizes, capacity)
                   for b in sorted(set(elite.column("bins").to_pylist()))]
        best = max(options, key=lambda p: p.fitness(capacity))
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, own in enumerate(best.bins):
            at = 0
            for i in sorted(own):
                sequence[i], offset[i] = key[0].as_py() * (1 << 20) + b, at
                at += sizes[i]
        out = items.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
    return place


def pack(found: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Sequence and place of each piece (see ``pieces``); groups number their sequences apart."""
    found = found.select("doc_id", "piece", "start", "length", "ids_crc32")
    groups = buckets_for(found.filter(F.col("length") < capacity).count(), group_pieces)
    # Full pieces are sequences by themselves: negative numbers, by task and row of the written table.
    full = found.filter(F.col("length") >= capacity).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    # Equal rows are told apart by their place, so that no group gets them all; written, as every epoch must see the same groups.
    rest = materialize(found.filter(F.col("length") < capacity).withColumn("group", F.pmod(
        F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(SEED)), F.lit(groups))), "packing-groups")
    islands = rest.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    schema = "group long, island int, bins binary"
    elite = materialize(islands.groupBy("group", "island").applyInArrow(_epoch(capacity, 0), schema), "packing-elite")
    for epoch in range(1, EPOCHS):
        elite = materialize(islands.groupBy("group", "island").cogroup(elite.groupBy("group", "island"))
                            .applyInArrow(_epoch(capacity, epoch), schema), "packing-elite")
    placed = rest.groupBy("group").cogroup(elite.groupBy("group")).applyInArrow(_place(capacity), _PLACED)
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece."""
    cut = materialize(pieces(docs, tokenizer or default_tokenizer(), id_col, text_col, capacity), "packing-pieces")
    return materialize(pack(cut, capacity), "packing-placed")


def sequences(placed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences; ``with_ids`` is ``pieces(..., with_ids=True)`` of the same documents."""
    ids = with_ids.select("doc_id", "piece", "start", "length", "ids_crc32", "ids").dropDuplicates(
        ["doc_id", "piece", "start", "length", "ids_crc32"])
    keys = [F.col(f"p.{c}").eqNullSafe(F.col(f"i.{c}")) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    both = placed.alias("p").join(ids.alias("i"), keys).select("sequence_id", "offset", "ids")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` ids in all
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


@register("op4_pack_documents")
def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: all documents in sequences of at most 2048 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
