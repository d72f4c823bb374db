"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has 64 bits; bit b is 1 if it is set in over half of the
XXH64 hashes (seed 42) of its three-word shingles.  Fingerprints that differ in
at most three bits are linked, and linked documents form components.

Search.  Two halves of 31 bits each are cut from the fingerprint (two bits are
left over).  Of two fingerprints within three bits, one half differs in at most
one.  The anchors of a half are the 2^26 words of the perfect Hamming (31, 26)
code: every half lies within one bit (the covering radius) of one anchor.  A
fingerprint is replicated, for each half, to every anchor within radius plus
threshold = two bits: at most 16.  If two halves differ in one bit, the anchor
nearest to either is within two of the other, so both meet there.  Members of an
anchor are compared on all 64 bits.  Nothing is missed; equal fingerprints are
collapsed first, so a group of copies is one member.

An anchor's members are compared by shifts over the sorted partition; an anchor
with more than ``GROUP`` members goes, whole, to a second round that deals its
members to blocks of pairs of chunks, so no task holds a large anchor.

Defined results: a null or empty text has no words and fingerprint zero, linked
like any other.  Rows with a repeated id are kept.  A row with a null id has a
fingerprint, and the component of its fingerprint if a row with an id shares it,
else null.  Columns other than the id and the text are ignored.  An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, bytes_column, materialize, read_table
from .components import components
from .registry import register

SHINGLE, MAX_BITS, SEED = 3, 3, 42
HALF = 31
GROUP = 2048  # members of an anchor compared at once
HASHES = 65_536  # hashes unpacked to bits at once


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text, as a signed number."""
    words = (text or b"").lower().split()  # bytes.lower changes A-Z only
    if not words:
        return 0
    if len(words) < shingle:
        parts = iter([b" ".join(words)])
        n = 1
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    values = np.fromiter((hashed(p, SEED) for p in parts), "<u8", n)
    for at in range(0, n, HASHES):
        bits = np.unpackbits(values[at:at + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 text_hash: bool = False) -> DataFrame:
    """(doc_id, fp[, uid]): one row per row of ``docs``; ``uid`` is a hash of the text."""
    own = ["doc_id", *(["uid"] if text_hash else [])]

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle) for t in bytes_column(batch, "text")]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(fps, pa.int64())], [*own, "fp"])

    uid = [F.xxhash64(text_col).alias("uid")] if text_hash else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *uid, F.col(text_col).alias("text"))
    return arrow_map(rows, hashed, ", ".join(f"{c} long" for c in [*own, "fp"]))


def _syndromes(halves: np.ndarray) -> np.ndarray:
    """Hamming syndrome of 31-bit words: the XOR of the numbers (1 to 31) of their set bits."""
    out = np.zeros(len(halves), np.int64)
    for bit in range(HALF):
        out ^= ((halves >> bit) & 1) * (bit + 1)
    return out


def _flip(halves: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Words with the bit numbered ``position`` flipped; position 0 flips none."""
    return halves ^ np.where(position > 0, np.left_shift(np.int64(1), np.maximum(position - 1, 0)), 0)


def anchors_of(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all code words within two bits of each 31-bit word.

    One is the nearest.  A word off the code by bit e has others at two bits:
    flipping bits a and b with a XOR b = e.
    """
    syndrome = _syndromes(halves)
    rows, anchors = [np.arange(len(halves))], [_flip(halves, syndrome)]
    for a in range(1, HALF + 1):
        b = syndrome ^ a
        ok = np.flatnonzero((syndrome > 0) & (b > a))
        rows.append(ok)
        anchors.append(_flip(_flip(halves[ok], np.full(len(ok), a)), b[ok]))
    return np.concatenate(rows), np.concatenate(anchors)


def _replicate(batch: pa.RecordBatch) -> pa.Table:
    fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
    out = []
    for half in (0, 1):
        rows, anchors = anchors_of((fp >> (half * HALF)) & ((1 << HALF) - 1))
        out.append(pa.table({"anchor": anchors * 2 + half, "fp": fp[rows], "rep": rep[rows]}))
    return pa.concat_tables(out)


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many of the links (a, b) as connect the same rows: a spanning forest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return a[keep], b[keep]


def _links_of_group(fp: np.ndarray, rep: np.ndarray, first: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the rows of one anchor; pairs within the first ``first`` rows are left out."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for i in range(max(first, 1), len(fp)):
        near = np.flatnonzero(_bits(fp[:i], np.broadcast_to(fp[i], i)) <= max_bits)
        if len(near):
            found.append((rep[near], np.full(len(near), rep[i])))
    return _forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def _compare_sorted(max_bits: int):
    """Links among rows sorted by anchor, streaming; groups over GROUP rows come out as ``rest`` rows."""
    def emit(a, b, anchor, fp, rep):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([a, rep])), pa.array(np.concatenate([b, fp])),
             pa.array(np.concatenate([np.full(len(a), -1), anchor]))], ["a", "b", "anchor"])

    def compare(anchor, fp, rep, full):
        """All groups of these rows are whole, but that of the key ``full`` (rows of a group too large)."""
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(anchor)])
        size_of = np.repeat(sizes, sizes)
        over = (size_of > GROUP) | (anchor == full)
        links = []
        small = np.flatnonzero((size_of > 1) & (size_of <= 64) & ~over)
        a_, f_, r_ = anchor[small], fp[small], rep[small]
        for shift in range(1, int(size_of[small].max()) if len(small) else 0):
            near = (a_[shift:] == a_[:-shift]) & (_bits(f_[shift:], f_[:-shift]) <= max_bits)
            links.append((r_[:-shift][near], r_[shift:][near]))
        for s, n in zip(starts, sizes):
            if 64 < n <= GROUP and not over[s]:
                links.append(_links_of_group(fp[s:s + n], rep[s:s + n], 0, max_bits))
        none = np.empty(0, np.int64)
        a, b = _forest(np.concatenate([none, *[x for x, _ in links]]), np.concatenate([none, *[y for _, y in links]]))
        return emit(a, b, anchor[over], fp[over], rep[over])

    def run(batches):
        held = [np.empty(0, np.int64)] * 3  # rows of the last anchor seen so far
        full = None  # the anchor of which more than GROUP rows have come out already
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rows = [np.concatenate([h, x]) for h, x in zip(held, new)]
            if not len(rows[0]):
                continue
            last = rows[0][-1]
            cut = int(np.searchsorted(rows[0], last))
            if len(rows[0]) - cut > GROUP:
                full_now, cut = last, len(rows[0])
            else:
                full_now = full if full == last else None
                cut = len(rows[0]) if full_now is not None else cut
            if cut:
                yield compare(*[x[:cut] for x in rows], full)
            held, full = [x[cut:] for x in rows], full_now
        if len(held[0]):
            yield compare(*held, full)

    return run


def _compare_chunks(max_bits: int):
    """Links of one block: the rows of two chunks of a large anchor (or of one chunk)."""
    def compare(table):
        chunk, fp, rep = (table.column(c).to_numpy() for c in ("chunk", "fp", "rep"))
        order = np.lexsort((rep, chunk))
        chunk, fp, rep = chunk[order], fp[order], rep[order]
        first = int((chunk == chunk[0]).sum())
        a, b = _links_of_group(fp, rep, first if first < len(fp) else 0, max_bits)
        return pa.table({"a": a, "b": b})
    return compare


def link(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between the rows (fp, rep) of distinct fingerprints that join all within ``max_bits``."""
    if max_bits > 3:
        raise ValueError("two halves with covering radius 1 find pairs within three bits")
    partitions = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = arrow_map(nodes.select("fp", "rep"), _replicate, "anchor long, fp long, rep long")
    dealt = near.repartition(partitions, "anchor").sortWithinPartitions("anchor", "rep")
    found = materialize(dealt.mapInArrow(_compare_sorted(max_bits), "a long, b long, anchor long"), "simhash-links")
    links = found.filter("anchor = -1").select("a", "b")
    rest = found.filter("anchor <> -1").select("anchor", F.col("b").alias("fp"), F.col("a").alias("rep"))
    # Large anchors: each member goes to the blocks (i, j) of its chunk i with every chunk j.
    chunks = rest.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).cast("int").alias("chunks"))
    blocks = (rest.join(chunks, "anchor").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .select("anchor", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
                      "chunk", "fp", "rep"))
    more = blocks.groupBy("anchor", "i", "j").applyInArrow(_compare_chunks(max_bits), "a long, b long")
    return links.unionByName(more).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, text_hash: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    With ``text_hash`` also ``uid``, a hash of the text, and components are named by their least
    fingerprint, as ids with several texts may be the smallest of several components.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle, text_hash), "simhash-fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
                        .filter("rep is not null").withColumn("rep", F.col("fp" if text_hash else "rep")), "simhash-nodes")
    joined = components(link(nodes, max_bits))
    # Only fingerprints with several documents or links need a lookup; a salt spreads hot ones.
    salts = 16
    table = (nodes.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
             .filter("n > 1 or component is not null")
             .select("fp", F.coalesce("component", "rep").alias("component"),
                     F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    found = (marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
             .join(table, ["fp", "salt"], "left"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.coalesce("component", "fp" if text_hash else "doc_id").alias("component_id"),
                        *(["uid"] if text_hash else []))


def one_per_component(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component, all columns: that with the smallest id.

    An id may have several texts; of those in one component the row with the least
    fingerprint and text hash stays, and a text in another component has its own row.
    Of rows with one id and equal texts one stays; rows with a null id stay.
    """
    found = near_duplicates(docs, text_hash=True).filter("doc_id is not null")
    kept = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "fingerprint", "uid")).alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("doc_id"), F.col("first.uid").alias("uid"))
    # The whole row travels as one column, so its names cannot clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("uid"))
    line = W.partitionBy("doc_id", "uid").orderBy("doc_id")
    first = (rows.filter("doc_id is not null").join(kept, ["doc_id", "uid"], "left_semi")
             .withColumn("nth", F.row_number().over(line)).filter("nth = 1").select("row"))
    return first.unionByName(rows.filter("doc_id is null").select("row")).select("row.*")


@register("op3_simhash_near_duplicates")
def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: SimHash fingerprints of all documents and the components of those within three bits."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
