"""Homomorphic multiset fingerprints of documents.

A text is cut into pieces: at line breaks, within a paragraph after sentence
ends, and a long sentence at points that its characters define.  Each piece hashes to a wide vector; a fingerprint is the sum of its
pieces' vectors, so it depends on the multiset of pieces and not on their order,
and a piece is inserted or deleted by adding or subtracting its vector.

The vector has two parts.  64 sign lanes (+1 or -1 by the bits of one XXH64, sums
modulo 2^16) carry likeness: lanes of the difference of two sums have, on
average, the squared size of the multisets' difference.  Eight wide lanes (the
halves of four XXH64 with salts of their own, sums modulo 2^32) carry equality.
Only DataFrame functions are used.

Defined results: a null text counts as empty; an empty text has the zero
fingerprint; likeness of two zero fingerprints is 1.  Repeated rows and repeated
or null ids are kept (null ids come last in descending order; rows of one id follow each other by the text's first
eight characters, then by hashes of it).  An empty table gives no rows.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, read_table
from .registry import register

SIGN_LANES, SIGN_MOD = 64, 1 << 16
WIDE_LANES, WIDE_MOD = 8, 1 << 32
#: Texts of one range that meet in a window, at least; above 1 TB it grows with the root of all texts' bytes.
RANGE_BYTES = 16 << 20
#: Sampled keys per range, and a text's characters in the key of the order.
PER_CUT, LEAD_CHARS = 16, 8
#: Pieces of more characters are cut at content-defined points.
LONG_PIECE = 40
#: ... after words that end in a, e, o, s or in anything but an ASCII letter, a digit or white space.
CUT_AFTER = r"[^b-df-np-rt-zA-Z0-9 \t\n\x0B\f\r]"


def pieces(text: Column) -> Column:
    """Paragraphs, within them sentences, and of long ones the runs of words up to one whose last character is in a fixed class.

    Where a sentence is cut depends on the characters there alone, so an edit moves no cut beyond it.
    """
    parts = F.filter(F.split(text, r"\s*\n\s*|(?<=[.!?])[ \t]+"), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(
        F.char_length(p) > LONG_PIECE, F.split(p, rf"(?<={CUT_AFTER})[ \t]+")).otherwise(F.array(p))))


def add_lanes(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the sum of the vectors of a text's pieces: ``SIGN_LANES + WIDE_LANES`` longs."""
    df = df.withColumn("_pieces", pieces(F.col(text)))
    df = df.withColumn("_hashes", F.transform("_pieces", lambda p: F.xxhash64(p)))

    def ones(lane: int) -> Column:  # of lanes ``lane`` and ``lane + 32``, 32 bits each
        return F.aggregate("_hashes", F.lit(0).cast("long"),
                           lambda acc, h: acc + F.shiftrightunsigned(h, lane).bitwiseAND(F.lit((1 << 32) + 1)))

    def sign_lane(lane: int) -> Column:
        count = F.shiftrightunsigned(F.col("_ones")[lane % 32], 32 * (lane // 32)).bitwiseAND(F.lit((1 << 32) - 1))
        return F.pmod(count * 2 - F.size("_hashes"), F.lit(SIGN_MOD)).cast("long")

    def wide_lane(lane: int) -> Column:  # the low or high 32 bits of one of four more hashes; sums of 2^31 pieces fit a long
        half = (lambda h: h.bitwiseAND(F.lit(WIDE_MOD - 1))) if lane % 2 == 0 else (lambda h: F.shiftrightunsigned(h, 32))
        total = F.aggregate(f"_wide{lane // 2}", F.lit(0).cast("long"), lambda acc, h: acc + half(h))
        return F.pmod(total, F.lit(WIDE_MOD)).cast("long")

    for i in range(WIDE_LANES // 2):
        df = df.withColumn(f"_wide{i}", F.transform("_pieces", lambda p: F.xxhash64(p, F.lit(i))))
    df = df.withColumn("_ones", F.array(*[ones(i) for i in range(32)]))
    lanes = [*[sign_lane(i) for i in range(SIGN_LANES)], *[wide_lane(i) for i in range(WIDE_LANES)]]
    return df.withColumn(out, F.array(*lanes)).drop("_pieces", "_hashes", "_ones", *[f"_wide{i}" for i in range(WIDE_LANES // 2)])


def _combine(a: Column, b: Column, sign: int) -> Column:
    both = F.zip_with(a, b, lambda x, y: x + y * F.lit(sign))
    return F.transform(both, lambda x, i: F.pmod(x, F.when(i < SIGN_LANES, F.lit(SIGN_MOD)).otherwise(F.lit(WIDE_MOD))))


def insert(lanes: Column, added: Column) -> Column:
    """Lanes after pieces with the lanes ``added`` come in."""
    return _combine(lanes, added, 1)


def delete(lanes: Column, removed: Column) -> Column:
    """Lanes after pieces with the lanes ``removed`` go out."""
    return _combine(lanes, removed, -1)


def encode(lanes: Column) -> Column:
    """Fixed-width hex: 4 digits a sign lane, 8 a wide lane."""
    digits = F.transform(lanes, lambda x, i: F.lpad(F.lower(F.hex(x)), F.when(i < SIGN_LANES, 4).otherwise(8), F.lit("0")))
    return F.array_join(digits, "")


def _energy(lanes: Column) -> Column:
    """Sum of squares of the sign lanes, read as signed numbers."""
    signed = F.transform(F.slice(lanes, 1, SIGN_LANES),
                         lambda x: F.when(x >= SIGN_MOD // 2, x - SIGN_MOD).otherwise(x).cast("double"))
    return F.aggregate(signed, F.lit(0.0), lambda acc, x: acc + x * x)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else 1 - |a-b|^2 / (|a|^2 + |b|^2) from the sign lanes, within 0 to 1."""
    both = _energy(a) + _energy(b)
    value = F.when(both > 0, 1.0 - _energy(delete(a, b)) / both).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def _key(doc_id: Column, text: Column) -> list[Column]:
    """The order of documents, ascending: ids descending, null ids last, then the text's first characters and hashes."""
    return [doc_id.isNull().alias("gone"), F.coalesce(F.bitwise_not(doc_id), F.lit(0).cast("long")).alias("down"),
            F.substring(text, 1, LEAD_CHARS).alias("lead"), F.xxhash64(text).alias("uid"), F.xxhash64(text, F.lit(1)).alias("uid2")]


KEY = ["gone", "down", "lead", "uid", "uid2"]
_CUTS = "array<struct<gone:boolean,down:bigint,lead:string,uid:bigint,uid2:bigint>>"


def range_cuts(keys: DataFrame, ranges: int, rows: int) -> list[Row]:
    """About ``ranges - 1`` cuts of the (different) keys: every 16th of a regular sample, in order."""
    if ranges < 2:
        return []
    every = max(1, rows // (ranges * PER_CUT))
    sample = keys.filter(F.pmod(F.xxhash64(*KEY, F.lit(11)), F.lit(every)) == 0).select(*KEY)
    sample = sample.repartitionByRange(min(ranges, 1000), *KEY).withColumn("pid", F.spark_partition_id())
    nth = F.row_number().over(W.partitionBy("pid").orderBy(*KEY))
    return sorted(sample.withColumn("nth", nth).filter(F.col("nth") % PER_CUT == 0).select(*KEY).collect())


def range_of(cuts: list[Row]) -> Column:
    """The number of cuts up to a row's key, by bisection: the cost of a row grows with their logarithm."""
    if not cuts:
        return F.lit(0)
    places = F.from_json(F.lit(json.dumps([c.asDict() for c in cuts])), _CUTS)  # folded to one literal by the planner

    def halve(acc: Column, key: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        up = F.get(places, mid) <= key
        return (F.when(acc["lo"] >= acc["hi"], acc)
                .when(up, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))
                .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi"))))

    def search(key: Column) -> Column:
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, lambda acc, _: halve(acc, key))["lo"]

    return F.get(F.transform(F.array(F.struct(*KEY)), search), F.lit(0))  # the key is made once a row


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with lanes, the ``follower``'s text and lanes, and how many rows it stands for (``times``).

    Rows are dealt to ranges of the order; a range also gets a copy of the row that
    follows its last one, so no task sees more than one range.  Ranges are cut
    by the whole key, so null ids and an id with many texts are split as well.  Equal rows
    are counted before the shuffle and travel as one: all but the last of them are followed by their like.
    Texts are shuffled once (twice where rows repeat); lanes are made after the copies are
    picked, so only rows that stay are hashed.  What the driver holds is one key per range.
    """
    docs = docs.select("doc_id", "text", *_key(F.col("doc_id"), F.col("text")))
    keys = materialize(docs.select(*KEY, F.octet_length("text").cast("long").alias("size"))
                       .groupBy(*KEY).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies")), "fingerprint-keys")
    rows, most, size = keys.agg(F.count(F.lit(1)), F.max("copies"), F.sum("size")).first()
    if rows and most > 1:
        docs = docs.groupBy(*KEY).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"),
                                      F.count(F.lit(1)).alias("copies"))
    else:
        docs = docs.withColumn("copies", F.lit(1).cast("long"))
    ranges = min(rows, (size or 0) // max(RANGE_BYTES, 16 * math.isqrt(size or 0)))
    bucket = range_of(range_cuts(keys, ranges, rows))
    heads = keys.withColumn("bucket", bucket).groupBy("bucket").agg(F.min(F.struct(*KEY)).alias("head"))
    # One row per range; the first range's head follows the last range's last row.
    before = F.coalesce(F.lag("bucket").over(W.orderBy("bucket")), F.max("bucket").over(W.partitionBy()))
    links = heads.select(before.alias("into"), *[F.col("head")[c].alias(f"h_{c}") for c in KEY])
    copies = (docs.join(F.broadcast(links), [F.col(c) == F.col(f"h_{c}") for c in KEY])
              .select(*docs.columns, F.col("into").alias("bucket")))
    both = (docs.withColumn("bucket", bucket).withColumn("ghost", F.lit(False))
            .unionByName(copies.withColumn("ghost", F.lit(True))))
    both = add_lanes(both, "text", "lanes")
    line = W.partitionBy("bucket").orderBy("ghost", *KEY)
    this = F.struct("text", "lanes")
    both = both.withColumn("follower", F.lead(this).over(line)).filter("not ghost")
    last = F.struct("follower", F.lit(1).cast("long").alias("times"))
    if rows and most > 1:
        others = F.struct(this.alias("follower"), (F.col("copies") - 1).alias("times"))
        both = both.withColumn("_as", F.explode(F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last))))
    else:
        both = both.withColumn("_as", last)
    return both.select("doc_id", "text", "lanes", "_as.follower", "_as.times")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of the texts and of the edited texts, and both likenesses; see the module's first lines."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut),
                      F.substring(F.col("follower.text"), F.lit(1), cut))
    docs = docs.select("doc_id", "n_chars", "lanes", F.col("follower.lanes").alias("next_lanes"),
                       edited.alias("edited"), "times")
    docs = add_lanes(docs, "edited", "edited_lanes")
    docs = docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), encode(F.col("lanes")).alias("fingerprint"),
        encode(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"), "times")
    # A row that stands for many equal ones gives them back, 1,000 at a time so that they spread.
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / 1000)))
    parts = docs.withColumn("part", some).withColumn("part", F.least(F.lit(1000).cast("long"), F.col("times") - F.col("part") * 1000))
    return parts.withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("part")))).drop("times", "part")


@register("op8_fingerprint_documents")
def op8_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: multiset fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))
