"""Mixing sources to target weights.

Each source's words form one line of fixed-length blocks.  Every slot of every
output shard draws its source, so a shard's source counts are multinomial; draws
beyond a source's quota go to sources short of theirs, so the totals meet the
targets.  The i-th slot of a source takes block ``perm(i)`` of a pseudorandom
permutation of the source's blocks, a further permutation on each pass, and slots
and blocks join by (source, index).  Only DataFrame functions are used.

Defined results: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own, last; repeated rows are documents of their own; an
empty table gives no rows.  A source is taken at most twice in full, so no
document is taken for more than 2 times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_REGEX, add_prefix, buckets_for, materialize, read_table
from .registry import register

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0  # of all sizes; of a source's size
BLOCK_WORDS = 32
SHARD_SLOTS = 4096
SEED = 20
ROUNDS, WALKS = 4, 64  # of the permutations


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (..., weight, target): water-filling, one row per source.

    A source stops at MOST times its size; below that all have the same target
    per weight.  Sources in the order of their stop per weight: the first k stop,
    where k is the least with the rest's level at most the next one's stop.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(MOST))
    everything = W.partitionBy()
    line = W.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    s = (s.withColumn("total", F.sum("source_size").over(everything) * F.lit(SHARE))
         .withColumn("weights", F.sum("weight").over(everything))
         .withColumn("stopped", F.coalesce(F.sum("stop").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("used", F.coalesce(F.sum("weight").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))))
    level = (F.col("total") - F.col("stopped")) / (F.col("weights") - F.col("used"))
    s = s.withColumn("level", F.when(level * F.col("weight") <= F.col("stop"), level))
    s = s.withColumn("level", F.max("level").over(everything))
    target = F.coalesce(F.least(F.col("stop"), F.col("level") * F.col("weight")), F.col("stop"))
    return s.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _uniform(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _permuted(index: Column, blocks: Column, *salt: Column) -> Column:
    """A pseudorandom permutation of 0..blocks-1 chosen by ``salt``: a Feistel network with cycle walking.

    A number is two digits of bases a and b, about the root of ``blocks`` each; in turn
    each digit moves by a hash of the other.  That permutes 0..ab-1, with fewer than
    a numbers beyond ``blocks``; a number that comes out beyond is permuted again.  Up to 4,096 blocks WALKS
    steps always end, above the chance that they do not is below blocks to the power -30, and then it is an error.
    """
    a = F.ceil(F.sqrt(blocks.cast("double"))).cast("long")
    b = F.ceil(blocks / a).cast("long")

    def once(x: Column) -> Column:
        low, high = F.pmod(x, a), F.floor(x / a).cast("long")
        for k in range(0, ROUNDS, 2):
            low = F.pmod(low + F.pmod(F.xxhash64(high, *salt, F.lit(k)), a), a)
            high = F.pmod(high + F.pmod(F.xxhash64(low, *salt, F.lit(k + 1)), b), b)
        return high * a + low

    first = once(index)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(x < blocks, x).otherwise(once(x)))
    found = F.when(first < blocks, first).otherwise(walked)
    return F.when(found < blocks, found).otherwise(F.raise_error(F.lit("no end of a permutation's cycle")).cast("long"))


def draw_slots(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """(out_shard, slot, src, block): one row per slot of the mix.

    ``plan``: (src, blocks, quota).  Each slot draws a source with the quotas as
    probabilities.  Slots are numbered within their source; numbers beyond the
    quota are dealt in order to the sources that are short.
    """
    line = W.orderBy("src").rowsBetween(W.unboundedPreceding, -1)
    plan = materialize(plan.withColumn("lo", F.coalesce(F.sum("quota").over(line), F.lit(0)).cast("long"))
                       .withColumn("hi", F.col("lo") + F.col("quota")), "mix-plan")
    slots = int(plan.agg(F.coalesce(F.max("hi"), F.lit(0))).first()[0])
    buckets = buckets_for(slots, 500_000)
    # Sources by ranges of the draw: an equality join on cells of the unit line, then the exact range.
    cells = 4096
    ranges = plan.filter("quota > 0").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") * cells / F.lit(max(slots, 1))), F.floor((F.col("hi") - 1) * cells / F.lit(max(slots, 1))))))
    drawn = (spark.range(0, slots, 1, max(spark.sparkContext.defaultParallelism, buckets)).withColumn("x", F.floor(_uniform(F.col("id")) * slots).cast("long"))
             .withColumn("cell", F.floor(F.col("x") * cells / F.lit(max(slots, 1))))
             .join(ranges.select("cell", "src", "lo", "hi", "quota"), "cell")
             .filter("x >= lo and x < hi").select("id", "src", "quota"))
    drawn = materialize(add_prefix(drawn, ["src"], ["id"], {"nth": F.lit(1)}, buckets), "mix-draws")
    within = drawn.filter("nth < quota").select("id", "src", "nth")
    over = drawn.filter("nth >= quota").select("id")
    got = drawn.groupBy("src").agg(F.count(F.lit(1)).alias("got"))
    short = (plan.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0)))
             .withColumn("lack", F.greatest(F.lit(0), F.col("quota") - F.col("got"))).filter("lack > 0")
             .withColumn("from", F.coalesce(F.sum("lack").over(line), F.lit(0)).cast("long"))
             .withColumn("to", F.col("from") + F.col("lack")))
    step = 64  # cells of so many surplus slots, for the same kind of join
    short = short.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / step), F.floor((F.col("to") - 1) / step))))
    over = (add_prefix(over.withColumn("one", F.lit(0)), ["one"], ["id"], {"at": F.lit(1)}, buckets)
            .withColumn("cell", F.floor(F.col("at") / step))
            .join(short.select("cell", "src", "got", "from", "to"), "cell").filter("at >= from and at < to")
            .select("id", "src", (F.col("got") + F.col("at") - F.col("from")).alias("nth")))
    taken = within.unionByName(over).join(plan.select("src", "blocks"), "src")
    turn = F.floor(F.col("nth") / F.col("blocks"))
    block = _permuted(F.pmod("nth", "blocks"), F.col("blocks"), F.col("src"), turn)
    return taken.select(F.floor(F.col("id") / SHARD_SLOTS).alias("out_shard"),
                        F.pmod("id", F.lit(SHARD_SLOTS)).alias("slot"), "src", block.alias("block"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
        ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, spans, slots).

    rows: one per document (uid, doc_id, size, source, source_size, target, src).
    spans: one per document and block that it has words in (doc_id, uid, src, start, block,
    first, words, uses): words [first, first + words) of the document, taken ``uses`` times.
    slots: the mix itself (out_shard, slot, src, block).
    """
    spark = docs.sparkSession
    base = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_REGEX)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(id_col, text_col, source_col).alias("uid")), "mix-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = source_targets(sizes)
    numbered = targets.withColumn("src", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    blocks = F.ceil(F.col("source_size") / F.lit(BLOCK_WORDS)).cast("long")
    numbered = numbered.withColumn("blocks", blocks).withColumn("quota", F.when(
        blocks > 0, F.least(2 * blocks, F.round(F.col("target") * blocks / F.col("source_size")))
    ).otherwise(F.lit(0)).cast("long"))
    numbered = materialize(numbered, "mix-sources")
    rows_n = base.count()
    rows = base.join(numbered.select(F.col("source").alias("_s"), "source_size", "target", "src"),
                     F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = materialize(add_prefix(rows, ["src"], ["doc_id", "uid"], {"start": F.col("size")}, buckets_for(rows_n)),
                       "mix-rows")
    slots = materialize(draw_slots(spark, numbered.filter("blocks > 0").select("src", "blocks", "quota")), "mix-slots")
    uses = slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("uses"))
    pieces = (rows.filter("size > 0").select(
        "doc_id", "uid", "src", "start", "size", F.explode(F.sequence(
            F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS))).alias("block"))
        .withColumn("first", F.greatest(F.lit(0), F.col("block") * BLOCK_WORDS - F.col("start")))
        .withColumn("words", F.least("size", (F.col("block") + 1) * BLOCK_WORDS - F.col("start")) - F.col("first")))
    spans = pieces.join(uses, ["src", "block"]).select("doc_id", "uid", "src", "start", "block", "first", "words", "uses")
    return rows, spans, slots


def mixed_sizes(docs: DataFrame, **cols: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per document."""
    rows, spans, _ = mix(docs, **cols)
    taken = (spans.groupBy("uid", "src", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
             .withColumnsRenamed({"uid": "_u", "src": "_c", "start": "_a"}))
    rows = rows.join(taken, (F.col("uid") == F.col("_u")) & (F.col("src") == F.col("_c")) & (F.col("start") == F.col("_a"))
                     & (F.col("size") > 0), "left")
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                       F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: the columns of ``docs``, each text cut to the words taken.

    A document gives up to two rows: its words in blocks taken at all, and those
    in blocks taken twice.  Words are joined by one space; n_chars follows the
    text.  A document of which nothing is taken gives no row, but one without
    words stays as it is.
    """
    names = docs.columns
    _, spans, _ = mix(docs)
    runs = (spans.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
            .groupBy("doc_id", "uid", "src", "start", "turn")
            .agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("runs"), F.sum("words").alias("n"))
            .select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "uid", "runs", "n"))
    # The whole row travels as one column, so its names cannot clash.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                      F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"),
                      F.xxhash64("doc_id", "text", "source").alias("uid"),
                      F.coalesce(F.regexp_count("text", F.lit(WORD_REGEX)), F.lit(0)).alias("size"))
    # Repeated rows share their id and uid: one of them stands for all, and joins the runs of each.
    nth = F.row_number().over(W.partitionBy("id", "uid").orderBy("size"))
    both = own.filter("size > 0").withColumn("nth", nth).filter("nth = 1").join(runs, ["id", "uid"])
    # The words are bound once per text, not once per run.
    words = F.array(F.regexp_extract_all(F.col("row.text"), F.lit(WORD_REGEX), F.lit(0)))
    kept = F.transform(words, lambda w: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(
        w, (r["first"] + 1).cast("int"), r["words"].cast("int")))), " "))[0]
    both = both.withColumn("text", F.when(F.col("n") == F.col("size"), F.col("row.text")).otherwise(kept))
    changed = {"text": F.col("text")}
    if "n_chars" in names:
        changed["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    both = both.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in names])
    return both.unionByName(own.filter("size = 0").select("row.*"))


@register("op9_mix_sources")
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: how many words of each document the mix of all sources takes."""
    return mixed_sizes(read_table(spark, sf_dir, "documents"))
