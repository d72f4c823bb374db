"""Source divergence audit: how far the word use of sources in one language differs.

Tokens come from a translate table: ``bytes.translate`` lowers A-Z and turns
everything but letters and non-ASCII bytes into blanks in one pass, ``bytes.split``
cuts the terms, and a ``Counter`` per document gives their frequencies.  A first
pass counts a language's documents per term, a second one the occurrences per
(lang, source, term) of the terms that enough documents have.  A task adds its
documents up and passes on ``HELD_TERMS`` sparse counts at a time, and Spark sums
these, so a hot source or term costs a few rows per task.

Smoothed shares are whole numbers of billionths.  Divergence of two sources is
the sum of absolute differences over all kept terms of the language.  Terms are
dealt to blocks by hash; a block holds two chunks of the language's sources for
its terms (about ``BLOCK_CELLS`` counts) and gives the sums of their pairs, which
the result lists anyway; a source without a term of the block has its zero count.

Defined results: null text, lang and source count as empty strings; texts without
a term still make their (lang, source) a group; with no kept term all values are
0 and there are no term rows.  Repeated rows are documents of their own; an empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bytes_column, materialize, read_table
from .registry import register

LEAST_DOCS = 30
SMOOTH = 5
SCALE_STEPS, SCALE_STEP = 3, 1000  # a billion, in steps that keep long division within 64 bits
TOP_TERMS = 50
#: Counts (sources x terms) of one block, and sources of one chunk: a task holds two chunks.
BLOCK_CELLS, CHUNK_SOURCES = 1 << 16, 1024

#: Counts that a task holds before it passes them on; most bytes of kept terms that are sent to every executor.
HELD_TERMS, VOCABULARY_BYTES = 300_000, 32 << 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of letters and non-ASCII characters, A-Z in lower case."""
    return (text or b"").translate(_TABLE).split()


def _flush(groups: dict) -> pa.Table:
    """Counters by key tuple of strings (keys, term, n), emptied."""
    keys = list(groups)
    sizes = np.array([len(groups[k]) for k in keys])
    at = pa.array(np.repeat(np.arange(len(keys)), sizes))
    columns = [pa.array(names, pa.binary()).take(at).cast(pa.string()) for names in zip(*keys)]
    terms = pa.array([t for k in keys for t in groups[k]], pa.binary()).cast(pa.string())
    n = pa.array([v for k in keys for v in groups[k].values()], pa.int64())
    groups.clear()
    return pa.Table.from_arrays([*columns, terms, n], [*[f"k{i}" for i in range(len(columns))], "term", "n"])


def _sums(by: list[str], kept=None, documents: bool = False, most: int = HELD_TERMS):
    """A task's sums per key and term: occurrences, or documents; at most about ``most`` are held.

    ``kept`` gives the terms that count for a key, all if None.
    """
    def run(batches):
        groups: dict = {}
        for batch in batches:
            for *key, text in zip(*(bytes_column(batch, c) for c in (*by, "text"))):
                terms, few = terms_of(text), kept and kept(key)
                own = Counter(terms if few is None else filter(few.__contains__, terms))
                if not own:
                    continue
                total = groups.setdefault(tuple(key), Counter())
                if documents:
                    total.update(own.keys())
                else:
                    for term, n in own.items():
                        total[term] += n
            if groups and sum(map(len, groups.values())) >= most:
                yield from _flush(groups).to_batches(max_chunksize=50_000)
        if groups:
            yield from _flush(groups).to_batches(max_chunksize=50_000)
    return run


def term_documents(docs: DataFrame) -> DataFrame:
    """(lang, term, docs): documents of a language with a term."""
    found = docs.select("lang", "text").mapInArrow(_sums(["lang"], documents=True), "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("docs"))


def term_counts(docs: DataFrame, keep: dict[bytes, frozenset] | None = None) -> DataFrame:
    """(lang, source, term, count): occurrences of a term in a group; only of the terms in ``keep`` by language if given."""
    sent = docs.sparkSession.sparkContext.broadcast(keep)
    kept = None if keep is None else lambda key: sent.value.get(key[0], frozenset())
    found = docs.select("lang", "source", "text").mapInArrow(
        _sums(["lang", "source"], kept), "lang string, source string, term string, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("count"))


def _small_vocabulary(vocabulary: DataFrame, most: int) -> dict[bytes, frozenset] | None:
    """The kept terms by language if they need at most ``most`` bytes, to drop others before the shuffle; else none."""
    size = vocabulary.agg(F.coalesce(F.sum(F.octet_length("term") + F.octet_length("lang") + 64), F.lit(0))).first()[0]
    if size > most:
        return None
    rows = vocabulary.groupBy("lang").agg(F.collect_list("term").alias("terms")).collect()
    return {r.lang.encode(): frozenset(t.encode() for t in r.terms) for r in rows}


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + SMOOTH) / total) by long division; the share is at most 1."""
    rest, found = count + F.lit(SMOOTH), F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        scaled = rest * F.lit(SCALE_STEP)
        rest = scaled % total
        whole = F.round((scaled - rest) / total).cast("long")  # a multiple of total, at most SCALE_STEP of it: exact
        found = found * SCALE_STEP + whole
    return (found + 1).cast("long")


def _pair_sums(key, table):
    """Sums of |p - q| over a block's terms for all pairs of a source of chunk i and one of chunk j."""
    lang, _, i, j = (k.as_py() for k in key)
    column = {c: table.column(c).combine_chunks() for c in ("source", "term", "chunk", "p", "block_terms")}
    source, term = column["source"].dictionary_encode(), column["term"].dictionary_encode()
    found, p = source.dictionary.to_pylist(), column["p"].to_numpy()
    row, col = source.indices.to_numpy(), term.indices.fill_null(-1).to_numpy()
    whole = col < 0  # what a source has without a term
    base = np.zeros(len(found), np.int64)
    base[row[whole]] = p[whole]
    shares = np.repeat(base[:, None], len(term.dictionary), axis=1)
    shares[row[~whole], col[~whole]] = p[~whole]
    # terms of the block that only sources of other chunks have
    others = int(column["block_terms"].to_numpy().max()) - len(term.dictionary)
    chunk = np.zeros(len(found), np.int64)
    chunk[row] = column["chunk"].to_numpy()
    chunk_of, row_of = dict(zip(found, chunk.tolist())), {s: k for k, s in enumerate(found)}
    names = sorted(found)
    left = [s for s in names if chunk_of[s] == i]
    right = [s for s in names if chunk_of[s] == j]
    at = [row_of[s] for s in right]
    sums = np.concatenate([np.abs(shares[at] - shares[row_of[s]]).sum(axis=1) + others * np.abs(base[at] - base[row_of[s]])
                           for s in left] or [np.zeros(0, np.int64)])
    one, two = [s for s in left for _ in right], right * len(left)
    if i != j:
        one, two, sums = one + two, two + one, np.concatenate([sums, sums])
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": pa.array(one, pa.string()),
                     "item": pa.array(two, pa.string()), "value": sums})


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS,
          top_terms: int = TOP_TERMS, block_cells: int = BLOCK_CELLS, chunk_sources: int = CHUNK_SOURCES,
          vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources of a language, and the terms that a source has more of."""
    empty = F.lit("")
    docs = docs.select(F.coalesce(F.col(lang_col), empty).alias("lang"), F.coalesce(F.col(source_col), empty).alias("source"),
                       F.col(text_col).alias("text"))
    frequent = term_documents(docs).filter(F.col("docs") >= least_docs).select("lang", "term")
    vocabulary = materialize(frequent, "divergence-terms")
    counts = term_counts(docs, _small_vocabulary(vocabulary, vocabulary_bytes))
    # The join decides which terms are kept; the vocabulary sent along only spares it rows.
    kept = materialize(counts.join(vocabulary, ["lang", "term"]), "divergence-counts")
    vocabulary = materialize(kept.groupBy("lang", "term").agg(F.sum("count").alias("lang_count")), "divergence-vocabulary")
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_count").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = docs.select("lang", "source").distinct()
    # One row per group: its total, its language's, the kept terms; zero where there are none.
    zero = {"total": 0, "terms": 0, "lang_total": 0}
    groups = groups.join(own, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(zero)
    many = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    chunks = F.ceil(F.col("sources") / F.lit(chunk_sources)).cast("long")
    blocks = F.ceil(F.col("terms") * F.least("sources", F.lit(2 * chunk_sources)) / F.lit(block_cells))
    groups = groups.join(many, "lang").withColumn("blocks", F.greatest(F.lit(1), blocks).cast("long")).withColumn("chunks", chunks)
    groups = materialize(groups.withColumn("chunk", F.pmod(F.xxhash64("source"), F.col("chunks"))), "divergence-groups")
    base = F.col("terms") * F.lit(SMOOTH)
    shared = kept.join(vocabulary, ["lang", "term"]).join(groups, ["lang", "source"])
    shared = shared.withColumn("p", _share(F.col("count"), F.col("total") + base))
    # Pairs of sources, a block of terms and two chunks of sources at a time.
    cells = shared.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "chunk", "chunks", "term", "p",
                          F.lit(0).cast("long").alias("block_terms"))
    first = F.lit(0).cast("long")
    block_terms = (vocabulary.join(groups.select("lang", "blocks").distinct(), "lang")
                   .groupBy("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
                   .agg(F.count(F.lit(1)).alias("block_terms")))
    without = groups.select("lang", F.explode(F.sequence(first, F.col("blocks") - 1)).alias("block"), "source", "chunk", "chunks",
                            F.lit(None).cast("string").alias("term"),
                            F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.greatest(F.col("total") + base, F.lit(1))))
                            .otherwise(0).cast("long").alias("p"))
    without = without.join(block_terms, ["lang", "block"], "left").fillna({"block_terms": 0})
    cells = cells.unionByName(without).withColumn("other", F.explode(F.sequence(first, F.col("chunks") - 1))).select(
        "lang", "block", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        "source", "chunk", "term", "p", "block_terms")
    sums = cells.groupBy("lang", "block", "i", "j").applyInArrow(_pair_sums, "lang string, source string, item string, value long")
    pairs = sums.filter("source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Terms that a source has more of than its language.
    terms = (shared.withColumn("q", _share(F.col("lang_count"), F.col("lang_total") + base)).filter("p > q")
             .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")))
    line = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    out = []
    for part, rows in (("pair", pairs), ("term", terms)):
        rows = rows.withColumn("rank", F.row_number().over(line))
        rows = rows.filter(F.col("rank") <= top_terms) if part == "term" else rows
        out.append(rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")))
    return out[0].unionByName(out[1])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS lc FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
vs AS (SELECT lang, count(*) AS V, sum(lc) AS ln FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN v USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (coalesce(t.total, 0) + 5 * V)::HUGEINT AS p,
    1 + (1000000000 * (lc + 5)::HUGEINT) // (ln + 5 * V)::HUGEINT AS q
  FROM g JOIN v USING (lang) JOIN vs USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
    LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b
  ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a
  JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tm AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM rk WHERE part = 'pair' OR rank <= 50"""


@register("op13_source_divergence", SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: divergence of all pairs of sources of a language, and the 50 terms that a source has most more of."""
    return audit(read_table(spark, sf_dir, "documents"))
