"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item; an item of fewer
words is one window.  A document word is hit if an occurrence of a window in the
document covers it.

A window is a set of word shingles.  A document that contains the window holds
every one of them, so of the shingles in order of rarity a prefix of one is
necessary: the window's rarest shingle, by counts over all documents.  Documents
are joined by that shingle only.  The shingle's place in the window then fixes
where the window would start, which bounds the position (not before the first
word) and the length (not beyond the last), and the words there are compared.

Both passes over the documents (counts, join) read each text once and do not
shuffle it: the other side is the benchmark's table, broadcast below
``BROADCAST_BYTES`` as measured.  Above that the positions are joined by a
shuffle, and texts only come back for places that pass the bounds.
Hits depend on the text alone, so equal texts are one text until the last join.
Only DataFrame functions are used.

Defined results: null and empty texts, and texts without a word, have no words
and no hits; items without words have no windows.  Rows of ``docs`` that repeat
stay apart; items with one id count once, and an item with a null id marks words
as hit but is not counted.  An empty benchmark hits nothing, an empty table gives
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table
from .registry import register

WINDOW = 10  # words
SHINGLE = 5  # words; of shorter windows all
#: Most bytes of windows or shingles that are sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Words are runs of a-z, 0-9 and what is not ASCII, after A-Z became a-z: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case and other letters as they are.

    One pass turns separators into spaces; a split at a space needs no regular expression, whose
    negated class costs some ten times as much.
    """
    plain = F.translate(text, string.ascii_uppercase + SEPARATORS, string.ascii_lowercase + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def _shingle_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, at + k) for k in range(length)])


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, owners, shingles): (wid, win, n), (wid, item_id) and (wid, off, len, h), each row once."""
    rows = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))))
    rows = rows.select("item_id", "w", first.alias("at")).select("item_id", F.slice("w", F.col("at") + 1, window).alias("win"))
    rows = materialize(rows.withColumn("wid", F.md5(F.array_join("win", " "))), "leak-windows")
    windows = rows.groupBy("wid").agg(F.first("win").alias("win")).withColumn("n", F.size("win"))
    parts = []
    for length in range(1, shingle + 1):
        own = windows.filter(F.col("n") >= length) if length == shingle else windows.filter(F.col("n") == length)
        own = own.select("wid", "win", F.explode(F.sequence(F.lit(0), F.col("n") - length)).alias("off"))
        parts.append(own.select("wid", "off", F.lit(length).alias("len"),
                                _shingle_hash(F.col("win"), F.col("off"), length).alias("h")))
    shingles = parts[0]
    for part in parts[1:]:
        shingles = shingles.unionByName(part)
    owners = rows.filter("item_id is not null").select("wid", "item_id").distinct()
    return windows, owners, materialize(shingles, "leak-shingles")


def _positions(docs: DataFrame, length: int) -> DataFrame:
    """(tkey, words, i, h): every shingle of ``length`` words of every text; the outer form keeps the scan to one parse."""
    last = F.size("words") - length
    at = F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last)))
    return docs.select("tkey", "words", at.alias("i")).withColumn("h", _shingle_hash(F.col("words"), F.col("i"), length))


def _fits(table: DataFrame, bytes_of: Column, most: int) -> bool:
    size = table.agg(F.coalesce(F.sum(bytes_of + F.lit(64)), F.lit(0))).first()[0]
    return size <= most


def occurrences(docs: DataFrame, windows: DataFrame, shingles: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(tkey, start, n, wid): where windows occur in the texts of ``docs`` (tkey, words), each place once."""
    lengths = sorted(r[0] for r in shingles.select("len").distinct().collect())  # at most the shingle's length
    if not lengths:
        return shingles.select(F.lit(None).cast("binary").alias("tkey"), F.lit(0).alias("start"), F.lit(0).alias("n"), "wid")
    hashes = shingles.select("len", "h").distinct()
    near = F.broadcast if _fits(hashes, F.lit(16), broadcast_bytes) else (lambda t: t)
    counts = None
    for length in lengths:
        own = _positions(docs, length).select("h").join(near(hashes.filter(F.col("len") == length).select("h")), "h")
        own = own.groupBy("h").agg(F.count(F.lit(1)).alias("freq"))
        counts = own if counts is None else counts.unionByName(own)
    counts = materialize(counts.groupBy("h").agg(F.sum("freq").alias("freq")), "leak-counts")
    # Rarity order over all documents; a window with a shingle that no document has cannot occur.
    rarest = (shingles.join(counts, "h", "left").groupBy("wid")
              .agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "off", "len", "h")).alias("s")).filter("s.freq > 0"))
    prefix = materialize(rarest.join(windows, "wid").select("wid", "s.off", "s.len", "s.h", "win", "n"), "leak-prefix")
    small = _fits(prefix, F.octet_length(F.array_join("win", "")) + 8 * F.col("n"), broadcast_bytes)
    start = F.col("i") - F.col("off")
    bounds = (start >= 0) & (start + F.col("n") <= F.size("words"))
    same = F.slice("words", F.col("i") - F.col("off") + 1, F.col("n")) == F.col("win")
    found = []
    for length in lengths:
        own = prefix.filter(F.col("len") == length)
        places = _positions(docs, length)
        if small:
            near = own.select(F.col("h").alias("ph"), "off", "n", "win", "wid")
            hit = places.join(F.broadcast(near), (F.col("h") == F.col("ph")) & bounds & same)
        else:
            fit = places.select("tkey", "i", "h", F.size("words").alias("total")).join(own.select("wid", "off", "n", "h"), "h")
            fit = (fit.filter((start >= 0) & (start + F.col("n") <= F.col("total"))).select("tkey", "i", "off", "n", "wid").distinct())
            # Texts come back once per text and window block, not once per place.
            texts = docs.join(fit.select("tkey").distinct(), "tkey").dropDuplicates(["tkey"])
            hit = (fit.join(own.select("wid", "win"), "wid").join(texts, "tkey").filter(same))
        found.append(hit.select("tkey", start.alias("start"), "n", "wid"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return materialize(out.distinct(), "leak-places")


def _covered(spans: Column) -> Column:
    """Positions in a sorted array of (start, n) intervals, each counted once."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def add(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["start"] + s["n"])
        return F.struct(end.alias("end"), (acc["total"] + end - F.greatest(acc["end"], F.least(s["start"], end))).alias("total"))
    return F.aggregate(spans, zero, add, lambda acc: acc["total"])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, spans): one row per row of ``docs``.

    ``item_ids``: the items with occurring windows, as sorted strings; ``spans``:
    the sorted word intervals (start, n) of the occurrences; both null for clean rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = F.unhex(F.md5("text"))
    texts = rows.filter("text is not null").select(key.alias("tkey"), words_of(F.col("text")).alias("words"))
    windows, owners, shingles = item_windows(items, window, shingle)
    places = occurrences(texts, windows, shingles, broadcast_bytes)
    spans = places.select("tkey", "start", "n").distinct().groupBy("tkey").agg(
        F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"))
    owned = (places.select("tkey", "wid").distinct().join(owners, "wid")
             .select("tkey", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("tkey").agg(F.sort_array(F.collect_list("item")).alias("item_ids")))
    # Written, so that the last join is one of its own, whose hot texts Spark can split.
    hits = materialize(spans.join(owned, "tkey", "left").withColumn("n_hit", _covered(F.col("spans"))), "leak-texts")
    n_words = F.size(words_of(F.coalesce("text", F.lit("")))).cast("long")
    return rows.select("doc_id", key.alias("tkey"), n_words.alias("n_words")).join(hits, "tkey", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "item_ids", "spans")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS span
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM it WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS span
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d JOIN lens ON len(w) >= n)),
hit AS (SELECT r, i, p.n, item_id FROM places AS p JOIN win ON p.span = win.span AND p.n = win.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN own USING (r)"""


@register("op11_benchmark_decontamination", SQL)
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: words of all documents that lie in 10-word windows of benchmark items, and these items."""
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
