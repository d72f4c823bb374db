"""Repeated passages by super-k-mer partitioning.

A window is 50 consecutive words of one document.  A word is removed if a window
that covers it also starts in a document with a smaller id.

Each window's minimiser is the least hash among its runs of ``RUN`` words.
Consecutive windows with the same minimiser form a super-k-mer: one packed string
of words that travels to the minimiser's bucket.  Equal windows have equal
minimisers, so all their occurrences meet there; the bucket sorts and compares
the words themselves, hashes only route.

Steps, each a Spark job over the whole table:
1. every document's super-k-mers as (minimiser, id, place), without their words;
2. minimisers seen in more than one document (an aggregate, so frequent ones cost
   one row per task); windows of the others cannot repeat in another document;
3. the words of the super-k-mers that are left, packed, once per distinct string
   with the smallest id that has it;
4. in each bucket, the smallest id of every window; buckets with more than
   BUCKET_STRINGS strings are dealt again by window, so no task holds one;
5. per document, the windows seen in a smaller id, and the words they cover.

Defined results: a null or empty text has no words and nothing removed; rows with
a repeated id are documents of their own, known by the id and a hash of the text,
but share the id, so they are not removed because of each other; rows with a null
id are kept whole and remove nothing elsewhere.  An empty table gives no rows.
Columns other than the id and the text are ignored (``cut_documents`` keeps them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bytes_column, materialize, read_table
from .registry import register

WINDOW = 50  # words
RUN = 8  # words of a minimiser
SMALL_BUCKET = 256  # distinct strings whose windows are compared through a dictionary
#: Distinct strings of a bucket that one task compares at once: some 13 MB of text and 1.4 million windows of 24 bytes.
BUCKET_STRINGS = 32_768

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULT2
    return x ^ (x >> np.uint64(29))


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006 - one table per worker
    """Powers of an odd number and of its inverse modulo 2^64, at least n of them."""
    if cache.get("n", 0) < n:
        size = 1 << int(np.ceil(np.log2(max(n, 1 << 12))))
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for name, base in (("p", _MULT), ("q", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            cache[name] = np.multiply.accumulate(steps)
        cache["n"] = size
    return cache["p"], cache["q"]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word, from running sums of a polynomial over the bytes."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = ~_SPACE[raw]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, q = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:len(raw)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64))


def super_kmers(hashes: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of a document's runs of windows with one minimiser."""
    n = len(hashes) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    runs = np.zeros(len(hashes) - run + 1, np.uint64)
    for i in range(run):
        runs = runs * _MULT + hashes[i:i + len(runs)]
    low, have, want = _mix(runs), 1, window - run + 1
    while have < want:  # minimum over ``have`` runs, doubled until it covers a window
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    return low[first].view(np.int64), first, np.diff(np.r_[first, n])


def _skeleton(window: int, run: int):
    def places(batch: pa.RecordBatch) -> pa.Table | None:
        out = []
        for doc, uid, text in zip(batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist(), bytes_column(batch, "text")):
            mini, first, n = super_kmers(word_hashes(text or b""), window, run)
            if len(mini):
                out.append((np.full(len(mini), doc), np.full(len(mini), uid), mini, first, n))
        if not out:
            return None
        doc, uid, mini, first, n = (np.concatenate(x) for x in zip(*out))
        return pa.table({"mini": mini, "doc_id": doc, "uid": uid, "first": first.astype(np.int32), "n": n.astype(np.int32)})
    return places


def _pack(window: int):
    """The words of each listed super-k-mer, joined by one space."""
    def pack(batch: pa.RecordBatch) -> pa.Table:
        out: dict[str, list] = {"mini": [], "doc_id": [], "uid": [], "first": [], "packed": []}
        for doc, uid, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist(),
                                          bytes_column(batch, "text"), batch.column("places").to_pylist()):
            words = (text or b"").split()
            for place in places:
                out["mini"].append(place["mini"])
                out["doc_id"].append(doc)
                out["uid"].append(uid)
                out["first"].append(place["first"])
                out["packed"].append(b" ".join(words[place["first"]:place["first"] + place["n"] + window - 1]))
        return pa.table(out, schema=pa.schema([("mini", pa.int64()), ("doc_id", pa.int64()), ("uid", pa.int64()),
                                               ("first", pa.int32()), ("packed", pa.binary())]))
    return pack


def _windows(packed: bytes, window: int) -> list[bytes]:
    words = packed.split(b" ")
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return [packed[starts[i]:ends[i + window - 1] - 1] for i in range(len(words) - window + 1)]


def _windows_least(strings: list[bytes], lows: list[int], window: int) -> list[np.ndarray]:
    """For each string, the smallest id of each of its windows, by the windows' words themselves."""
    if len(strings) <= SMALL_BUCKET:
        least: dict[bytes, int] = {}
        own = [_windows(s, window) for s in strings]
        for spans, low in zip(own, lows):
            for span in spans:
                if least.get(span, low) >= low:
                    least[span] = low
        return [np.array([least[s] for s in spans], np.int64) for spans in own]
    # Many strings: sort the windows by a hash, and compare each with the first of its hash.
    hashes, counts, edges = [], [], []
    for s in strings:
        h = word_hashes(s)
        p, q = _powers(len(h) + 1)
        sums = np.r_[np.uint64(0), np.cumsum(h * p[:len(h)])]
        hashes.append(_mix((sums[window:] - sums[:-window]) * q[:len(h) - window + 1]))
        counts.append(len(hashes[-1]))
        spaces = np.flatnonzero(np.frombuffer(s, np.uint8) == 32)
        edges.append((np.r_[0, spaces + 1], np.r_[spaces, len(s)]))
    key, low = np.concatenate(hashes), np.repeat(np.array(lows, np.int64), counts)
    owner = np.repeat(np.arange(len(strings)), counts)
    place = np.concatenate([np.arange(n) for n in counts])
    order = np.lexsort((low, key))
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    first = np.empty(len(key), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]

    def words_at(i: int) -> bytes:
        start, end = edges[owner[i]]
        return strings[owner[i]][start[place[i]]:end[place[i] + window - 1]]

    for i in np.flatnonzero(first != np.arange(len(key))).tolist():
        if words_at(i) != words_at(int(first[i])):  # two windows with one hash: by the words alone
            return [_by_words(strings, lows, window, at) for at in range(len(strings))]
    return np.split(low[first], np.cumsum(counts)[:-1])


def _by_words(strings: list[bytes], lows: list[int], window: int, at: int) -> np.ndarray:
    """The slow form for one string of a bucket in which window hashes collide."""
    own = _windows(strings[at], window)
    least = dict.fromkeys(own, lows[at])
    for s, low in zip(strings, lows):
        for span in _windows(s, window):
            if span in least and low < least[span]:
                least[span] = low
    return np.array([least[x] for x in own], np.int64)


def _runs(least: np.ndarray) -> list[dict]:
    """Windows [a, b) with one smallest id."""
    at = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return [{"a": int(a), "b": int(b), "least": int(least[a])} for a, b in zip(at, np.r_[at[1:], len(least)])]


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("least", pa.int64())]))


def _bucket_table(window: int):
    """Rows sorted by minimiser: the window runs of each string that a document above their id has."""
    def close(rows: list[tuple]) -> list[tuple]:
        skeys, lows, highs, strings = zip(*rows)
        if len(rows) == 1:  # one string: all its windows have its smallest id
            found = [np.full(strings[0].count(b" ") + 2 - window, lows[0], np.int64)]
        else:
            found = _windows_least(list(strings), list(lows), window)
        return [(k, _runs(least)) for k, high, least in zip(skeys, highs, found) if least.min() < high]

    def emit(done):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([r for _, r in done], _RUNS)],
                                          ["skey", "runs"])

    def run(batches):
        at, rows, done = None, [], []
        for batch in batches:
            for mini, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if mini != at:
                    done += close(rows) if rows else []
                    at, rows = mini, []
                rows.append(tuple(row))
            if len(done) >= 1000:
                yield emit(done)
                done = []
        done += close(rows) if rows else []
        if done:
            yield emit(done)
    return run


def _explode_windows(window: int):
    def run(batch: pa.RecordBatch) -> pa.Table:
        columns = [batch.column(c).to_pylist() for c in ("skey", "low", "high", "packed")]
        out = [(k, i, low, high, span) for k, low, high, p in zip(*columns) for i, span in enumerate(_windows(p, window))]
        types = {"skey": pa.binary(), "place": pa.int32(), "low": pa.int64(), "high": pa.int64(), "span": pa.binary()}
        return pa.table({n: pa.array(v, t) for (n, t), v in zip(types.items(), zip(*out))})
    return run


def window_runs(strings: DataFrame, window: int, bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """(skey, runs): for each packed string, runs of its windows with their smallest id.

    ``strings``: (mini, skey, low, high, packed), one row per distinct string with
    its smallest and largest id.  Strings without a window of a smaller id than
    ``high`` are left out.
    """
    partitions = max(1, int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = strings.groupBy("mini").agg(F.count(F.lit(1)).alias("strings"))
    big = sizes.filter(F.col("strings") > bucket_strings).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(31)))).select("mini", "salt")
    marked = strings.withColumn("salt", F.pmod(F.xxhash64("skey"), F.lit(32)).cast("int")).join(
        big.withColumn("large", F.lit(True)), ["mini", "salt"], "left")
    marked = materialize(marked, "substring-strings")
    small = (marked.filter("large is null").select("mini", "skey", "low", "high", "packed")
             .repartition(partitions, "mini").sortWithinPartitions("mini")
             .mapInArrow(_bucket_table(window), "skey binary, runs array<struct<a:int, b:int, least:bigint>>"))
    # Large buckets: by window.  The smallest id of a window, then back to the strings that have it.
    spans = arrow_map(marked.filter("large").select("skey", "low", "high", "packed"), _explode_windows(window),
                      "skey binary, place int, low long, high long, span binary")
    spans = materialize(spans.withColumn("span", F.unhex(F.sha2("span", 256))), "substring-windows")
    least = (spans.groupBy("span").agg(F.min("low").alias("least"), F.max("high").alias("top")).filter("least < top")
             .select("span", "least", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")))
    large = (spans.withColumn("salt", F.pmod(F.xxhash64("skey"), F.lit(16)).cast("int")).join(least, ["span", "salt"])
             .filter("least < high").groupBy("skey").agg(F.collect_list(F.struct(
                 F.col("place").alias("a"), (F.col("place") + 1).alias("b"), "least")).alias("runs")))
    return small.unionByName(large)


def repeated_spans(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc_id, uid, spans): word intervals [from, to) of each document that windows of smaller ids cover.

    ``docs``: (doc_id, uid, text); ``uid``, a hash of the text, tells texts of one id apart.
    """
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", "uid", "text")
    places = materialize(arrow_map(rows, _skeleton(window, run), "mini long, doc_id long, uid long, first int, n int"),
                         "substring-places")
    shared = (places.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
              .filter("lo < hi").select("mini", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt")))
    # A frequent minimiser is spread over salts on both sides of the join.
    wanted = (places.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int")).join(shared, ["mini", "salt"])
              .groupBy("doc_id", "uid").agg(F.collect_set(F.struct("mini", "first", "n")).alias("places")))
    found = arrow_map(rows.join(wanted, ["doc_id", "uid"]).select("doc_id", "uid", "text", "places"), _pack(window),
                      "mini long, doc_id long, uid long, first int, packed binary")
    found = materialize(found.withColumn("skey", F.unhex(F.sha2("packed", 256))), "substring-packed")
    strings = found.groupBy("mini", "skey").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                                                F.first("packed").alias("packed"))
    runs = window_runs(strings, window).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    hits = (found.select("doc_id", "uid", "first", "skey", F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int").alias("salt"))
            .join(runs, ["skey", "salt"]))
    spans = F.transform(F.filter("runs", lambda r: r["least"] < F.col("doc_id")), lambda r: F.struct(
        (F.col("first") + r["a"]).alias("from"), (F.col("first") + r["b"] - 1 + F.lit(window)).alias("to")))
    return (hits.withColumn("spans", spans).filter(F.size("spans") > 0)
            .groupBy("doc_id", "uid").agg(F.flatten(F.collect_set("spans")).alias("spans")))


def _kept_words(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    if not spans:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        gone[min(s["from"], len(words))] += 1
        gone[min(s["to"], len(words))] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]): one row per row of ``docs``.

    With ``with_text`` the kept words joined by one space come out as well.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("uid"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, window)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, removed, digests, kept_texts = [], [], [], []
        for text, own in zip(bytes_column(batch, "text"), batch.column("spans").to_pylist()):
            words = (text or b"").split()
            kept = _kept_words(words, own)
            joined = b" ".join(kept)
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(joined).hexdigest())
            kept_texts.append(joined)
        out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(counts, pa.int64()),
               "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            out["kept"] = pa.array(kept_texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_pydict(out)

    both = docs.join(spans, ["doc_id", "uid"], "left").select("doc_id", "text", "spans")
    return arrow_map(both, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string"
                     + (", kept string" if with_text else ""))


def cut_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) without their repeated words, all columns.

    A text that loses words becomes its kept words joined by one space (and
    n_chars, if there, its length); a row that loses all its words goes; all other
    rows stay as they are.
    """
    names = docs.columns
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("uid")]
    spans = repeated_spans(docs.select(*keys, "text"), window)

    def cut(batches):
        for batch in batches:
            columns = dict(zip(names, batch.column("row").flatten()))
            own_spans = batch.column("spans").to_pylist()
            texts, stays = columns["text"].cast(pa.binary()).to_pylist(), []
            for i, own in enumerate(own_spans):
                if own:
                    texts[i] = b" ".join(_kept_words((texts[i] or b"").split(), own))
                stays.append(not own or bool(texts[i]))
            changed = batch.column("spans").is_valid()
            columns["text"] = pa.array(texts, pa.binary()).cast(pa.string())
            if "n_chars" in columns:
                lengths = pc.utf8_length(columns["text"]).cast(columns["n_chars"].type)
                columns["n_chars"] = pc.if_else(changed, lengths, columns["n_chars"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(stays, pa.bool_()))

    # The whole row travels as one column, so its names cannot clash.
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), *keys)
    return rows.join(spans, ["doc_id", "uid"], "left").select("row", "spans").mapInArrow(cut, docs.schema)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i AS place, array_to_string(w[i:i + 49], ' ') AS span
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
low AS (SELECT span, min(doc_id) AS lo FROM win GROUP BY span HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(place, place + 49)) AS pos
         FROM win JOIN low USING (span) WHERE lo < doc_id),
g AS (SELECT doc_id, list(pos) AS cut FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(cut), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(w, generate_series(1, len(w))),
    lambda x: cut IS NULL OR NOT list_contains(cut, x[2])), lambda x: x[1]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""


@register("op6_substring_dedup", SQL)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: all documents without the words of 50-word windows that a smaller id has."""
    return deduplicated(read_table(spark, sf_dir, "documents"))
