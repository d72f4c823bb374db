"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of 1 to 3 characters of the lower-cased text, with everything
but letters read as one space, hashed to ``BUCKETS`` counts; TF is 1 + log(count),
rows are scaled to length 1.  Document frequencies come from every training row.

Training is follow-the-regularised-leader (FTRL-proximal) with elastic-net
penalties.  It runs over a sample of at most about ``SAMPLE_PER_LANGUAGE`` rows of
each language (rows whose hash is below a share set from the language's count):
``SHARDS`` tasks start from the same state, pass over their rows, and their states
are averaged after each epoch.  A tenth of the sample sets the temperature of the
softmax.  The model, numbers per bucket and language, is all that is broadcast.

Defined results: a null text or one without letters is ``und`` with score 0; if no
row has a language, every row is ``und``.  Repeated rows are rows of their own; an
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, read_table
from .registry import register

BUCKETS = 1 << 15
NGRAMS = 3
SAMPLE_PER_LANGUAGE = 1500
SHARDS, EPOCHS = 4, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
UNKNOWN = "und"
_STEP = 1 << 20  # characters hashed at once


def _letter_table(cache: dict = {}) -> np.ndarray:  # noqa: B006 - one per worker
    """Code point to itself for letters, to 0 for all else."""
    if "t" not in cache:
        cache["t"] = np.fromiter((i if unicodedata.category(chr(i))[0] == "L" else 0 for i in range(0x110000)), np.uint32)
    return cache["t"]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of a whole text; none if it has no letter."""
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    if not text:
        return none
    code = _letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not code.any():
        return none
    code = np.r_[np.uint32(0), code, np.uint32(0)]
    code = code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]].astype(np.uint64)  # one space between words
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(code), _STEP):
        part = code[at:at + _STEP + NGRAMS - 1]
        mixed = np.zeros(len(part), np.uint64)
        for n in range(1, NGRAMS + 1):
            width = len(part) - n + 1
            if width <= 0:
                break
            mixed = mixed[:width] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1:n - 1 + width] + np.uint64(n)
            own = mixed[:_STEP]  # n-grams that start in the next step's part are counted there
            hashed = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((hashed >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def tfidf(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of length 1."""
    at, counts = ngram_counts(text)
    weights = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt((weights * weights).sum())
    return (at, weights / norm) if norm > 0 else (at[:0], weights[:0])


def ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of an FTRL state: zero where the L1 penalty holds, else the closed form with L2."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl_epoch(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass: ``z`` and ``n`` (bucket, language) change in place."""
    for at, x, label in rows:
        own_z, own_n = z[at], n[at]
        w = ftrl_weights(own_z, own_n)
        error = _softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error[None, :]
        g2 = g * g
        z[at] = own_z + g - (np.sqrt(own_n + g2) - np.sqrt(own_n)) / ALPHA * w
        n[at] = own_n + g2


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training must not see: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def _share(salt: int) -> Column:
    return F.pmod(F.xxhash64("text", "doc_id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


class Model:
    """Languages, IDF, weights and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def logits(self, text: str | None) -> np.ndarray | None:
        at, x = tfidf(text, self.idf)
        return x @ self.weights[at] if len(at) else None

    def predict(self, text: str | None) -> tuple[str, float]:
        logits = self.logits(text) if self.languages else None
        if logits is None:
            return UNKNOWN, 0.0
        p = _softmax(logits / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each bucket, and documents in all, over every row."""
    def partial(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total[ngram_counts(text)[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[total[at], n])], ["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    docs = 0
    for bucket, n in (rows.select("text").mapInArrow(partial, "bucket long, n long")
                      .groupBy("bucket").agg(F.sum("n")).collect()):  # at most BUCKETS + 1 rows
        if bucket < 0:
            docs = n
        else:
            counts[bucket] = n
    return counts, docs


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The softmax temperature of least negative log-likelihood, by a narrowing grid."""
    low, high = np.log(0.2), np.log(20.0)
    best = 1.0
    for _ in range(4):
        grid = np.linspace(low, high, 21)
        loss = [-np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
                for t in grid]
        k = int(np.argmin(loss))
        low, high, best = grid[max(0, k - 1)], grid[min(20, k + 1)], float(np.exp(grid[k]))
    return best


def _shard_epoch(state, epoch: int, label: dict[str, int]):
    """One epoch over a shard's rows, from the broadcast state: the state after it."""
    def one_pass(table):
        z, n, idf = (x.copy() for x in state.value)
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts, langs = table.column("text").to_pylist(), table.column("lang").to_pylist()
        order = np.random.default_rng(epoch).permutation(table.num_rows)
        ftrl_epoch([(*tfidf(texts[i], idf), label[langs[i]]) for i in order], z, n)
        return pa.table({"rows": pa.array([table.num_rows]), "z": pa.array([z.tobytes()]), "n": pa.array([n.tobytes()])})
    return one_pass


def train(rows: DataFrame) -> Model:
    """A model from ``rows`` (doc_id, text, lang); rows without a text or language are not used."""
    spark = rows.sparkSession
    rows = rows.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS, 0)))
    counts, docs = document_frequencies(rows)
    idf = np.log((1 + docs) / (1 + counts)) + 1
    share = F.element_at(F.create_map(*[F.lit(x) for lang in languages for x in (
        lang, min(1.0, SAMPLE_PER_LANGUAGE / sizes[lang]))]), F.col("lang"))
    sample = materialize(rows.filter(_share(1) < share).withColumn("check", _share(2) < 0.1)
                         .withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SHARDS))), "language-sample")
    label = {lang: i for i, lang in enumerate(languages)}
    z, n = np.zeros((BUCKETS, len(languages))), np.zeros((BUCKETS, len(languages)))
    for epoch in range(EPOCHS):
        state = spark.sparkContext.broadcast((z, n, idf))
        shards = (sample.filter("not check").groupBy("shard")
                  .applyInArrow(_shard_epoch(state, epoch, label), "rows long, z binary, n binary").collect())
        state.unpersist()
        used = sum(s["rows"] for s in shards)
        if used:  # the mean of the shards' states, by their rows
            z, n = (sum(np.frombuffer(s[k]).reshape(z.shape) * (s["rows"] / used) for s in shards) for k in ("z", "n"))
    model = Model(languages, idf, ftrl_weights(z, n))
    kept = sample.filter("check").select("text", "lang").collect()  # a tenth of the bounded sample
    scored = [(model.logits(r["text"]), label[r["lang"]]) for r in kept]
    scored = [(x, y) for x, y in scored if x is not None]
    if scored:
        model.temperature = temperature_of(np.array([x for x, _ in scored]), np.array([y for _, y in scored]))
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()),
             pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("text"))
    return arrow_map(rows, score, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out and have a language; predict every row."""
    return predict(docs, train(docs.filter(~held_out())))


@register("op1_identify_language")
def op1_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: the language of every document, learned from the rows that are not held out."""
    return identify(read_table(spark, sf_dir, "documents"))
