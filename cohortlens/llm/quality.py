"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (character classes, words, lines, repeats) are cut
into at most ``BINS`` bins by the sample's quantiles.  Trees grow level by level:
a level's splits come from one histogram of gradients and Hessians over (node,
statistic, bin).  The trees are flattened into arrays of statistic, threshold,
children and value, and a batch of documents walks all of them by numpy indexing.

Labels are learned from at most about ``SAMPLE`` labelled rows (all rows whose
hash is below a share set from the labels' count).  The forest, some thousand
numbers, is all that is broadcast.

Defined results: a null or empty text has statistics of 0 and a score as any
other; with no labels to learn from, every score is 0.5; of several labels of one
id the mean counts, half or more as 1.  Repeated rows are rows of their own; an
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bytes_column, read_table
from .registry import register

SAMPLE = 6000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
LEAF_HESSIAN, L2 = 1.0, 1.0

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line break, 6 beyond ASCII, 7.. marks
_CLASS[ord("a"):ord("z") + 1], _CLASS[ord("A"):ord("Z") + 1], _CLASS[ord("0"):ord("9") + 1] = 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[128:] = 4, 5, 6
for _i, _group in enumerate((".", ",", "!?", "|", "#*%$@&^~_=+<>/\\", "-:;", "'\"()[]{}")):
    _CLASS[[ord(c) for c in _group]] = 7 + _i
_CLASSES = 14

STATISTICS = [
    "log_bytes", "log_words", "word_length", "word_length_spread", *[f"class_{i}" for i in range(_CLASSES)],
    "lines", "line_length", "short_lines", "repeated_lines", "repeated_line_bytes", "marked_lines",
    "distinct_words", "top_word", "repeated_triples", "short_words", "long_words", "capitalised", "upper_words",
    "marked_words", "sentence_length", "letters",
]


def statistics(text: bytes | None) -> list[float]:
    """The numbers of ``STATISTICS`` for one UTF-8 text."""
    text = text or b""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(len(text), 1)
    classes = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=_CLASSES)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n_words = max(len(words), 1)
    seen = Counter(words)
    line_lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    n_lines = max(len(lines), 1)
    distinct_lines = set(lines)
    triples = list(zip(words, words[1:], words[2:]))
    upper = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    capital = sum(c for w, c in seen.items() if w[:1].isupper())
    marked = sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,")
    sentences = classes[7] + classes[9]
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean() if len(words) else 0.0,
        lengths.std() if len(words) else 0.0, *(classes / n).tolist(),
        len(lines) / n_words, np.log1p(line_lengths.mean()) if len(lines) else 0.0,
        float((line_lengths < 30).sum()) / n_lines, 1 - len(distinct_lines) / n_lines if lines else 0.0,
        1 - sum(map(len, distinct_lines)) / max(int(line_lengths.sum()), 1) if lines else 0.0,
        sum(x.strip()[-1:] not in (b".", b",") for x in lines) / n_lines,
        len(seen) / n_words, max(seen.values(), default=0) / n_words, 1 - len(set(triples)) / max(len(triples), 1) if triples else 0.0,
        float((lengths <= 2).sum()) / n_words, float((lengths >= 15).sum()) / n_words, capital / n_words, upper / n_words,
        marked / n_words, np.log1p(n_words / max(sentences, 1)), (classes[1] + classes[2] + classes[6]) / n,
    ]


class Forest:
    """Trees as flat arrays: node i tests statistic[i] <= threshold[i]; a leaf is its own child."""

    def __init__(self, base: float):
        self.base = base
        self.roots: list[int] = []
        self.statistic: np.ndarray | list[int] = []
        self.threshold: np.ndarray | list[float] = []
        self.left: np.ndarray | list[int] = []
        self.right: np.ndarray | list[int] = []
        self.value: np.ndarray | list[float] = []

    def add(self) -> int:
        node = len(self.value)
        for column, x in ((self.statistic, 0), (self.threshold, np.inf), (self.left, node), (self.right, node), (self.value, 0.0)):
            column.append(x)
        return node

    def freeze(self) -> Forest:
        for name, kind in (("statistic", np.int64), ("threshold", np.float64), ("left", np.int64), ("right", np.int64),
                           ("value", np.float64)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: all trees walked at once, a level a step."""
        at = np.tile(np.array(self.roots, np.int64), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH if self.roots else 0):
            at = np.where(x[rows, self.statistic[at]] <= self.threshold[at], self.left[at], self.right[at])
        total = self.base + (self.value[at].sum(axis=1) if self.roots else np.zeros(len(x)))
        return 1 / (1 + np.exp(-total))


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    """Upper bounds of the bins of each statistic, by quantiles."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boosted trees with logistic loss on the rows ``x`` with labels ``y`` (0 or 1)."""
    if not len(y):
        return Forest(0.0).freeze()
    mean = float(np.clip(y.mean(), 0.01, 0.99))
    forest = Forest(float(np.log(mean / (1 - mean))))
    if y.min() == y.max():
        return forest.freeze()
    cuts = _cuts(x)
    binned = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)])
    features = x.shape[1]
    flat = binned + np.arange(features) * BINS
    score = np.full(len(y), forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = p - y, p * (1 - p)
        forest.roots.append(forest.add())
        node = np.zeros(len(y), np.int64)  # place of each row's node in ``open``
        open_nodes = [forest.roots[-1]]
        for level in range(DEPTH + 1):
            sums = np.zeros((2, len(open_nodes), features * BINS))
            cell = (node[:, None] * (features * BINS) + flat)[node >= 0].ravel()
            for k, weight in enumerate((gradient, hessian)):
                sums[k] = np.bincount(cell, np.repeat(weight[node >= 0], features),
                                      len(open_nodes) * features * BINS).reshape(len(open_nodes), -1)
            g, h = sums.reshape(2, len(open_nodes), features, BINS)
            whole_g, whole_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
            for k, tree_node in enumerate(open_nodes):
                forest.value[tree_node] = -RATE * whole_g[k] / (whole_h[k] + L2)
            left_g, left_h = g.cumsum(axis=2)[..., :-1], h.cumsum(axis=2)[..., :-1]
            right_g, right_h = whole_g[:, None, None] - left_g, whole_h[:, None, None] - left_h
            gain = (left_g ** 2 / (left_h + L2) + right_g ** 2 / (right_h + L2)
                    - (whole_g ** 2 / (whole_h + L2))[:, None, None])
            gain[(left_h < LEAF_HESSIAN) | (right_h < LEAF_HESSIAN)] = 0
            new_node, opened = np.full(len(y), -1), []
            for k, tree_node in enumerate(open_nodes):
                feature, split = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
                mine = node == k
                if level == DEPTH or gain[k, feature, split] <= 1e-9 or split >= len(cuts[feature]):
                    score[mine] += forest.value[tree_node]
                    continue
                forest.statistic[tree_node], forest.threshold[tree_node] = int(feature), float(cuts[feature][split])
                goes_left = mine & (binned[:, feature] <= split)
                for side, rows in (("left", goes_left), ("right", mine & ~goes_left)):
                    child = forest.add()
                    getattr(forest, side)[tree_node] = child
                    new_node[rows] = len(opened)
                    opened.append(child)
            node, open_nodes = new_node, opened
            if not open_nodes:
                break
    return forest.freeze()


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels training must not see: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    """A forest from the labelled rows of ``docs`` (doc_id, text) that are not held out."""
    marked = (labels.filter("doc_id is not null and quality is not null").filter(~held_out())
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label")))
    n = marked.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # About SAMPLE rows at most: a proven bound for the broadcast and for what the driver gets.
    sample = F.broadcast(marked.filter(share < min(1.0, SAMPLE / max(n, 1))))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "label", "text")

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = [statistics(t) for t in bytes_column(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"),
                                           pa.array(numbers, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    found = sorted((r["doc_id"], r["label"], r["x"]) for r in
                   arrow_map(rows, measured, "doc_id long, label int, x array<double>").collect())
    x = np.array([r[2] for r in found]).reshape(len(found), len(STATISTICS))
    return fit(x, np.array([r[1] for r in found], np.float64))


def scorer(docs: DataFrame, forest: Forest):
    """A function of an Arrow batch with ``text``: the scores of its rows."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batch: pa.RecordBatch) -> np.ndarray:
        x = np.array([statistics(t) for t in bytes_column(batch, "text")]).reshape(batch.num_rows, len(STATISTICS))
        return shared.value.scores(x)

    return score


def score_documents(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``."""
    score = scorer(docs, forest)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = score(batch)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s),
                                           pa.array((s >= 0.5).astype(np.int32))],
                                          ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("text"))
    return arrow_map(rows, scored, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs`` whose text the forest accepts (score 0.5 or more), all columns."""
    score = scorer(docs, forest)
    return docs.mapInArrow(
        lambda batches: (b.filter(pa.array(score(b) >= 0.5)) for b in batches if b.num_rows), docs.schema)


@register("op5_score_quality")
def op5_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: the quality of every document, learned from the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))
