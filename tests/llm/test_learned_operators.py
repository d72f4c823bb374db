"""Operators 1, 2, 5 and 10: held-out accuracy, exact round trips, recall; hard rows and empty tables."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import language, neighbours, quality, warc
from cohortlens.session import fresh_path

SYLLABLES = {"xx": "ka ri to mu ne so".split(), "yy": "zhe bla ock urg fim dal".split(), "zz": "éa ñu ôi ça él üm".split()}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(3)
    rows = [(i, invented(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(400))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_on_held_out_rows(spoken):
    truth = {r.doc_id: r.lang for r in spoken.collect()}
    out = language.identify(spoken).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_never_sees_held_out_labels_nor_the_label_of_a_row(spoken):
    changed = spoken.withColumn("lang", F.when(language.held_out(), F.lit("never")).otherwise(F.col("lang")))
    assert sorted(language.identify(changed).collect()) == sorted(language.identify(spoken).collect())


def test_language_of_hard_rows(hard, empty):
    out = {}
    for r in language.identify(hard).collect():
        out.setdefault(r.doc_id, []).append(r)
    rows = hard.collect()
    assert sum(map(len, out.values())) == len(rows)
    for row in rows:
        letters = any(c.isalpha() for c in row.text or "")
        assert all((r.lang_pred == "und") == (not letters) or row.doc_id is None for r in out[row.doc_id])
    assert language.identify(empty).collect() == []
    none = hard.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.identify(none).collect()} == {("und", 0.0)}


def test_ngram_counts_in_steps_equal_counts_at_once(monkeypatch):
    text = invented(random.Random(1), "zz", 500)
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "_STEP", 37)
    parts = language.ngram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    letters = len([c for c in f" {' '.join(text.lower().split())} "])
    assert whole[1].sum() == 3 * letters - 3


def test_ftrl_is_sparse_and_calibration_finds_the_temperature():
    assert (language.ftrl_weights(np.array([0.5e-4, -1.0]), np.array([1.0, 1.0])) == 0).tolist() == [True, False]
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 2, (4000, 3))
    p = np.exp(logits / 2.5)
    p /= p.sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert abs(language.temperature_of(logits, labels) - 2.5) < 0.4


def test_quality_on_held_out_rows_and_hard_rows(spark, hard, empty):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        good = rng.random() < 0.7
        text = ". ".join(invented(rng, "xx", 9).capitalize() for _ in range(5)) if good else invented(rng, "xx", 30).upper().replace(" ", "!! ")
        rows.append((i, text, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, q int")
    labels = docs.select("doc_id", F.col("q").alias("quality"), F.lit("x").alias("text"))
    forest = quality.train(docs, labels)
    out = quality.score_documents(docs, forest).collect()
    truth = {i: q for i, _, q in rows}
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.predicted == (r.score >= 0.5) for r in out)
    changed = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, changed).value.tolist() == forest.value.tolist()

    scored = quality.score_documents(hard, forest).collect()
    assert len(scored) == hard.count() and all(0 <= r.score <= 1 for r in scored)
    kept = quality.accepted(hard, forest)
    assert kept.dtypes == hard.dtypes and kept.count() == sum(r.predicted for r in scored)
    assert quality.score_documents(empty, forest).collect() == [] and quality.accepted(empty, forest).collect() == []
    blank = quality.train(docs, labels.filter("false"))
    assert {r.score for r in quality.score_documents(hard, blank).collect()} == {0.5}


def test_flat_forest_equals_walking_each_tree():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = quality.fit(x, y, trees=15)
    scores = forest.scores(x)
    for row, got in list(zip(x, scores))[:50]:
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.statistic[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert abs(1 / (1 + np.exp(-total)) - got) < 1e-12
    assert ((scores >= 0.5) == y).mean() > 0.95
    assert quality.fit(x, np.ones(400)).scores(x[:3]).tolist() == pytest.approx([0.99] * 3)


PAGES = "page_id long, url string, html string, seconds long, digest string, first int"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        body = f"<html>é {rng.randint(0, 60)} " + "x" * 120 if i % 3 else f"<p>{i % 9}"
        rows.append((i, f"http://H{i % 7}.example.com:8080/p/{i % 11}?q={i % 5}#f", body + "\r\n\r\nWARC/1.1\r\n", 1000 + i % 4))
    rows += [(None, None, None, 0), (900, "no url \r\n at all", "", 5), (901, None, "z" * 5_000_000, 5)]
    rows += [(902, "http://a/", "same" * 40, 9)] * 3 + [(903, "http://a/", "same" * 40, 8), (None, "http://b/", "same" * 40, 8)]
    return spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES).repartition(4)


@pytest.mark.parametrize("file_records, range_rows, step", [(1000, 20_000, 100), (11, 40, 4)])
def test_warc_round_trip_and_merge(spark, pages, file_records, range_rows, step):
    path = fresh_path(spark, "test-warc")
    warc.write_archives(pages, path, file_records)
    out = warc.merge_runs(warc.read_runs(spark, path), range_rows, step).collect()
    rows = pages.collect()
    low = {}
    for r in rows:
        body = (r.html or "").encode()
        if len(body) >= 100 and r.page_id is not None:
            low[body] = min(low.get(body, r.page_id), r.page_id)
    want, seen = [], set()
    for r in sorted(rows, key=lambda r: (r.page_id is None, r.page_id or 0)):
        body = (r.html or "").encode()
        first = low.get(body)
        response = first is None or r.page_id == first and first not in seen
        seen.add(r.page_id)
        want.append((str(r.page_id), len(body), hashlib.sha256(body).hexdigest(), "response" if response else "revisit",
                     None if response else first))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(map(str, got)) == sorted(map(str, want))
    out.sort(key=lambda r: (r.range, r.position))
    keys = [(r.url_key, r.seconds, r.page_id is None, r.page_id or 0) for r in out]
    assert keys == sorted(keys)
    assert (len({r.range for r in out}) > 3) == (range_rows == 40)


def test_capture_index_numbers_all_captures(pages, spark):
    out = warc.capture_index(pages).collect()
    assert sorted(r.capture_seq for r in out) == list(range(pages.count()))
    assert warc.capture_index(spark.createDataFrame([], PAGES)).collect() == []


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(6)
    for runs in range(12):
        lists = [sorted(({"k": rng.randint(0, 30), "run": i} for _ in range(rng.randint(0, 9))), key=lambda c: c["k"]) for i in range(runs)]
        got = list(warc.LoserTree(lists, key=lambda c: (c["k"],)))
        assert [(c["k"], c["run"]) for c in got] == sorted((c["k"], c["run"]) for x in lists for c in x)


def vectors_of(seed=8, n=1500, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[100:160] = x[100]  # a group of equal vectors
    return x


VECTORS = "vec_id long, embedding array<float>, label int, first int, vector string, score double"


@pytest.fixture(scope="module")
def vectors(spark):
    x = vectors_of()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [float("nan")] * 16), (2200, [float("inf")] + [1.0] * 15),
             (2250, [1.0] * 15), (2300, [None] + [1.0] * 15), (None, [1.0] * 16), (0, x[0].tolist())]
    return spark.createDataFrame([(*r, 1, 2, "v", 0.5) for r in rows], VECTORS)


@pytest.mark.parametrize("block", [8192, 20])
def test_neighbours_recall_order_and_ties(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK_ENTRIES", block)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", block)
    x = vectors_of().astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    use = neighbours.usable(vectors)
    assert use.count() == 1500
    out = {}
    for r in neighbours.nearest(use, use.filter("vec_id % 50 = 0")).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(out) == set(range(0, 1500, 50))
    hits = 0
    for q, found in out.items():
        score = (x * x[q]).sum(axis=1) / (norm * norm[q])
        score[q] = -2
        best = np.lexsort((np.arange(1500), -score))[:5].tolist()
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(score[v] - s) < 1e-12 for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits / (5 * len(out)) >= 0.9
    assert [v for _, v, _ in out[100]] == [101, 102, 103, 104, 105]  # equal vectors: the smallest ids


def test_neighbours_of_few_or_no_vectors(spark):
    few = neighbours.usable(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0])], "vec_id long, embedding array<float>"))
    out = sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(few, few.filter("vec_id % 50 = 0")).collect())
    assert out == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    none = neighbours.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert neighbours.nearest(none, none).collect() == []


def test_cells_come_in_order_of_summed_distance():
    rng = np.random.default_rng(9)
    index = neighbours.MultiIndex(rng.normal(size=(7, 2)), rng.normal(size=(5, 2)))
    a, b = rng.random(7), rng.random(5)
    pairs = list(index.traverse(a, b))
    assert len(set(pairs)) == 35
    sums = [a[i] + b[j] for i, j in pairs]
    assert sums == sorted(sums)
