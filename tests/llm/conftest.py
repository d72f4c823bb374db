"""Rows that are hard on purpose, shared by the operators' tests."""
import random

import pytest

from cohortlens.llm import common

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size long, shard int, fp long, spans string, lanes string, g string, salt int, `group` string, first int, "
          "_id long, _n int, _runs string, _nth int, _spans string, _uid long, row string, uid int, nth int, id int, n int, runs int, turn int")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def hard_rows():
    """Nulls, empty and very long texts, white space of all kinds, copies, near copies, shared passages, other scripts."""
    rng = random.Random(7)
    passage = words(rng, 70)
    texts = [None, "", " \t\n", "one", "one two", "One TWO", "one\x0btwo three", "É à ß ñ", "12 34 !!", "日本語 テキスト",
             words(rng, 49), words(rng, 50), words(rng, 51), words(rng, 30_000), passage, passage.upper()]
    texts += [words(rng, 20) + " " + passage + "\n" + words(rng, 30) for _ in range(6)]
    texts += [words(rng, 80) for _ in range(20)]
    base = words(rng, 200)
    texts += [base, base, base, base + " tail", "head " + base, base.replace(" ", "\n", 3)] + ["same text"] * 25
    langs = ["en", "de", None]
    rows = [(i * 3 - 5, t, langs[i % 3], ["a", "b", None, "Z"][i % 4]) for i, t in enumerate(texts)]
    rows += [(10_000, base, "en", "a")] * 2 + [(None, "one two", None, None), (None, None, "en", "a")]
    return [(*r, len(r[1] or ""), 1, 2, 3, "s", "l", "g", 4, "x", 5, 1, 2, "r", 3, "s", 4, "w", 5, 6, 7, 8, 9, 10) for r in rows]


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import get_spark
    s = get_spark("local[4]", 6)
    common.prepare(s)
    return s


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def twins(spark):
    """Ids with two texts, one of them a copy, a near copy or clean; (id, text) rows with the columns of the others."""
    rng = random.Random(11)
    a, b, c = (words(rng, 80) for _ in range(3))
    long = words(rng, 900)
    rows = [(1, a), (2, a), (2, b), (3, b + " " + c), (3, c), (4, None), (4, c), (5, long), (6, long + " tail"), (6, c), (6, long + " tail")]
    return spark.createDataFrame([(i, t, "en", "a", len(t or ""), 1, 2, 3, "s", "l", "g", 4, "x", 5, 1, 2, "r", 3, "s", 4, "w", 5, 6, 7, 8, 9, 10)
                                  for i, t in rows], SCHEMA).repartition(2).cache()
