"""Operators 11, 12 and 13 against brute force on hard rows, and on empty tables."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cohortlens.llm import decontamination, divergence, manifest

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- 11 -------------------------------------------------------------------------------------------------------------

ITEM_SCHEMA = "item_id long, text string, wid string, h long, words string"


def bench_rows(hard):
    """Items cut out of the documents, short ones, repeats, nulls, and some that occur nowhere."""
    rng = random.Random(3)
    long = [ITEM_WORD.findall(lowered(r.text)) for r in hard.collect() if r.text and 60 < len(r.text) < 5000]
    rows = [(i, " ".join(w[k:k + 25]).upper()) for i, w in enumerate(long[:12]) for k in [rng.randint(0, 20)]]
    rows += [(100, " ".join(long[0][:9] + ["zzz"] + long[0][10:19])), (101, "one"), (102, "two, Three"), (103, "nowhere to be found"),
             (104, "日本語"), (105, ""), (106, None), (None, "same text"), (101, "one"), (7, " ".join(long[3][5:15])), (108, "!!")]
    return [(*r, "x", 1, "y") for r in rows]


def slow_contaminated(docs, items, window=10):
    windows = defaultdict(set)
    for item, text, *_ in items:
        w = ITEM_WORD.findall(lowered(text))
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[i:i + window])].add(item)
    lengths = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w = ITEM_WORD.findall(lowered(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i:i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own - {None}
        out.append((doc, len(w), len(hit), sorted(map(str, found))))
    return out


@pytest.mark.parametrize("shingle,most", [(5, 1 << 26), (5, 0), (3, 1 << 26)])
def test_decontamination_equals_brute_force(spark, hard, shingle, most):
    items = bench_rows(hard)
    got = decontamination.contaminated(hard, spark.createDataFrame(items, ITEM_SCHEMA), shingle=shingle, broadcast_bytes=most).collect()
    want = slow_contaminated([(r.doc_id, r.text) for r in hard.collect()], items)
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2], x[3])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.item_ids or []) for r in got], key=key) == sorted(want, key=key)
    assert any(x[2] for x in want) and any(x[1] and not x[2] for x in want)


def test_decontamination_of_empty_tables(spark, hard, empty):
    none = spark.createDataFrame([], ITEM_SCHEMA)
    assert decontamination.contaminated(empty, none).count() == 0
    rows = decontamination.contaminated(hard, none).collect()
    assert len(rows) == hard.count() and not any(r.n_hit for r in rows)


def test_words_of_every_ascii_character(spark):
    text = "".join(chr(c) + "Q" for c in range(1, 128)) + "É١à"
    got = spark.createDataFrame([(text,)], "text string").select(decontamination.words_of("text")).first()[0]
    assert got == ITEM_WORD.findall(lowered(text))


# --- 12 -------------------------------------------------------------------------------------------------------------

def slow_tree(leaves):
    """Root, and for each leaf the (left, right) siblings by level."""
    levels, at = [leaves], leaves
    while len(at) > 1:
        at = [sha(*at[i:i + 3]) for i in range(0, len(at), 3)]
        levels.append(at)
    paths = []
    for i in range(len(leaves)):
        own = []
        for level in levels[:-1]:
            first = i - i % 3
            own.append(("".join(level[first:i]), "".join(level[i + 1:first + 3])))
            i //= 3
        paths.append(own)
    return at[0], paths


def slow_manifest(rows):
    def leaf(r, text):
        parts = [r.doc_id, r.source, r.lang, r.n_chars, text]
        return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in parts])
    groups = defaultdict(list)
    for r in rows:
        bad = r.text
        if r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
            bad = r.text.replace("\n", "")
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), leaf(r, bad), r.doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: slow_tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, tops = slow_tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, _, own, bad, doc), path in zip(sorted(groups[s]), trees[s][1]):
            path = path + top
            fold = bad
            for left, right in path:
                fold = sha(left, fold, right)
            out.append((doc, own, trees[s][0], root, sha(*[a + b for a, b in path]), fold, fold == root))
    return out


def run_manifest(docs):
    from pyspark.sql import functions as F
    found = manifest.manifest(docs)
    found = found.withColumn("fold", manifest.folded(F.col("tampered"), F.col("path"))).withColumn(
        "proof", manifest.proof_digest(F.col("path")))
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.fold, r.fold == r.root) for r in found.collect()]


def test_manifest_equals_brute_force(spark, hard, empty):
    key = lambda x: (x[0] is None, *[str(v) for v in x])
    want = slow_manifest(hard.collect())
    assert sorted(run_manifest(hard), key=key) == sorted(want, key=key)
    assert {x[6] for x in want} == {True, False}
    one = hard.filter("doc_id = 1")  # a lone leaf: no siblings at all
    assert run_manifest(one) == slow_manifest(one.collect())
    assert run_manifest(empty) == []


def test_manifest_of_a_hot_source_and_of_many_sources(spark):
    hot = spark.range(0, 400).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "if(id < 395, 'hot', concat('s', id)) as source",
                                         "1L as n_chars")
    many = spark.range(0, 30).selectExpr("7L as doc_id", "'same' as text", "'en' as lang", "cast(id as string) as source", "4L as n_chars")
    for docs in (hot, many, many.unionByName(many)):
        assert sorted(run_manifest(docs)) == sorted(slow_manifest(docs.collect()))


# --- 13 -------------------------------------------------------------------------------------------------------------

def slow_audit(rows, least, top):
    counts, with_term = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        own = Counter(TERM.findall(lowered(r.text)))
        counts[lang, source] += own
        with_term[lang] += Counter(own.keys())
    out = []
    for lang, source in groups:
        kept = [t for t, n in with_term[lang].items() if n >= least]
        same = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in same:
            whole += counts[lang, s]

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in same}
        q = share(whole)
        pair = [(-sum(abs(p[source][t] - p[s][t]) for t in kept), s) for s in same if s != source]
        term = [(q[t] - p[source][t], t) for t in kept if counts[lang, source][t] > 0 and p[source][t] > q[t]]
        for part, found, most in (("pair", pair, None), ("term", term, top)):
            found = sorted(found, key=lambda x: (x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("least,cells,chunk,sent", [(3, 1 << 20, 1024, 1 << 20), (1, 40, 1024, 0), (2, 30, 2, 1 << 20),
                                                    (1000, 1 << 20, 1024, 1 << 20)])
def test_divergence_equals_brute_force(hard, least, cells, chunk, sent):
    found = divergence.audit(hard, least_docs=least, top_terms=5, block_cells=cells, chunk_sources=chunk, vocabulary_bytes=sent)
    got = sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == slow_audit(hard.collect(), least, 5)
    assert got


def test_shares_are_exact_for_large_counts(spark):
    rng = random.Random(5)
    rows = [(c, t) for t in (10**13 + 7, 10**15 - 11, 999_999_937, 3) for c in [0, 1, t - 5, *[rng.randint(0, max(t - 5, 0)) for _ in range(20)]] if 0 <= c <= t - 5]
    rows += [(0, 5), (5, 10)]
    from pyspark.sql import functions as F
    got = spark.createDataFrame(rows, "c long, t long").withColumn("p", divergence._share(F.col("c"), F.col("t"))).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 5) // t for c, t in rows]


def test_divergence_of_an_empty_table(empty):
    assert divergence.audit(empty).count() == 0
