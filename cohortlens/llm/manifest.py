"""Merkle manifest of a table by nested-interval labels.

Every row is a leaf.  The leaves of a source are ranked, and a node carries the
interval [lo, hi) of the leaf ranks that it covers: level k covers 3^k ranks, the
last node of a level what is left.  The sources' roots are, in turn, the leaves of
the top tree.

Up: a level's nodes are grouped by their parent's bucket (lo div 3^(k+1)); the
digest of a parent is that of its children's, left to right.
Down: a node joins its parent in the parent's bucket, where the parent's interval
contains its own; the parent's other children, those whose intervals lie to the
left and to the right, are its siblings, and its path is theirs and the parent's
path.  A path is made once per node, so all levels above the leaves together move
half as many rows as there are leaves.
A proof is the digest of a path, and folding a leaf along its path gives the root.

Ranks: the leaf table (digests, no texts) is dealt to ranges of (source, id, digest,
row), so a hot source lies in many of them; a rank is the row number in the range
plus the rows of the source in the ranges before.

Defined results: nulls are hashed as ``-``; ids that repeat are ordered by their
leaf digests, null ids come first and are never tampered with; equal rows are
leaves of their own.  A null source and an empty one are two sources.  An empty
table gives no rows.  Columns other than those of ``COLUMNS`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, read_table
from .registry import register

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """The digest of a row's columns, each with its length; ``text`` in the text's place if given."""
    return digest(*[_field(text if text is not None and c == "text" else F.col(c)) for c in COLUMNS])


def tampered_text(doc_id: Column, text: Column) -> Column:
    """Line breaks are deleted from the texts of ids with an even CRC-32."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)


def _tree_of(source: Column) -> Column:
    """A name that orders like the source, null first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``lo``, the rank from 0 in its ``tree`` by ``order``, and ``size``, the tree's rows.

    Rows are dealt to ranges and written once; then a window holds one range of one tree only.
    """
    partitions = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), f"{name}-rows")
    dealt = rows.repartitionByRange(partitions, "tree", *order, "row").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, f"{name}-ranges")
    counts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    line = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("tree").alias("_tree"), F.col("part").alias("_part"),
                           F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"),
                           F.sum("n").over(W.partitionBy("tree")).alias("size"))
    nth = F.row_number().over(W.partitionBy("tree", "part").orderBy(*order, "row")) - 1
    return (dealt.withColumn("nth", nth).join(counts, (F.col("tree") == F.col("_tree")) & (F.col("part") == F.col("_part")))
            .withColumn("lo", (F.col("before") + F.col("nth")).cast("long"))
            .drop("_tree", "_part", "part", "row", "before", "nth"))


def _step(level: int) -> int:
    return FANOUT ** level


def grow(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The levels of all trees, leaves (tree, size, lo, hi, digest) first; roots are the nodes that cover a whole tree.

    Levels above the leaves also carry ``children``, their intervals and digests in order.
    """
    tallest = leaves.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    levels, level = [leaves], 0
    while _step(level) < tallest:
        level += 1
        child = F.struct("lo", "hi", "digest")
        up = (levels[-1].filter((F.col("lo") > 0) | (F.col("hi") < F.col("size")))
              .withColumn("bucket", F.floor(F.col("lo") / F.lit(_step(level)))).groupBy("tree", "size", "bucket")
              .agg(F.sort_array(F.collect_list(child)).alias("children"))  # at most FANOUT
              .select("tree", "size", F.element_at("children", 1)["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"),
                      digest(F.array_join(F.transform("children", lambda c: c["digest"]), "")).alias("digest"), "children"))
        levels.append(materialize(up, f"{name}-level"))
    return levels


def _siblings(side: str) -> Column:
    outside = (lambda c: c["hi"] <= F.col("lo")) if side == "left" else (lambda c: c["lo"] >= F.col("hi"))
    return F.array_join(F.transform(F.filter("p_children", outside), lambda c: c["digest"]), "")


def paths(levels: list[DataFrame], roots: DataFrame, name: str) -> DataFrame:
    """The leaves with ``path``: (left, right) digests of the siblings at each level, from the leaf up.

    ``roots`` (tree, path, above...) is what a tree's root has; the other columns are handed down.
    Small trees' roots lie on low levels, so each level takes its roots from there.
    """
    extra = [c for c in roots.columns if c not in ("tree", "path")]
    done = None
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level]
        whole = (F.col("lo") == 0) & (F.col("hi") == F.col("size"))
        found = nodes.filter(whole).join(roots, "tree")
        if done is not None:
            parents = done.select(F.col("tree").alias("p_tree"), F.floor(F.col("lo") / F.lit(_step(level + 1))).alias("p_bucket"),
                                  F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("children").alias("p_children"),
                                  F.col("path").alias("p_path"), *extra)
            bucket = F.floor(F.col("lo") / F.lit(_step(level + 1)))
            inside = (F.col("tree") == F.col("p_tree")) & (bucket == F.col("p_bucket")) \
                & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
            own = F.struct(_siblings("left").alias("left"), _siblings("right").alias("right"))
            below = nodes.filter(~whole).join(parents, inside).withColumn("path", F.concat(F.array(own), F.col("p_path")))
            found = found.select(*nodes.columns, "path", *extra).unionByName(below.select(*nodes.columns, "path", *extra))
        done = found if level == 0 else materialize(found, f"{name}-paths")
    return done


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, path): one row per row of ``docs``, with the path of sibling digests."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _tree_of(F.col("source")).alias("tree"), leaf_digest().alias("digest"),
        leaf_digest(tampered_text(F.col("doc_id"), F.col("text"))).alias("tampered"))
    leaves = materialize(ranked(rows, ["doc_id", "digest"], "manifest-leaves").withColumn("hi", F.col("lo") + 1), "manifest-leaves")
    levels = grow(leaves, "manifest")
    subroots = None
    for nodes in levels:
        own = nodes.filter((F.col("lo") == 0) & (F.col("hi") == F.col("size"))).select("tree", "digest")
        subroots = own if subroots is None else subroots.unionByName(own)
    # The top tree: the sources in order are its leaves.
    tops = ranked(subroots.select(F.lit("top").alias("tree"), F.col("tree").alias("own"), "digest"), ["own"], "manifest-sources")
    tops = materialize(tops.withColumn("hi", F.col("lo") + 1), "manifest-sources")
    top_levels = grow(tops, "manifest-top")
    root = top_levels[-1].filter((F.col("lo") == 0) & (F.col("hi") == F.col("size"))).select(F.col("digest").alias("root"))
    empty_path = F.array().cast("array<struct<left:string,right:string>>")
    root = root.select(F.lit("top").alias("tree"), empty_path.alias("path"), "root")
    roots = paths(top_levels, root, "manifest-top").select(F.col("own").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    found = paths(levels, materialize(roots, "manifest-roots"), "manifest")
    return found.select("doc_id", F.col("digest").alias("leaf"), "tampered", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, p: digest(p["left"], acc, p["right"]))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *,
  CASE WHEN doc_id IS NOT NULL AND even THEN replace(text, chr(10), '') ELSE text END AS bad
  FROM (SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1),
    lambda k: ascii(substr(doc_id::VARCHAR, k::BIGINT, 1))::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) % 2 = 1 AS even FROM documents)),
f AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d),
l AS (SELECT r, doc_id, coalesce('=' || source, '-') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(bad) || ':' || bad, '-')) AS bad FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i,
  count(*) OVER (PARTITION BY tree) AS n FROM l),
nodes AS (SELECT tree, 0 AS lvl, i AS j, n, leaf AS h FROM k UNION ALL
  SELECT tree, lvl + 1, j // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY j)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, j // 3, n),
tops AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS j, count(*) OVER () AS n FROM nodes WHERE n = 1),
up AS (SELECT 0 AS lvl, j, n, h FROM tops UNION ALL
  SELECT lvl + 1, j // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY j)) FROM up WHERE n > 1 GROUP BY lvl, j // 3, n),
rt AS (SELECT h AS root FROM up WHERE n = 1),
lv AS (SELECT DISTINCT tree, lvl FROM nodes WHERE n > 1),
pw AS (SELECT s AS lvl, (3 ** s)::BIGINT AS w FROM range(0, 40) t(s)),
steps AS (
  SELECT k.r, lv.lvl AS step, coalesce(string_agg(s.h, '' ORDER BY s.j) FILTER (s.j < k.i // w), '') AS lft,
    coalesce(string_agg(s.h, '' ORDER BY s.j) FILTER (s.j > k.i // w), '') AS rgt
  FROM k JOIN lv USING (tree) JOIN pw USING (lvl)
    JOIN nodes s ON s.tree = k.tree AND s.lvl = lv.lvl AND s.j // 3 = k.i // w // 3 GROUP BY k.r, lv.lvl
  UNION ALL
  SELECT k.r, 100 + a.lvl, coalesce(string_agg(s.h, '' ORDER BY s.j) FILTER (s.j < t.j // w), ''),
    coalesce(string_agg(s.h, '' ORDER BY s.j) FILTER (s.j > t.j // w), '')
  FROM k JOIN tops t USING (tree) JOIN (SELECT DISTINCT lvl FROM up WHERE n > 1) a ON true JOIN pw USING (lvl)
    JOIN up s ON s.lvl = a.lvl AND s.j // 3 = t.j // w // 3 GROUP BY k.r, a.lvl),
seq AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY step) AS nth FROM steps),
fold AS (SELECT r, 0 AS nth, bad AS h FROM k UNION ALL
  SELECT seq.r, seq.nth, sha256(lft || fold.h || rgt) FROM fold JOIN seq ON seq.r = fold.r AND seq.nth = fold.nth + 1),
ends AS (SELECT r, arg_max(h, nth) AS folded_root FROM fold GROUP BY r),
proofs AS (SELECT r, sha256(string_agg(lft || rgt, '' ORDER BY step)) AS p FROM steps GROUP BY r)
SELECT doc_id, leaf, tops.h AS subroot, root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM k JOIN tops USING (tree) JOIN ends USING (r) LEFT JOIN proofs USING (r) CROSS JOIN rt"""


@register("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: every document's leaf, the roots above it, its proof, and the root folded from the tampered leaf."""
    found = manifest(read_table(spark, sf_dir, "documents")).withColumn("folded_root", folded(F.col("tampered"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
