"""Merkle manifest of a dataset: a tree for each source, and one over the sources.

Leaves ascend by id. While a tree has several nodes on a level, each run of three
(the last one may be shorter) becomes the SHA-256 of its digests as hex text, one
after the other. What is stored is that text, the preimage, once for each parent.
A leaf joins the preimages of its ancestors: its own 64 characters cut out leave
the siblings that prove it, and another digest spliced into the same place folds
up to the root that this other leaf would have.

Four levels are built at a time: the 81 nodes below one ancestor meet in one group,
so a tree of a billion leaves takes five rounds, each over 81 times fewer rows, and
a leaf meets its whole path in one join. Positions come from a range sort with the
counts of its runs, so no source is ranked in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Children of a node, levels that one group builds, and the nodes below it.
FAN, DEPTH = 3, 4
BLOCK = FAN**DEPTH
#: Characters of a digest.
DIGEST = 64


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values one after the other: ``-`` if null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = (v.cast("string") for v in values)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _sorted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows in order of ``keys`` (null first), written, with ``row`` that ascends in each ``part``."""
    order = [F.col(k).asc_nulls_first() for k in keys]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    return written(table, "sorted").withColumn("part", F.shiftright("row", 33))


def _runs(table: DataFrame, group: str) -> DataFrame:
    """(part, group, first, before, n): the first row of a group in a part, the group's rows before and in all."""
    counts = table.groupBy("part", group).agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(group)
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("part", group, "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))


def _pos() -> Column:
    return (F.col("row") - F.col("first") + F.col("before")).alias("pos")


@dataclass
class Tree:
    """Trees over (tree, pos, n, digest): their blocks, from the leaves up, and the digest of each tree's top."""

    blocks: list[DataFrame]
    tops: DataFrame


def _grow(nodes: DataFrame) -> Tree:
    most = nodes.agg(F.max("n")).first()[0] or 1
    blocks: list[DataFrame] = []
    while most > 1:
        table = nodes.groupBy("tree", "n", F.expr(f"pos div {BLOCK}").alias("block"))
        table = table.agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).getField("digest").alias("below"))
        for level in range(DEPTH):
            run = lambda i: F.array_join(F.slice("below", i * FAN + 1, FAN), "")
            runs = F.transform(F.sequence(F.lit(0), F.expr(f"(size(below) - 1) div {FAN}").cast("int")), run)
            grows = F.col("n") > FAN**level
            table = table.withColumn(f"p{level}", F.when(grows, runs).otherwise(F.array().cast("array<string>")))
            table = table.withColumn("below", F.when(grows, F.transform(f"p{level}", lambda p: F.sha2(p, 256))).otherwise(F.col("below")))
        preimages = F.array(*(f"p{level}" for level in range(DEPTH))).alias("preimages")
        blocks.append(written(table.select("tree", "n", "block", preimages, F.col("below")[0].alias("digest")), "merkle-blocks"))
        most = -(-most // BLOCK)
        nodes = blocks[-1].select("tree", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), "digest")
    return Tree(blocks, nodes.select("tree", "digest"))


def _own_path(pos: str) -> Column:
    """(slot, preimage) of the levels that a block builds over its child at ``pos``."""
    child = f"({pos} % {BLOCK})"
    steps = [f"array(named_struct('slot', cast({child} div {FAN**k} % {FAN} as int), 'preimage', get(preimages[{k}], cast({child} div {FAN ** (k + 1)} as int))))" for k in range(DEPTH)]
    return F.expr(f"filter(concat({', '.join(steps)}), s -> s.preimage IS NOT NULL)")


def _under(tree: Tree, above: DataFrame) -> DataFrame | None:
    """The lowest blocks, each with the path above it and what ``above`` has for its tree; None if a tree is its only leaf."""
    kept = [c for c in above.columns if c not in ("tree", "path")]
    reached = None
    for table in reversed(tree.blocks):
        table = table.select("tree", "block", "preimages")
        if reached is None:
            reached = table.join(above, "tree")
        else:
            upper = reached.withColumnRenamed("block", "upper")
            lower = table.withColumnsRenamed({"preimages": "own"}).withColumn("upper", F.expr(f"block div {BLOCK}"))
            path = F.concat(_own_path("block"), "path").alias("path")
            reached = lower.join(upper, ["tree", "upper"]).select("tree", "block", F.col("own").alias("preimages"), path, *kept)
    return reached


def _paths(rows: DataFrame, tree: Tree, above: DataFrame) -> DataFrame:
    """``rows`` (with tree and pos) with the path from each to the top, and what ``above`` has for its tree."""
    lowest = _under(tree, above)
    if lowest is None:
        return rows.join(above, "tree")
    kept = [c for c in above.columns if c not in ("tree", "path")]
    met = rows.withColumn("block", F.expr(f"pos div {BLOCK}")).join(lowest, ["tree", "block"])
    return met.select(*rows.columns, F.concat(_own_path("pos"), "path").alias("path"), *kept)


def prove(leaves: DataFrame) -> DataFrame:
    """The rows of ``leaves`` (source, id, leaf, and any others) with ``subroot``, ``root`` and ``path``.

    ``path`` is an array of (slot, preimage) from the leaf's parent to the root:
    the digests of a parent's children as one text, and the place of the own one
    among them. In each source leaves ascend by id, null first, those of one id
    by digest; equal rows are each a leaf of its own. Sources ascend by their
    bytes, null (a source too) first. A source with one leaf has that leaf as its
    subroot; a dataset with one source has its subroot as the root; a lone leaf
    has an empty path. No rows give no rows. Of one further column for each name
    that is used inside (``row``, ``part``, ``first``, ``before``, ``n``,
    ``tree``, ``pos``, ``block``) there must be none.
    """
    table = _sorted(leaves, ["source", "id", "leaf"])
    runs = _runs(table, "source")
    sources = _sorted(runs.select("source").distinct().withColumn("all", F.lit(0)), ["source"])
    places = _runs(sources, "all")
    ids = sources.join(places, ["part", "all"]).select("source", _pos().alias("tree"), F.col("n").alias("trees"))
    told = runs.join(ids.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("part").alias("p"), "s", "first", "before", "n", "tree")
    placed = table.join(told, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    placed = written(placed.select(*leaves.columns, "tree", _pos(), "n"), "merkle-leaves")

    trees = _grow(placed.select("tree", "pos", "n", F.col("leaf").alias("digest")))
    tops = written(trees.tops.join(ids.select("tree", F.col("trees").alias("n")), "tree"), "merkle-tops")
    over = _grow(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("pos"), "n", "digest"))
    none = F.array().cast("array<struct<slot:int,preimage:string>>").alias("path")
    crown = over.tops.select("tree", F.col("digest").alias("root"), none)
    sources_up = _paths(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("pos"), F.col("digest").alias("subroot")), over, crown)
    above = sources_up.select(F.col("pos").alias("tree"), "subroot", "root", "path")
    return _paths(placed.drop("n"), trees, above).select(*leaves.columns, "subroot", "root", "path")


_LEFT, _RIGHT = f"left(s.preimage, {DIGEST} * s.slot)", f"substring(s.preimage, {DIGEST} * s.slot + {DIGEST + 1})"


def siblings(path: str = "path") -> Column:
    """The digests that prove a leaf, level by level and left to right, as one text."""
    return F.expr(f"array_join(transform({path}, s -> concat({_LEFT}, {_RIGHT})), '')")


def fold(leaf: str, path: str = "path") -> Column:
    """The root that follows from another leaf in the place of the one that ``path`` belongs to."""
    return F.expr(f"aggregate({path}, {leaf}, (below, s) -> sha2(concat({_LEFT}, below, {_RIGHT}), 256))")


_CRC = "list_reduce([ascii(b) for b in string_split(doc_id::VARCHAR, '')], lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b::BIGINT)), 4294967295::BIGINT)"
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree_sql(name: str) -> str:
    """All nodes above those of ``name`` (tree, pos, n, h), with their level."""
    return f"""{name}_up AS (SELECT tree, 0 AS level, pos, n, h FROM {name} UNION ALL
  SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name}_up WHERE n > 1 GROUP BY tree, level, pos // 3, n)"""


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, xor({_CRC}, 4294967295) % 2 = 0 AS hit, {_leaf_sql("replace(text, chr(10), '')")} AS other FROM documents),
place AS (SELECT *, row_number() OVER () AS k, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS h FROM d),
{_tree_sql("place")},
tops AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM place_up WHERE n = 1),
{_tree_sql("tops")},
nodes AS (SELECT tree, pos, level, h FROM place_up WHERE n > 1 UNION ALL SELECT -1, pos, level, h FROM tops_up WHERE n > 1),
sides AS (SELECT tree, pos, level, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WINDOW w AS (PARTITION BY tree, level, pos // 3 ORDER BY pos)),
steps AS (SELECT k, FALSE AS over, level, l, r FROM place p JOIN sides s ON s.tree = p.tree AND s.pos = p.pos // pow(3, level)::BIGINT UNION ALL SELECT k, TRUE, level, l, r FROM place p JOIN sides s ON s.tree = -1 AND s.pos = p.tree // pow(3, level)::BIGINT),
ways AS (SELECT k, list({{'l': l, 'r': r, 'a': ''}} ORDER BY over, level) AS way FROM steps GROUP BY k),
folded AS (SELECT p.*, coalesce(list_aggregate(list_transform(way, lambda s: s.l || s.r), 'string_agg', ''), '') AS sib,
  list_reduce(coalesce(way, []), lambda a, s: {{'l': '', 'r': '', 'a': sha256(s.l || a.a || s.r)}}, {{'l': '', 'r': '', 'a': CASE WHEN hit THEN other ELSE leaf END}}).a AS up FROM place p LEFT JOIN ways USING (k))
SELECT doc_id, leaf, t.h AS subroot, o.h AS root, sha256(sib) AS proof_sha256, up AS folded_root, up = o.h AS verified FROM folded f JOIN place_up t ON t.tree = f.tree AND t.n = 1 JOIN tops_up o ON o.n = 1
"""
