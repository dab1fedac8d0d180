"""A Merkle manifest of a dataset: one tree per group of rows, and one tree over the groups' roots.

Ordered leaves lie in blocks of ``ARITY ** LEVELS``. A block is one row with an
array of digests, and ``sequence``, ``transform``, ``slice`` and ``aggregate``
collapse its levels inside that row; the roots of blocks are the leaves of the
next round, until one node is left. Coming down again, each block's path to the
root is joined with the block (one row a block, never one a leaf), so that a leaf
gets its proof inside its block's row. A group of a third of all rows is cut into
blocks like any other; positions come from ranges of the sort order and their
counts, so no group is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import crc32_sql, maybe_broadcast, unused, written

ARITY = 3
#: Levels that collapse inside one block; a block has 729 leaves.
LEVELS = 6


def serialised(c: Column) -> Column:
    """A value as ``bytes:value``, null as ``-``: no two lists of values read alike."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(serialised, values)).cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "").cast("binary"), 256)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _levels(nodes: Column, n: Column) -> Column:
    """All levels of a block, the lowest first; ``n`` nodes are in its whole tree.

    While the tree has more than one block, a block collapses all its levels, be
    it short; the only block of a tree collapses until one node is left.
    """
    count = sum((F.when(n > ARITY**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))
    runs = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / ARITY).cast("int")), lambda i: F.sha2(F.array_join(F.slice(xs, i * ARITY + 1, ARITY), "").cast("binary"), 256))
    return F.aggregate(F.slice(F.array(*map(F.lit, range(LEVELS))), F.lit(1), count), F.array(nodes), lambda acc, _: F.concat(acc, F.array(runs(F.element_at(acc, -1)))))


def _path(levels: Column, at: Column) -> Column:
    """The siblings of the block's node ``at`` (from 0) on every level but the last: digests left and right of it in its run."""

    def step(nodes: Column, j: Column) -> Column:
        own = F.floor(at / F.pow(F.lit(ARITY), j)).cast("int")
        first = own - own % ARITY
        return F.struct(F.array_join(F.slice(nodes, first + 1, own % ARITY), "").alias("left"), F.array_join(F.slice(nodes, own + 2, ARITY - 1 - own % ARITY), "").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def _blocks(nodes: DataFrame, key: str, items: list[str]) -> DataFrame:
    """One row for each block: key, block, n and the array of its items in order."""
    block = F.floor(F.col("pos") / ARITY**LEVELS).alias("block")
    return nodes.groupBy(key, block).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", *items))).alias("items"))


def _climb(nodes: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Roots (key, root) and paths (key, pos, path) of trees of nodes (key, pos, n, digest); the largest has ``most`` nodes."""
    if most <= 1:
        return nodes.select(key, F.col("digest").alias("root")), nodes.select(key, "pos", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    blocks = written(_blocks(nodes, key, ["digest"]), "merkle-blocks")
    roots, above = _climb(_roots(blocks, key, "digest"), key, -(-most // ARITY**LEVELS))
    joined = blocks.join(above.select(key, F.col("pos").alias("block"), F.col("path").alias("above")), [key, "block"])
    inside = _let(_levels(F.col("items.digest"), F.col("n")), lambda levels: F.transform("items", lambda x, p: F.struct(x["pos"].alias("pos"), F.concat(_path(levels, p), F.col("above")).alias("path"))))
    return roots, joined.select(key, F.inline(inside))


def _roots(blocks: DataFrame, key: str, digest: str) -> DataFrame:
    """The roots of blocks as nodes of the next round."""
    top = F.element_at(F.element_at(_levels(F.col(f"items.{digest}"), F.col("n")), -1), 1)
    return blocks.select(key, F.col("block").alias("pos"), F.ceil(F.col("n") / ARITY**LEVELS).alias("n"), top.alias("digest"))


def positions(df: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``pos`` (from 0, within the key by ``order``, nulls first) and ``n`` (rows of the key); and the largest n.

    Rows are dealt to ranges of the sort order and written; a row's position is its
    place in its range plus the rows of its key in the ranges before.
    """
    dealt = written(df.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    w = Window.partitionBy(key)
    counts = dealt.groupBy(key, "part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.select(key, "part", before.alias("before"), F.sum("c").over(w).alias("n")), "merkle-counts")
    n_counts, most = counts.agg(F.count("*"), F.max("n")).first()
    place = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order))
    joined = dealt.withColumn("pos", place).join(maybe_broadcast(counts, n_counts, 200), [key, "part"])
    return joined.withColumn("pos", F.col("pos") - 1 + F.col("before")).drop("part", "before"), most or 0


def manifest(docs: DataFrame, leaf: Column, group: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: the group and order columns, ``leaf``, ``subroot``, ``root``, ``path`` and the columns of ``keep``.

    ``leaf`` is the digest of a row (``leaf_digest``). Leaves of a group ascend by
    ``order``; every three neighbours (the last run may be shorter) become their
    digest, level by level, until one is left: the subroot. Subroots by group, the
    null one first, give the root in the same way. ``path`` has the siblings left and right for each level
    up to the root: ``folded`` recomputes the root from it, ``proof_digest`` digests it.

    Null groups are one group, before all others; null orders come first. Rows of one
    order value are sorted by their leaf, so that repeated rows get proofs of their own.
    A lone row is its group's subroot, with no siblings there. Very long texts cost one
    digest; an empty table gives an empty result. Columns that aren't named are not
    passed on; a name that meets an added one is a ValueError.
    """
    keep = keep or {}
    if {group, order, *keep} & {"leaf", "subroot", "root", "path"} or {group, order} & {*keep}:
        raise ValueError("a kept column has the name of an added one")
    key, o = unused([*keep, "pos", "n", "part", "c", "before", "leaf"], "group_key", "order_value")
    # null first, then by UTF-8 bytes; never null, so that plain equality joins it
    text = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(text.alias(key), F.col(order).alias(o), leaf.alias("leaf"), *[c.alias(f"k_{k}") for k, c in enumerate(keep.values())])
    kept = [f"k_{k}" for k in range(len(keep))]
    placed, most = positions(leaves, key, [o, "leaf"])
    blocks = written(_blocks(placed, key, [o, "leaf", *kept]), "merkle-leaves")
    roots, above = _climb(_roots(blocks, key, "leaf"), key, -(-most // ARITY**LEVELS))
    subroots = written(roots.select(F.lit(0).alias("all"), F.col(key), F.col("root").alias("subroot")), "merkle-subroots")
    tops, n_groups = positions(subroots, "all", [key])
    tops = written(tops, "merkle-tops")
    root, over = _climb(tops.withColumnRenamed("subroot", "digest"), "all", n_groups)
    tops = tops.join(over, ["all", "pos"]).join(F.broadcast(root), "all")  # root: one row
    tops = maybe_broadcast(tops.select(key, "subroot", "root", F.col("path").alias("over")), n_groups, 4096)
    above = above.join(tops, key).select(key, F.col("pos").alias("block"), "subroot", "root", F.concat("path", "over").alias("above"))
    inside = _let(
        _levels(F.col("items.leaf"), F.col("n")),
        lambda levels: F.transform("items", lambda x, p: F.struct(*[x[c].alias(c) for c in (o, "leaf", *kept)], F.concat(_path(levels, p), F.col("above")).alias("path"))),
    )
    rows = blocks.join(above, [key, "block"]).select(key, "subroot", "root", F.inline(inside))
    source = F.when(F.col(key) != "", F.expr(f"substring(`{key}`, 2)")).cast(docs.schema[group].dataType)
    return rows.select(F.col(o).alias(order), source.alias(group), "leaf", "subroot", "root", "path", *[F.col(c).alias(name) for c, name in zip(kept, keep)])


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    A text loses its line feeds where 2 divides the crc32 of the id; such a document's root is folded from its
    changed leaf and the original siblings, every other one's from its own leaf. A null id changes nothing.
    """
    whole = [F.col(c) for c in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(hit, leaf_digest(*whole[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    found = manifest(docs, leaf_digest(*whole), keep={"changed": changed})
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in (*FIELDS[:-1], text)) + ")"


#: The same trees as recursive SQL: one level a step, then one step up a leaf's path.
ORACLE = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf_sql("text")} AS leaf,
  CASE WHEN {crc32_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: unicode(c))")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS given FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM docs),
trees AS (SELECT g, 0 AS lvl, i, n, leaf AS h FROM leaves
  UNION ALL SELECT g, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM trees WHERE n > 1 GROUP BY g, lvl, i // 3, n),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS gi, count(*) OVER () AS n FROM trees WHERE n = 1),
top AS (SELECT 0 AS lvl, gi AS i, n, subroot AS h FROM subroots
  UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 3, n),
nodes AS (SELECT g, lvl, i, n, h FROM trees UNION ALL SELECT NULL, lvl, i, n, h FROM top),
steps AS (SELECT a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM nodes a JOIN nodes b ON a.g IS NOT DISTINCT FROM b.g AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
walk AS (SELECT doc_id, leaf, g, g AS at, 0 AS lvl, i, given AS h, '' AS proof FROM leaves
  UNION ALL (SELECT w.doc_id, w.leaf, w.g, CASE WHEN s.lvl IS NULL THEN NULL ELSE w.at END, CASE WHEN s.lvl IS NULL THEN 0 ELSE w.lvl + 1 END, CASE WHEN s.lvl IS NULL THEN u.gi ELSE w.i // 3 END,
    CASE WHEN s.lvl IS NULL THEN w.h ELSE sha256(s.l || w.h || s.r) END, w.proof || coalesce(s.l || s.r, '')
    FROM walk w JOIN subroots u ON u.g = w.g LEFT JOIN steps s ON s.g IS NOT DISTINCT FROM w.at AND s.lvl = w.lvl AND s.i = w.i WHERE s.lvl IS NOT NULL OR w.at IS NOT NULL))
SELECT w.doc_id, w.leaf, u.subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM walk w JOIN subroots u USING (g), (SELECT h, lvl FROM top WHERE n = 1) t WHERE w.at IS NULL AND w.lvl = t.lvl
"""
