"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two that differ in at most three bits
share at least ``8 - 3 = 5`` of them. Posting lists of single bytes would pair
one in 256 of all fingerprints, so a list's key is three positional bytes: of
any five positions out of eight at least one of the eight triples below is a
part (TRIPLES covers all 5-sets). Within a list, the shared positional bytes of
each pair are tallied, pairs below the guaranteed five are passed over, and the
rest is verified on its bits. Lists yield the links of a spanning forest, never
all pairs: components need no more, and no two fingerprints that are connected
by links of one list are left apart.

A list longer than ``LIST`` goes on to lists of five positional bytes, which
any linked pair shares. Their members differ in three bytes only, so such a
list has at most 2**24 members of 3 bytes, whatever the corpus; a longer one
looks up each member's 2,324 neighbours in a bitmap and doesn't compare pairs.

``nearest_similar`` is the same index for similar texts, whose fingerprints differ
in more bits than five shared bytes allow for: keys are two positional bytes, the
tally must reach two, and up to ``WIDE_BITS`` bits may differ. It finds most pairs,
not all of them: its callers check pairs exactly and find the rest another way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import passing, small_batches, text_or_empty, unused, written
from panelforge.llm.components import components

#: Fingerprints with at most so many differing bits are linked.
MAX_BITS = 3
SHARED = 8 - MAX_BITS
#: Every set of five positions out of eight contains one of these.
TRIPLES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (4, 5, 6), (4, 5, 7), (4, 6, 7), (5, 6, 7))
FIVES = tuple(combinations(range(8), SHARED))
#: Members of a three-byte list that are compared there; longer lists are split by five bytes.
LIST = 2048
#: Members of a five-byte list from which neighbours are looked up instead of compared.
LOOKUP = 8192
#: The index of similar texts: lists of two positional bytes, and bits in which their members may differ.
TWOS = tuple(combinations(range(8), 2))
WIDE_BITS = 12
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str, words_per_shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 without words."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = min(words_per_shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], 42) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def simhashes(texts: pa.Array, words_per_shingle: int = 3) -> np.ndarray:
    """The fingerprints of a column of texts as signed longs."""
    return np.array([simhash(t, words_per_shingle) for t in texts.to_pylist()], np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, text_col: str = "text", fp_col: str = "fp") -> DataFrame:
    """Adds ``fp``, the fingerprint as a signed long, to every row and drops the text. Null texts count as empty."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (fp_col, text_col)]
    (own,) = unused(docs.columns, "own_text")
    source = docs.select(*keep, text_or_empty(text_col).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(simhashes(b.column(own)), pa.int64())], names=[*keep, fp_col])

    return source.mapInArrow(run, docs.select(*keep).schema.add(fp_col, "long"))


def _key(fp: Column, positions: tuple[int, ...]) -> Column:
    """The bytes at these positions, others 0, as a long."""
    mask = sum(0xFF << 8 * p for p in positions)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of one list's members: breadth first over what is not reached yet."""
    left, links = np.sort(fps.astype(np.int64)), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            apart = left ^ x
            shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = shared >= SHARED
            near[near] = np.bitwise_count(apart[near].view(np.uint64)) <= MAX_BITS
            if near.any():
                links += [(int(x), int(y)) for y in left[near]]
                front += left[near].tolist()
                left = left[~near]
    return links


def forest_by_lookup(fps: np.ndarray, free: tuple[int, ...]) -> list[tuple[int, int]]:
    """The same for a list whose members differ in the three bytes ``free`` only: neighbours are looked up in a bitmap."""
    fps = np.sort(fps.astype(np.int64))
    short = sum(((fps >> 8 * p) & 0xFF) << 8 * k for k, p in enumerate(free)).astype(np.int64)
    place = np.full(1 << 8 * len(free), -1, np.int32)
    place[short] = np.arange(len(fps), dtype=np.int32)
    masks = [sum(1 << b for b in bits) for n in range(1, MAX_BITS + 1) for bits in combinations(range(8 * len(free)), n)]
    root, before = np.arange(len(fps), dtype=np.int64), None
    while before is None or (root != before).any():
        before = root.copy()
        for mask in masks:  # each member takes the smallest root of its neighbours
            there = place[short ^ mask]
            np.minimum(root, np.where(there >= 0, root[there], root), out=root)
        root = root[root]
    return [(int(fps[i]), int(fps[root[i]])) for i in np.flatnonzero(root != np.arange(len(fps)))]


def near_links(fps: DataFrame, fp_col: str = "fp") -> DataFrame:
    """a, b: links between different fingerprints whose components are those of all links of at most three bits.

    fps: distinct fingerprints. Links of lists are spanning forests, so a
    component of m fingerprints has at most 8 (m - 1) of them.
    """
    fp = F.col(fp_col)
    posts = fps.select(fp.alias("fp"), F.explode(F.array(*[F.struct(F.lit(k).alias("list"), _key(fp, t).alias("key")) for k, t in enumerate(TRIPLES)])).alias("p")).select("fp", "p.list", "p.key")
    sizes = posts.groupBy("list", "key").agg(F.count("*").alias("n"))
    short = posts.join(sizes.where(F.col("n").between(2, LIST)).drop("n"), ["list", "key"])
    links = short.groupBy("list", "key").agg(F.collect_list("fp").alias("fps")).select(_forest_udf()(F.col("fps")).alias("l"))
    hot = posts.join(sizes.where(F.col("n") > LIST).drop("n"), ["list", "key"])
    fives = hot.select("fp").distinct().select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("list"), _key(F.col("fp"), t).alias("key")) for k, t in enumerate(FIVES)])).alias("p")).select("fp", "p.list", "p.key")
    # a list of five bytes has at most 2**24 members: the group is bounded by the key, not by a cap
    split = fives.groupBy("list", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select(_forest_udf(True)(F.col("fps"), F.col("list")).alias("l"))
    return links.unionByName(split).select(F.explode("l").alias("l")).select("l.a", "l.b")


def _forest_udf(by_lookup: bool = False):
    kind = "array<struct<a: long, b: long>>"
    if not by_lookup:

        @F.pandas_udf(kind)
        def one(lists: pd.Series) -> pd.Series:
            return pd.Series([[{"a": a, "b": b} for a, b in forest(np.asarray(x))] for x in lists], dtype=object)

        return one

    @F.pandas_udf(kind)
    def two(lists: pd.Series, which: pd.Series) -> pd.Series:
        out = []
        for x, k in zip(lists, which):
            free = tuple(p for p in range(8) if p not in FIVES[k])
            out.append([{"a": a, "b": b} for a, b in (forest(np.asarray(x)) if len(x) < LOOKUP else forest_by_lookup(np.asarray(x), free))])
        return pd.Series(out, dtype=object)

    return two


_POST = ("key", "node", "fp", "size")


def _nearest(rows: dict[str, np.ndarray], t: float, at_once: int) -> Iterator[pa.RecordBatch]:
    """Of whole posting lists that are sorted by key and fingerprint: each member's nearest one of the ``LIST`` before it."""
    n = len(rows["key"])
    new = np.concatenate(([True], rows["key"][1:] != rows["key"][:-1]))
    earlier = np.minimum(np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0)), LIST)
    number = np.full((8, 8), -1)
    number[tuple(zip(*TWOS))] = np.arange(len(TWOS))
    asking = np.flatnonzero(earlier)
    at, upto = 0, np.cumsum(earlier[asking])
    while at < len(asking):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, "right")))
        some = asking[at:end]
        at = end
        a = np.repeat(some, earlier[some])
        b = a - 1 - (np.arange(len(a)) - np.repeat(np.cumsum(earlier[some]) - earlier[some], earlier[some]))
        apart = rows["fp"][a] ^ rows["fp"][b]
        bits = np.bitwise_count(apart.view(np.uint64))
        sa, sb = rows["size"][a], rows["size"][b]
        ok = np.flatnonzero((bits <= WIDE_BITS) & (np.minimum(sa, sb) >= t * np.maximum(sa, sb) - 1e-9))
        # a pair with a tally of two or more counts in the list of its first two shared positions only
        shared = apart[ok].view(np.uint8).reshape(-1, 8) == 0
        tally = np.cumsum(shared, axis=1)
        ok = ok[(tally[:, -1] >= 2) & (number[(tally == 1).argmax(1), (tally == 2).argmax(1)] == rows["key"][a[ok]] >> 16)]
        a, b, bits = a[ok], b[ok], bits[ok]
        order = np.lexsort((rows["node"][b], bits, a))
        a, b, bits = a[order], b[order], bits[order]
        head = np.concatenate(([True], a[1:] != a[:-1]))[: len(a)]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(rows["node"][a[head]]), pa.array(rows["node"][b[head]]), pa.array(bits[head].astype(np.int32))], names=["a", "b", "bits"])


def nearest_similar(prints: DataFrame, n_prints: int, t: float, part: int = 500_000, at_once: int = 1 << 18) -> DataFrame:
    """a, b: of each node the nearest one before it in lists of two positional bytes, if at most ``WIDE_BITS`` bits differ.

    prints: node, fp, size (of the set; the smaller one of a pair must have t
    times the larger one's). Equal fingerprints are near each other. A list's
    member is compared with the ``LIST`` before it, in order of fingerprints.
    """
    byte = lambda p: F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = F.array(*[F.lit(k << 16) + byte(p) * 256 + byte(q) for k, (p, q) in enumerate(TWOS)])
    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_prints * len(TWOS) // part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in _POST] for b in batches]
        if parts:
            rows = {c: np.concatenate([x[k] for x in parts]) for k, c in enumerate(_POST)}
            parts.clear()
            order = np.lexsort([rows[c] for c in ("node", "fp", "key")])
            yield from _nearest({c: v[order] for c, v in rows.items()}, t, at_once)

    posts = prints.select(F.explode(keys).alias("key"), "node", "fp", "size").repartition(n, "key")
    return posts.mapInArrow(run, "a long, b long, bits int").groupBy("a").agg(F.min_by("b", F.struct("bits", "b")).alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of every row.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows
    with a null id get a component like others; null is never the smallest id
    unless it is the only one. Repeated rows stay. An empty table gives none.
    Very long texts are read whole by their task.
    """
    prints = written(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), "fingerprints", True)
    with passing():
        least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
        groups = components(near_links(least.select("fp")))
        # only fingerprints with a link to another one need their component's smallest id looked up
        roots = groups.join(least, groups["node"] == least["fp"]).select("fp", "component", "least")
        of_group = roots.groupBy("component").agg(F.min("least").alias("group_least"))
        linked = roots.join(of_group, "component").select("fp", "group_least")
        known = written(least.join(linked, "fp", "left").select("fp", F.coalesce("group_least", "least").alias("component_id")), "fingerprint-components", True)
    return prints.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
