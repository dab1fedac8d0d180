"""Near-duplicate documents by SimHash and a byte-position index, checked exactly: documents are linked if their shingles have a Jaccard similarity of 0.8 or more.

1. A document becomes the set of 64-bit hashes of its shingles (five words; all
   words of a shorter one), and a SimHash fingerprint of the same shingles.
   Documents with equal sets form one class.
2. Fingerprints meet in posting lists of positional bytes, where the bytes that
   a pair shares are tallied (see ``simhash.nearest_similar``). Each class's
   nearest one is verified on whole sets; verified links make groups.
3. Similar sets may have fingerprints that share too few bytes: 64 bits can't
   promise a similarity. What is left open is joined exactly, across groups only.
   Shingles are ordered by rarity (see ``lines``). Two similar sets share one of
   the first ``size - ceil(t * size) + 1`` shingles of either, so classes meet in
   the posting lists of these. Length and positional filters leave candidates.
4. Each class verifies on whole sets the earlier one that most of its lists
   pass on. Classes that had more candidates pass on all of them in a second
   round, but for those that are in their component already.
5. Verified links make components. No link between components is left out, so
   the components are those of all pairs, not of a sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import simhash
from panelforge.llm.common import maybe_broadcast, passing, small_batches, text_or_empty, written
from panelforge.llm.components import components
from panelforge.llm.lines import CELLS, ODD_A, ODD_B, PAIRS, PART, Hasher, _buffer, _mix, narrow, overlap_needed, token_rarity

WIDTH = 5
SIMILARITY = 0.8
FIRST_ID = -(1 << 63)
#: What tells rows apart but for repeated ones: null ids come last.
ROW = ("no_id", "d", "th")


def hashes(hasher: Hasher, column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every shingle of a column of texts: the text's index and the hash."""
    data, offsets = _buffer(column)
    starts, h = hasher.tokens(data, offsets)
    text = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(text, minlength=len(column))
    pos = np.arange(len(h)) - (np.cumsum(words) - words)[text]
    n = np.minimum(words, width)[text]
    begins = np.flatnonzero(pos + n <= words[text])
    n = n[begins]
    out = n.astype(np.uint64) * ODD_B
    for k in range(width):
        has = n > k
        out[has] += _mix(h[begins[has] + k] + np.uint64((k + 1) * int(ODD_B) % (1 << 64)), ODD_A) * np.uint64(2 * k + 1)
    return text[begins], _mix(out, ODD_A)


SETS = "rid long, no_id boolean, d long, th long, key_a long, key_b long, size int, fp long, prefix array<long>, at array<int>"


def _sets(docs: DataFrame, rarity: np.ndarray, width: int, t: float) -> DataFrame:
    """Every row's number, keys and size of its set, its fingerprint, and its prefix with places."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, rid = Hasher(), TaskContext.get().partitionId() << 33
        for b in batches:
            n = b.num_rows
            text, h = hashes(hasher, b.column("text"), width)
            level = shared.value[(h & np.uint64(len(shared.value) - 1)).astype(np.int64)]
            order = np.lexsort((h, level, text))
            text, h, level = text[order], h[order], level[order]
            new = np.ones(len(h), bool)
            new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
            text, h, level = text[new], h[new], level[new]
            size = np.bincount(text, minlength=n)
            keys = []
            for odd in (ODD_A, ODD_B):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(h, odd), dtype=np.uint64)))
                ends = np.cumsum(size)
                keys.append((sums[ends] - sums[ends - size]).view(np.int64))
            pos = np.arange(len(h)) - (np.cumsum(size) - size)[text]
            # a shingle that occurs once can't be shared
            held = (pos < (size - np.ceil(t * size - 1e-9).astype(np.int64) + 1)[text]) & (level > 0)
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text[held], minlength=n)))).astype(np.int32))
            arrays = [pa.array(x) for x in (*keys, size.astype(np.int32), simhash.simhashes(b.column("text"), width))]
            prefix = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h[held].view(np.int64), pos[held].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + n)), *(b.column(c) for c in ROW), *arrays, *prefix], names=[f.split()[0] for f in SETS.split(", ")])
            rid += n

    return docs.mapInArrow(run, SETS)


CANDIDATE = "a long, b long, n long"
_POST = ("token", "node", "size", "pos", "group", "ask")


def _search(rows: dict[str, np.ndarray], t: float, every: bool) -> Iterator[pa.RecordBatch]:
    """Candidates of whole posting lists that are sorted by token, then size and node: each member's first one, or every one."""
    n = len(rows["token"])
    new = np.concatenate(([True], rows["token"][1:] != rows["token"][:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    earlier = np.arange(n) - start
    some_ask = np.logical_or.reduceat(rows["ask"], np.flatnonzero(new))[np.cumsum(new) - 1]
    asking = np.flatnonzero((earlier > 0) & some_ask)
    at, upto = 0, np.cumsum(earlier[asking])
    while at < len(asking):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        some = asking[at:end]
        at = end
        a = np.repeat(some, earlier[some])
        b = np.arange(len(a)) - np.repeat(np.cumsum(earlier[some]) - earlier[some], earlier[some]) + np.repeat(start[some], earlier[some])
        sa, sb = rows["size"][a], rows["size"][b]
        need = overlap_needed(sa, sb, t)
        ok = (sb >= t * sa - 1e-9) & (np.minimum(sa - rows["pos"][a], sb - rows["pos"][b]) >= need)
        ok &= (rows["group"][a] != rows["group"][b]) & (rows["ask"][a] | rows["ask"][b])
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        head = np.concatenate(([True], a[1:] != a[:-1]))
        times = np.bincount(np.cumsum(head) - 1)[np.cumsum(head) - 1]
        kept = slice(None) if every else head
        yield pa.RecordBatch.from_arrays([pa.array(rows["node"][a[kept]]), pa.array(rows["node"][b[kept]]), pa.array(times[kept].astype(np.int64))], names=["a", "b", "n"])


def candidates(posts: DataFrame, n_posts: int, t: float, every: bool = False) -> DataFrame:
    """a, b, n: pairs of classes of different groups that pass the filters in a list, and how many of the list pass for a."""
    n = max(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_posts // PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in _POST] for b in batches]
        if parts:
            rows = {c: np.concatenate([p[k] for p in parts]) for k, c in enumerate(_POST)}
            parts.clear()
            same = np.argsort(rows["token"], kind="stable")
            token = rows["token"][same]
            same = same[(token == np.roll(token, 1)) | (token == np.roll(token, -1))]
            if len(same) > 1:
                order = same[np.lexsort([rows[c][same] for c in ("node", "size", "token")])]
                yield from _search({c: v[order] for c, v in rows.items()}, t, every)

    return posts.select(*_POST).repartition(n, "token").mapInArrow(run, CANDIDATE)


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, width: int, t: float) -> DataFrame:
    """a, b of the pairs whose whole sets have Jaccard t or more."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(firsts.join(ends, "node", "left_semi").select("node", *ROW), "wanted-documents")
    texts = docs.join(maybe_broadcast(wanted, wanted.count(), 40), [*ROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            text, h = hashes(hasher, b.column("text"), width)
            sets = [np.unique(x).tobytes() for x in np.split(h, np.cumsum(np.bincount(text, minlength=b.num_rows))[:-1])]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "hashes"])

    # repeated rows give a set more than once
    sets = written(texts.select("node", "text").mapInArrow(run, "node long, hashes binary"), "wanted-sets").dropDuplicates(["node"])
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("ha"), b.column("hb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared >= t * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return both.select("a", "b", "ha", "hb").mapInArrow(verify, "a long, b long")


def by_simhash(prints: DataFrame, docs: DataFrame, firsts: DataFrame, width: int, t: float) -> DataFrame:
    """a, b: links between each class and its nearest one by fingerprint, where whole sets have Jaccard t or more."""
    near = narrow(simhash.nearest_similar(prints, prints.count(), t), "simhash-candidates")
    return written(_verified(near, docs, firsts, width, t), "simhash-links")


def _links(prints: DataFrame, posts: DataFrame, n_posts: int, docs: DataFrame, firsts: DataFrame, width: int, t: float) -> DataFrame:
    """a, b: links whose components are those of all pairs of classes with Jaccard t or more."""
    links = by_simhash(prints, docs, firsts, width, t)
    fresh = _grouped(posts, links).withColumn("ask", F.lit(True))
    found = narrow(candidates(fresh, n_posts, t), "near-candidates")
    by_pair = found.groupBy("a", "b").agg(F.count("*").alias("lists"), F.max("n").alias("n"))
    best = written(by_pair.groupBy("a").agg(F.max_by("b", F.struct("lists", "b")).alias("b"), F.max("n").alias("n"), F.count("*").alias("others")), "nearest-documents")
    links = links.unionByName(written(_verified(best, docs, firsts, width, t), "near-links"))
    asked = written(best.where("n > 1 or others > 1").select(F.col("a").alias("node")), "open-documents")
    if not (n_asked := asked.count()):
        return links
    lists = written(_exploded(posts.join(maybe_broadcast(asked, n_asked, 16), "node", "left_semi")).select("token").distinct(), "open-lists")
    marked = _grouped(posts, links).join(maybe_broadcast(lists, lists.count(), 16), "token", "left_semi")
    marked = marked.join(maybe_broadcast(asked.withColumn("asked", F.lit(True)), n_asked, 24), "node", "left")
    marked = marked.select("token", "node", "size", "pos", "group", F.coalesce("asked", F.lit(False)).alias("ask"))
    rest = narrow(candidates(marked, n_posts, t, True).select("a", "b").distinct(), "near-candidates")
    rest = written(rest.join(best.select("a", "b"), ["a", "b"], "left_anti"), "near-candidates")
    return links.unionByName(written(_verified(rest, docs, firsts, width, t), "near-links"))


def _exploded(posts: DataFrame, *more: str) -> DataFrame:
    """A row a posting of rows a class."""
    return posts.select("node", "size", *more, F.explode(F.arrays_zip("prefix", "at")).alias("p")).select("node", "size", *more, F.col("p.prefix").alias("token"), F.col("p.at").alias("pos"))


def _grouped(posts: DataFrame, links: DataFrame) -> DataFrame:
    """Postings with the component that their class has by these links; itself if it has none."""
    groups = written(components(links), "near-groups")
    of = posts.join(maybe_broadcast(groups, groups.count(), 32), "node", "left")
    return _exploded(of.withColumn("group", F.coalesce("component", "node")), "group")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, t: float = SIMILARITY, cells: int = CELLS) -> DataFrame:
    """doc_id, th (the text's hash), component_id (the smallest doc_id reachable) and is_first of every row.

    is_first: the component's first row by id (null ones last), then th; rows
    that repeat it are first as well.

    Words lie between ASCII white space, with A-Z lower-cased. Texts without
    words are linked with each other only. Rows with a null id get a component
    like others; null is the smallest id only where there is no other. Repeated
    rows stay. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    known = docs.select(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))
    with passing():
        rarity, _ = token_rarity(known, cells, lambda hasher, column: hashes(hasher, column, width)[1])
        sets = written(_sets(known, rarity, width, t), "shingle-sets")
        classes = written(sets.groupBy("key_a", "key_b").agg(F.min(F.struct(*ROW, "rid", "fp", "size")).alias("f")).select("key_a", "key_b", "f.*"), "shingle-classes")
        firsts = classes.select(F.col("rid").alias("node"), *ROW)
        prints = classes.where("size > 0").select(F.col("rid").alias("node"), "fp", "size")
        posts = sets.join(classes.select("rid"), "rid", "left_semi").select(F.col("rid").alias("node"), "size", "prefix", "at")
        n_posts = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
        groups = components(_links(prints, posts, n_posts, known, firsts, width, t))
        of_class = classes.join(groups, classes["rid"] == groups["node"], "left").withColumn("component", F.coalesce("component", "rid"))
        first = of_class.groupBy("component").agg(F.min(F.struct(*ROW)).alias("first"))
        roots = written(of_class.join(first, "component").select("key_a", "key_b", "first"), "shingle-roots")
        out = written(sets.select(*ROW, "key_a", "key_b").join(roots, ["key_a", "key_b"]).select(*ROW, "first"), "near-rows", True)
    id_of = lambda p: F.when(~F.col(f"{p}no_id"), F.col(f"{p}d"))
    return out.select(id_of("").alias("doc_id"), "th", id_of("first.").alias("component_id"), (F.struct(*ROW) == F.col("first")).alias("is_first"))
