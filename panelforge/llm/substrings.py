"""Substring dedup by relative Lempel-Ziv parsing: documents are factored greedily against every
indexed reference block, and long factors are the spans that earlier documents hold already.

The corpus is cut into reference blocks of neighbouring rows (``BLOCK_BYTES`` of text each), one
row a block. A block's index holds its windows of ``window`` words with the smallest id that holds
each. No block is compared with each other block; indexes meet by hash, in two rounds:

1. *Anchors.* The windows of a text are thinned to anchors: of the runs of ``GRAM`` words inside
   a window, the one of smallest hash (about one position in four). Equal windows have equal anchors. Each block sends
   the anchors it has, once each and packed by range of hash; back comes one bit an anchor: another block has it.
2. *Windows.* Each block sends 96 bits of those windows whose anchor has that bit, with their
   smallest id in the block; back comes one bit a window: a smaller id holds it in another block.

Then each text is parsed from left to right: a factor begins at a word whose window is found (in
an earlier document of the block or by its bit), is extended as far as the windows that begin
inside it are found, and ends there. Windows that lie across a factor's end are looked up like any other, so
no duplicate is lost between two factors. A passage that a third of all documents holds is one entry a
block. Windows are taken for equal by 96 bits of two hashes: at 1e13 windows under one pair in a hundred such
corpora is wrong.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import BROADCAST_BYTES, small_batches, unused, written

WINDOW = 13
#: Words of an anchor; a window of w words has w - GRAM + 1 of them to choose from.
GRAM = 7
#: Text of a reference block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Blocks of a file and of an Arrow batch, so that neither holds more than this many in memory.
FILE_BLOCKS = 4
#: Bytes of keys that meet in one group, about.
BUCKET_BYTES = 16 << 20
#: Text that is hashed at once, and the longest word that its running hash tells apart; longer ones are hashed one by one.
CHUNK, LONG_WORD = 1 << 18, 64
NO_ID = np.iinfo(np.int64).max
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def rolled(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of each n neighbours."""
    size = max(len(h) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out *= base
        out += h[k : k + size]
    return mix(out)


SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))]) for base in (A, np.uint64(pow(int(A), -1, 1 << 64))))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of some texts, from running sums over their bytes, and each text's number of words."""
    joined = b"\n".join(texts)
    octets = np.frombuffer(joined, np.uint8)
    up, down = _powers(1 << max(19, len(octets).bit_length()))
    space = SPACE[octets]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * up[: len(octets)])])
    h = mix((sums[end] - sums[begin]) * down[begin] + mix((end - begin).astype(np.uint64)))
    for k in np.flatnonzero(end - begin > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(joined[begin[k] : end[k]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(begin, np.concatenate([[0], ends])))


@dataclass
class Index:
    """The windows of a block: their texts, anchors and, for some of them, groups of equal ones."""

    h: np.ndarray  # hash of each word
    starts: np.ndarray  # of each text's words among all
    at: np.ndarray  # first word of each window
    ids: np.ndarray  # id of each window's text
    window: int
    anchors: np.ndarray  # distinct anchors, ascending
    anchor: np.ndarray  # of each window, an index of anchors
    again: np.ndarray  # whether an anchor stands at two places

    def groups(self, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows whose anchor is told to be in another block, or stands twice in this one: the windows, the group
        of equal ones of each, and for each group its two hashes (ascending), its smallest id and whether its anchor is told."""
        some = np.flatnonzero((told | self.again)[self.anchor])
        at = self.at[some]
        h1, h2 = (_windows(h, at, self.window, base) for h, base in ((self.h, A), (mix(self.h), B)))
        order = np.argsort(h1)
        a, b = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if (new[1:] & (a[1:] == a[:-1])).any():  # two windows of one first hash
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        heads = np.flatnonzero(new)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        first = np.minimum.reduceat(self.ids[some][order], heads) if len(heads) else self.ids[:0]
        return some, group, a[heads], b[heads], first, told[self.anchor[some[order[heads]]]]


def _windows(h: np.ndarray, at: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    return rolled(h, n, base)[at]


def index_of(ids: list, texts: list, window: int) -> Index:
    parts, sizes, held, size = [], [], [], 0
    for t in [*texts, None, ...]:
        if t is ... or size > CHUNK:
            h, n = word_hashes(held)
            parts.append(h)
            sizes.append(n)
            held, size = [], 0
        held.append(b"" if t is ... else t or b"")
        size += len(held[-1])
    h, sizes = np.concatenate(parts), np.concatenate(sizes)[: len(texts)]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    windows = np.maximum(sizes - window + 1, 0)  # inside one text only
    at = np.repeat(starts[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    own = np.repeat(np.array([NO_ID if i is None else i for i in ids], np.int64), windows)
    gram = min(GRAM, window)
    grams = rolled(h, gram, B)
    best = grams[at]
    for k in range(1, window - gram + 1):
        np.minimum(best, grams[at + k], out=best)
    run = np.ones(len(best), bool)
    run[1:] = best[1:] != best[:-1]  # neighbours share their anchor
    anchors, inverse, times = np.unique(best[run], return_inverse=True, return_counts=True)
    # runs end at a text's end as well: an anchor that goes on in the next text stands twice
    again = times > 1
    over = np.flatnonzero(~run[1:] & (np.diff(at) > 1)) + 1
    anchor = inverse[np.cumsum(run) - 1] if len(best) else np.zeros(0, np.int64)
    again[anchor[over]] = True
    return Index(h, starts, at, own, window, anchors, anchor, again)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """n ranges of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _parts(h: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """The filled ranges of ascending hashes."""
    cuts = np.searchsorted(_bucket(h, n), np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), slice(cuts[k], cuts[k + 1])


def _bits(answers: list | None) -> list:
    return [(x["bucket"], x["bits"], x["n"]) for x in answers or ()]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One block after the other."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _unpacked(found: list, n: int) -> np.ndarray:
    """The bits of all ranges in order; no answer means no bit."""
    if not found:
        return np.zeros(n, bool)
    parts = [np.unpackbits(np.frombuffer(bits, np.uint8), count=size) if bits else np.zeros(size, np.uint8) for _, bits, size in sorted(found)]
    return np.concatenate(parts).astype(bool)


KEYS = "bucket long, block long, n long, keys binary, ids binary"
ANSWER = "block long, bucket long, n long, bits binary"


def _keys(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "block", "n", "keys", "ids"])


def _narrow(ids: np.ndarray) -> bytes:
    """The least of some ids, and what the others are above it, in four bytes each if that holds them."""
    least = ids.min()
    above = ids.view(np.uint64) - least.view(np.uint64)
    return least.tobytes() + (above.astype(np.uint32) if above.max() < 1 << 32 else above).tobytes()


def _widened(packed: bytes, n: int) -> np.ndarray:
    above = np.frombuffer(packed, np.uint32 if len(packed) == 8 + 4 * n else np.uint64, n, 8)
    return (above.astype(np.uint64) + np.frombuffer(packed, np.uint64, 1)).view(np.int64)


def anchors_elsewhere(t: pa.Table) -> pa.Table:
    """For each block's anchors of one range of hashes: which of them another block has."""
    sizes = t["n"].to_numpy()
    keys = np.concatenate([np.frombuffer(k, np.uint32) for k in t["keys"].to_pylist()])
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    return _answer(t, sizes, times[inverse] > 1)


def smaller_elsewhere(t: pa.Table) -> pa.Table:
    """For each block's windows of one range of hashes: which of them has a smaller id in another block."""
    sizes, keys = t["n"].to_numpy(), t["keys"].to_pylist()
    h1 = np.concatenate([np.frombuffer(k, np.uint64, n) for k, n in zip(keys, sizes)])
    h2 = np.concatenate([np.frombuffer(k, np.uint32, n, 8 * n) for k, n in zip(keys, sizes)])
    ids = np.concatenate([_widened(k, n) for k, n in zip(t["ids"].to_pylist(), sizes)])
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = np.empty(len(order), bool)
    hit[order] = ids[order] > least
    return _answer(t, sizes, hit)


def _answer(t: pa.Table, sizes: np.ndarray, hit: np.ndarray) -> pa.Table:
    bits = [np.packbits(x).tobytes() if x.any() else b"" for x in np.split(hit, np.cumsum(sizes)[:-1])]
    return pa.table({"block": t["block"], "bucket": t["bucket"], "n": t["n"], "bits": pa.array(bits, pa.binary())})


def spans_of(found: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy factors of one text from the first words of its windows that are found: [first word, end) of the words they cover."""
    if not len(found):
        return []
    # a factor goes on, or the next one begins inside it or at its end, while starts are at most a window apart
    last = np.append(np.diff(found) > window, True)
    first = np.append(True, last[:-1])
    return list(zip(found[first].tolist(), (found[last] + window).tolist()))


def _joined(blocks: DataFrame, answers: DataFrame, name: str, n: int) -> DataFrame:
    """The blocks with the answers they got: a broadcast below the bound, a shuffle beyond it."""
    by = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(name))
    return blocks.join(F.broadcast(by) if n <= BROADCAST_BYTES else by, "block", "left")


def _size(answers: DataFrame) -> int:
    return answers.agg(F.sum(F.length("bits") + 64)).first()[0] or 0


def _cut(docs: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """Rows of blocks: block, the texts' bytes and the list of whole rows."""
    text, block, rows = names
    small_batches(docs.sparkSession)
    kept = docs.drop(text).schema
    schema = T.StructType([T.StructField(block, T.LongType()), T.StructField(text, T.ArrayType(T.BinaryType())), T.StructField(rows, T.ArrayType(kept))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def full() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ends = pa.array([0, t.num_rows], pa.int32())
            inner = pa.StructArray.from_arrays([t.column(c) for c in kept.names], fields=[t.schema.field(c) for c in kept.names])
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.ListArray.from_arrays(ends, t.column(text)), pa.ListArray.from_arrays(ends, inner)], [block, text, rows])

        for b in batches:
            begin = 0
            for k, n in enumerate(map(len, (x or b"" for x in b.column(text).to_pylist()))):
                if size and size + n > BLOCK_BYTES:
                    held.append(b.slice(begin, k - begin))
                    yield full()
                    begin, seq, held, size = k, seq + 1, [], 0
                size += n + 1
            held.append(b.slice(begin))
        if any(x.num_rows for x in held):
            yield full()

    return docs.mapInArrow(run, schema)


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, deduped_col: str | None = "deduped") -> DataFrame:
    """Adds n_words, n_removed, spans (word positions [start, end) that earlier documents hold) and the text of the kept words; keeps all rows.

    Words are runs of other characters than ASCII white space. A window of ``window`` words is a duplicate if
    its words also follow each other in a document with a smaller id; words under such a window are removed.
    All windows are judged on the input. Kept words are joined by one space.

    Null and empty texts have no words; texts shorter than a window keep all. Rows of one id are
    not earlier than each other; null ids count as the largest, so they lose what numbered documents
    have and take nothing. Very long texts are a block of their own and held whole by one task. An empty table gives an
    empty result. Input columns with the names of added ones are replaced; all others are passed on.
    """
    spark = docs.sparkSession
    added = ["n_words", "n_removed", "spans", *([deduped_col] if deduped_col else [])]
    docs = docs.drop(*[c for c in added if c not in (id_col, text_col)])
    names = text, block, rows, number = unused(docs.columns, "words_text", "block", "block_rows", "own_number")
    # a text travels once: as bytes, from which its column is made again
    source = docs.select(*[c for c in docs.columns if c != text_col], F.col(text_col).cast("string").cast("binary").alias(text), F.col(id_col).cast("long").alias(number))
    cut = _cut(source, names[:3])
    # few blocks a file, since a reader may hold a whole file's rows at once
    path = written(cut.select(F.col(block).alias("block"), F.col(text).alias("texts"), F.col(f"{rows}.{number}").alias("ids"), F.col(rows).alias("rows")), "reference-blocks", max_rows=FILE_BLOCKS, codec="zstd")
    light = path.select("block", "ids", "texts")
    n_bytes = path.select(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0))))).first()[0] or 0
    # a key of 12 and an id of 4 or 8 bytes for each word, about six bytes of text
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-3 * n_bytes // BUCKET_BYTES))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            anchors = index_of(row["ids"], row["texts"], window).anchors
            low = (anchors & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            out = [(k, row["block"], s.stop - s.start, low[s].tobytes(), b"") for k, s in _parts(anchors, buckets)]
            if out:
                yield _keys(out)

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            index = index_of(row["ids"], row["texts"], window)
            _, _, h1, h2, first, told = index.groups(_unpacked(_bits(row["anchors"]), len(index.anchors)))
            h1, h2, first = h1[told], h2[told], first[told]
            out = [(k, row["block"], s.stop - s.start, h1[s].tobytes() + h2[s].astype(np.uint32).tobytes(), _narrow(first[s])) for k, s in _parts(h1, buckets)]
            if out:
                yield _keys(out)

    keep = docs.columns
    out_schema = T.StructType([*[T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema.fields], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), *([T.StructField(deduped_col, T.StringType())] if deduped_col else [])])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.select(["ids", "texts", "anchors", "windows"]).slice(k, 1).to_pylist()[0]
                index = index_of(row["ids"], row["texts"], window)
                some, group, _, _, first, told = index.groups(_unpacked(_bits(row["anchors"]), len(index.anchors)))
                elsewhere = np.zeros(len(told), bool)
                elsewhere[told] = _unpacked(_bits(row["windows"]), int(told.sum()))
                found = index.at[some[elsewhere[group] | (index.ids[some] > first[group])]]
                cuts = np.searchsorted(found, index.starts)
                spans, removed, kept = [], [], []
                for d, text in enumerate(row["texts"]):
                    own = spans_of(found[cuts[d] : cuts[d + 1]] - index.starts[d], window)
                    spans.append([{"start": x, "end": y} for x, y in own])
                    removed.append(sum(y - x for x, y in own))
                    if deduped_col:
                        words = (text or b"").split()
                        for x, y in reversed(own):
                            del words[x:y]
                        kept.append(b" ".join(words))
                inner, texts = b.column("rows").slice(k, 1).flatten(), b.column("texts").slice(k, 1).flatten()
                arrays = [texts.cast(pa.string()) if c == text_col else inner.field(c) for c in keep] + [pa.array(np.diff(index.starts), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span_type)] + ([pa.array(kept, pa.binary()).cast(pa.string())] if deduped_col else [])
                for x in range(0, len(inner), 512):
                    yield pa.RecordBatch.from_arrays([a.slice(x, 512) for a in arrays], out_schema.names)

    small_batches(spark)
    told = written(light.mapInArrow(send_anchors, KEYS).groupBy("bucket").applyInArrow(anchors_elsewhere, ANSWER), "anchor-answers")
    known = _joined(light, told, "anchors", n_told := _size(told))
    found = written(known.mapInArrow(send_windows, KEYS).groupBy("bucket").applyInArrow(smaller_elsewhere, ANSWER), "window-answers")
    whole = _joined(_joined(path, told, "anchors", n_told), found, "windows", _size(found))
    return whole.mapInArrow(parse, out_schema)


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    out = duplicate_spans(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("deduped").cast("binary"), 256).alias("kept_sha256"))


#: The windows as joined words, by the smallest document that holds each.
ORACLE = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM docs),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
firsts AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
covered AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM windows JOIN firsts USING (k) WHERE m < doc_id),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
