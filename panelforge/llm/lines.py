"""Line dedup as an exact set-similarity join: a line goes if an earlier one has a Jaccard similarity of 0.8 or more.

1. Rarity: occurrences of all tokens are counted in a fixed number of hashed
   cells. (cell's rarity, token's hash) orders all tokens alike everywhere, rare
   ones first; a shared cell makes the order less selective, never wrong. A
   token that occurs once in the corpus can't be shared and has no posting.
2. Each line becomes its token set in that order: its size, a 128-bit sum of
   token hashes that names the set, 128 parity bits of its tokens and the prefix
   tokens that any similar line must share one of. Lines with equal sets form one
   class, standing at its first occurrence; every other occurrence goes.
3. Classes meet in the posting lists of prefix tokens (of their 32-bit hashes:
   tokens that share one only add candidates, never the line itself). A list is
   sorted by size, so that the length filter is a range of it; only the tokens of
   a set's shorter index prefix are looked up by larger sets. Positional and
   parity filters leave candidates; of them each line passes on the nearest one by
   parity bits, for one earlier match is enough to remove it. Lines that fail
   with it, and had more, go on to rounds that pass on 8, 64, 512, ... of each
   list, until a match is found or all of their candidates have failed.
4. Candidates are verified on their words.

Sets and postings travel in blocks of columns, one binary value for each pair of
tasks. A list of over ``BLOCK`` postings is cut into blocks by size, and pairs of
blocks are dealt out evenly, so no list has to fit into one task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import maybe_broadcast, passing, small_batches, text_or_empty, unused, written
from panelforge.llm.packed import Columns, Layout, buffers, joined, runs, spans, take

SIMILARITY = 0.8
#: Lines of fewer tokens are left alone, where the caller doesn't ask for shorter ones.
MIN_TOKENS = 3
#: Lines with at least one word: what the query and the pipeline join.
ALL_LINES = 1
#: Cells of the token counts, a byte each: what is broadcast, whatever the vocabulary.
CELLS = 1 << 22
#: Cells of a slice.
SLICE = 1 << 15
#: Pairs of posting lists that are compared at a time, and rows of an Arrow batch of narrow rows and of packed blocks.
PAIRS, ROWS, BLOCK_ROWS = 1 << 18, 1 << 14, 16
#: Tokens of the lines of a partition, postings of one, classes of a row of packed ones, postings of a block, and postings that are held before long lists are cut.
TOKENS, PART, CLASSES, BLOCK, HELD = 3_000_000, 500_000, 1 << 14, 4096, 2_000_000
#: Candidates of a list that a line passes on grow by this factor from round to round.
WIDER = 8
FIRST_ID = -(1 << 63)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes that are hashed at a time.
HASHED = 1 << 19
ODD_A, ODD_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(line: str) -> list[bytes]:
    """The words between ASCII white space, with A-Z lower-cased."""
    return line.encode().translate(LOWER).split()


def _mix(h: np.ndarray, odd: np.uint64) -> np.ndarray:
    h = h * odd
    h ^= h >> np.uint64(29)
    h *= odd | np.uint64(2)
    return h ^ (h >> np.uint64(32))


def overlap_needed(a, b, t: float):
    """The least number of shared tokens of sets of these sizes with Jaccard t or more."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


class Hasher:
    """Hashes of all tokens of a buffer at once: sums of bytes' numbers by powers of an odd base, modulo 2**64, mixed with the length.

    A token's sum is a difference of prefix sums over the power at its start, so
    no token becomes a Python object. Buffers are taken in blocks that end
    between tokens, which bounds memory for very long texts.
    """

    BASE = 0x9DDFEA08EB382D69

    def __init__(self):
        numbers = xxhash.xxh3_64_intdigest
        self.of_byte = np.array([numbers(bytes([LOWER[b]])) for b in range(256)], np.uint64)
        self.blank = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        back = pow(self.BASE, -1, 1 << 64)
        while len(self.power) < n:
            k = len(self.power)
            self.power = np.concatenate((self.power, self.power * np.uint64(pow(self.BASE, k, 1 << 64))))
            self.inverse = np.concatenate((self.inverse, self.inverse * np.uint64(pow(back, k, 1 << 64))))

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the tokens of texts that lie in ``data`` from offset to offset."""
        blank = self.blank[data]
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        first = ~blank & (begin[:-1] | np.concatenate(([True], blank[:-1])))
        last = ~blank & (begin[1:] | np.concatenate((blank[1:], [True])))
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        out = np.empty(len(starts), np.uint64)
        k = 0
        while k < len(starts):
            n = max(k + 1, int(np.searchsorted(ends, starts[k] + HASHED, "right")))
            lo, hi = int(starts[k]), int(ends[n - 1])
            self._grow(hi - lo)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.of_byte[data[lo:hi]] * self.power[: hi - lo])))
            a, b = starts[k:n] - lo, ends[k:n] - lo
            out[k:n] = _mix((sums[b] - sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * ODD_B, ODD_A)
            k = n
        return starts, out


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and the texts' offsets in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0]).astype(np.int64)


def _identity(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, bool]:
    """d, th: the id (null first) and, where ids repeat, the text's hash tell documents apart; equal rows are one document. Whether ids repeat."""
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)).alias("d"))
    repeated = ids.groupBy("d").count().where("count > 1").limit(1).count()
    th = F.xxhash64(text_or_empty(text_col)) if repeated else F.lit(0).cast("long")
    return F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)), th, bool(repeated)


def token_rarity(docs: DataFrame, cells: int, hashes: Callable[[Hasher, pa.Array], np.ndarray] | None = None) -> tuple[np.ndarray, int]:
    """Of each hashed cell 8 times the binary logarithm of its tokens' occurrences over all texts, as a byte: 0 for one occurrence.
    Then the number of all occurrences.

    hashes: those of a column of texts, where they aren't those of its words.

    Every task counts all its tokens, up to 255 a cell; tasks' counts travel as
    slices of bytes and are summed as a stream. A cell that reaches 255 in a
    task is common, and its exact place among common ones doesn't matter.
    """
    width = min(cells, SLICE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hasher, some = np.zeros(cells, np.uint32), Hasher(), 0
        for b in batches:
            h = hashes(hasher, b.column(0)) if hashes else hasher.tokens(*_buffer(b.column(0)))[1]
            np.add.at(total, (h & np.uint64(cells - 1)).astype(np.int64), np.uint32(1))
            some += len(h)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.int64(some).tobytes()], pa.binary())], names=["slice", "counts"])
        for k in range(0, cells if some else 0, width):
            part = np.minimum(total[k : k + width], 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k // width], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, counts in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()):
                x = np.frombuffer(counts, np.uint8 if k >= 0 else np.int64)
                sums[k] = sums[k] + x if k in sums else x.astype(np.int64)
        for k, x in sums.items():
            if k < 0:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["slice", "levels"])
                continue
            level = np.where(x > 0, np.minimum(np.round(8 * np.log2(np.maximum(x, 1))), 255), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "levels"])

    n = min(cells // width, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    levels = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition(n, "slice").mapInArrow(add, "slice int, levels binary")
    out, n_all = np.full(cells, 255, np.uint8), 0
    for r in written(levels, "token-rarity").toLocalIterator():
        if r["slice"] < 0:
            n_all = int(np.frombuffer(r["levels"], np.int64)[0])
            continue
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["levels"], np.uint8)
    return out, n_all


def narrow(df: DataFrame, name: str, rows: int = ROWS) -> DataFrame:
    """Writes a table whose Python step has narrow rows, and so gets larger Arrow batches; or, with ``BLOCK_ROWS``, rows of
    packed blocks of up to some MB, of which the JVM and the worker hold few at a time."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(rows))
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


LINE = Layout(key_a="i8", key_b="i8", d="i8", th="i8", line="i4", size="i4", s0="u8", s1="u8", base="i4", count="i4")
TOKEN = Layout(token="u4")
POST = Layout(token="u4", d="i8", th="i8", line="i4", size="i4", pos="i4", s0="u8", s1="u8", ask="u1")
PLACE = Layout(d="i8", th="i8", line="i4")
LINE_OF = ("d", "th", "line")


def _line_sets(hasher: Hasher, column: pa.Array, rarity: np.ndarray, t: float, min_tokens: int):
    """Of each line with enough tokens: text's index, line number, keys, size, parity bits, place of its first prefix token and their number; the prefix tokens of all."""
    data, offsets = _buffer(column)
    starts, h = hasher.tokens(data, offsets)
    breaks = np.flatnonzero(data == 10)
    text = np.searchsorted(offsets, starts, "right") - 1
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[text])
    head = np.concatenate(([True], (text[1:] != text[:-1]) | (number[1:] != number[:-1]))) if len(h) else np.zeros(0, bool)
    line = np.cumsum(head) - 1
    enough = np.bincount(line, minlength=1)[line] >= min_tokens if len(h) else head
    if not enough.any():
        return None
    h, line, head = h[enough], line[enough], head[enough]
    text, number = text[enough][head], number[enough][head]
    line = np.cumsum(head) - 1
    # the order of tokens: rarity level, then the hash's upper 56 bits
    code = rarity[(h & np.uint64(len(rarity) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)
    # one sort by line and the code's upper bits; equal ones of different tokens, which hardly occur, take the exact sort
    bits = np.uint64(max(1, int(line[-1]).bit_length()))
    both = line.astype(np.uint64) << (np.uint64(64) - bits) | code >> bits
    order = np.argsort(both)
    both, code, h = both[order], code[order], h[order]
    if ((both[1:] == both[:-1]) & (h[1:] != h[:-1])).any():
        exact = np.lexsort((code, line[order]))
        code, h = code[exact], h[exact]
    new = np.concatenate(([True], (code[1:] != code[:-1]) | (line[1:] != line[:-1])))
    code, h, line = code[new], h[new], line[new]
    n = len(text)
    size = np.bincount(line, minlength=n)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    mixed = _mix(h, ODD_A)
    bit, upper = np.uint64(1) << (mixed & np.uint64(63)), mixed & np.uint64(64) > 0
    s0, s1 = (np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), start) for x in (~upper, upper))
    key_a, key_b = np.add.reduceat(mixed, start), np.add.reduceat(_mix(h, ODD_B), start)
    length = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
    length[size < t / (1 - t) - 1e-9] = 0  # only equal sets are similar to such short ones
    pos = np.arange(len(h)) - start[line]
    once = code >> np.uint64(56) == 0  # stand first in the order
    base = np.bincount(line[once], minlength=n)
    held = (pos < length[line]) & ~once
    sets = {"key_a": key_a.view(np.int64), "key_b": key_b.view(np.int64), "line": number, "size": size, "s0": s0, "s1": s1, "base": base, "count": np.bincount(line[held], minlength=n)}
    return text, sets, (h[held] >> np.uint64(32)).astype(np.uint32)


def _ragged(rows: Columns, prefix: np.ndarray, which: np.ndarray) -> tuple[Columns, np.ndarray]:
    """These rows with their prefix tokens."""
    begins = np.cumsum(rows["count"], dtype=np.int64) - rows["count"]
    return take(rows, which), prefix[spans(begins[which], rows["count"][which].astype(np.int64))]


def _firsts(rows: Columns) -> tuple[np.ndarray, np.ndarray]:
    """The first line of each set, and all others."""
    order = np.lexsort([rows[c] for c in ("line", "th", "d", "key_b", "key_a")])
    a, b = rows["key_a"][order], rows["key_b"][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new], order[~new]


SETS = "part int, rows binary, prefix binary, again binary"


def _dealt_sets(docs: DataFrame, rarity: np.ndarray, t: float, min_tokens: int, n_parts: int) -> DataFrame:
    """Blocks of lines' sets, by the part of their key. Of equal sets that a task holds at a time only the first goes on
    by its key, so that a line that is in a third of all documents is no hot key; the places of the others go to any part."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)
    enough = min(max(1 << 15, 8 * n_parts), 1 << 20)

    def flush(held: list[tuple[Columns, np.ndarray]]) -> pa.RecordBatch:
        rows, prefix = joined([r for r, _ in held]), np.concatenate([p for _, p in held])
        first, again = _firsts(rows)
        again = take(rows, again)
        part = rows["key_a"][first].view(np.uint64) % np.uint64(n_parts)
        order = np.argsort(part, kind="stable")
        rows, prefix = _ragged(rows, prefix, first[order])
        ends = np.cumsum(rows["count"], dtype=np.int64)
        out = [(k, LINE.pack(take(rows, slice(a, b))), TOKEN.pack({"token": prefix[ends[a] - rows["count"][a] : ends[b - 1]]}), None) for k, a, b in runs(part[order])]
        if len(again["d"]):
            out.append((int(_cell(*(again[c][:1] for c in LINE_OF))[0]) % n_parts, None, None, PLACE.pack(again)))
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "rows", "prefix", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = Hasher(), [], 0
        for b in batches:
            if found := _line_sets(hasher, b.column("text"), shared.value, t, min_tokens):
                which, rows, prefix = found
                rows |= {c: b.column(c).to_numpy(zero_copy_only=False)[which] for c in ("d", "th")}
                held.append((rows, prefix))
                n += len(which)
            if n >= enough:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, SETS).repartitionById(n_parts, "part")


def _classes(sets: DataFrame) -> DataFrame:
    """Blocks of the first line of each class, n_posts: their prefix tokens, and blocks of the places of all other lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [[list(buffers(b.column(c))) for c in ("rows", "prefix", "again")] for b in batches]
        rows, prefix, places = (layout.unpack(x for b in blocks for x in b[k]) for k, layout in enumerate((LINE, TOKEN, PLACE)))
        prefix = prefix["token"]
        first, other = _firsts(rows)
        again = joined([places, {c: rows[c][other] for c in LINE_OF}])
        for k in range(0, max(len(first), len(again["d"])), CLASSES):
            some, tokens_of = _ragged(rows, prefix, first[k : k + CLASSES])
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((LINE.pack(some), pa.binary()), (TOKEN.pack({"token": tokens_of}), pa.binary()), (len(tokens_of), pa.int64()), (PLACE.pack(take(again, slice(k, k + CLASSES))), pa.binary()))], names=["rows", "prefix", "n_posts", "again"])

    return sets.mapInArrow(run, "rows binary, prefix binary, n_posts long, again binary")


def _places(blocks: DataFrame) -> DataFrame:
    """The rows of blocks of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = PLACE.unpack(buffers(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(x[c]) for c in LINE_OF], names=list(LINE_OF))

    return blocks.mapInArrow(run, "d long, th long, line int")


def _cell(d: np.ndarray, th: np.ndarray, line: np.ndarray) -> np.ndarray:
    x = _mix(_mix(d.astype(np.int64).view(np.uint64), ODD_A) + th.astype(np.int64).view(np.uint64), ODD_B) + line.astype(np.uint64)
    return (_mix(x, ODD_A) & np.uint64(CELLS - 1)).astype(np.int64)


def _cells(df: DataFrame, cell: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Which of ``CELLS`` hashed cells any row falls into: what reaches the driver is bounded, whatever the rows.
    Every task sends the slices that it has set, a bit a cell."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, bool)
        for b in batches:
            total[cell(b)] = True
        for k in range(0, CELLS, SLICE):
            if total[k : k + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([np.packbits(total[k : k + SLICE]).tobytes()], pa.binary())], names=["slice", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, bits in zip(b.column("slice").to_pylist(), b.column("bits").to_pylist()):
                sums[k] = sums.get(k, np.uint8(0)) | np.frombuffer(bits, np.uint8)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["slice", "bits"])

    out, n = np.zeros(CELLS, bool), 8
    for r in written(df.mapInArrow(mark, "slice int, bits binary").repartitionById(n, "slice").mapInArrow(merge, "slice int, bits binary"), "cells").toLocalIterator():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).view(bool)
    return out


FOUND = "token long, d long, th long, line int, d2 long, th2 long, line2 int, apart int, n long, block int, lo int, hi int, posts binary"
_FOUND = [f.split()[0] for f in FOUND.split(", ")]
_FOUND_KINDS = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in FOUND.split(", ")]


def _found(n_rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n_rows, kind) for c, kind in zip(_FOUND, _FOUND_KINDS)], names=_FOUND)


def _search(rows: Columns, t: float, most: int, n_pairs: int, other: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Candidates within posting lists: of each list and asking line the nearest ``most``, and n: how many pass.

    other: only pairs of rows that differ in it. A chunk of comparisons is taken as a list of its own.
    """
    order = np.lexsort((rows["size"], rows["token"]))
    rows = take(rows, order)
    n = len(order)
    size, token = rows["size"].astype(np.int64), rows["token"]
    number = np.cumsum(np.concatenate(([False], token[1:] != token[:-1])))
    indexed = size - rows["pos"] >= overlap_needed(size, size, t)
    index = np.flatnonzero(indexed)
    key = number << 32 | size
    before = np.cumsum(indexed) - indexed
    low = np.searchsorted(key[index], number << 32 | np.ceil(t * size - 1e-9).astype(np.int64))
    times = np.maximum(before - low, 0)
    asking = np.flatnonzero(times)
    upto = np.cumsum(times[asking])
    at = 0
    while at < len(asking):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + n_pairs, "right")))
        some = asking[at:end]
        at = end
        x, y = np.repeat(some, times[some]), index[spans(low[some], times[some])]
        apart = np.bitwise_count(rows["s0"][x] ^ rows["s0"][y]).astype(np.int64) + np.bitwise_count(rows["s1"][x] ^ rows["s1"][y])
        need = overlap_needed(size[x], size[y], t)
        ok = apart <= size[x] + size[y] - 2 * need
        x, y, apart, need = x[ok], y[ok], apart[ok], need[ok]
        ok = (np.minimum(size[x] - rows["pos"][x], size[y] - rows["pos"][y]) >= need) & np.logical_or.reduce([rows[c][x] != rows[c][y] for c in LINE_OF])
        if other is not None:
            ok &= other[order][x] != other[order][y]
        x, y, apart = x[ok], y[ok], apart[ok]
        d, th, line = (rows[c] for c in LINE_OF)
        later = (d[x] > d[y]) | (d[x] == d[y]) & ((th[x] > th[y]) | (th[x] == th[y]) & (line[x] > line[y]))
        x, y = np.where(later, x, y), np.where(later, y, x)
        ok = rows["ask"][x] > 0
        x, y, apart = x[ok], y[ok], apart[ok]
        if not len(x):
            continue
        near = np.lexsort((line[y], th[y], d[y], apart, x))
        x, y, apart = x[near], y[near], apart[near]
        head = np.concatenate(([True], x[1:] != x[:-1]))
        of = np.cumsum(head) - 1
        nth = np.arange(len(x)) - np.flatnonzero(head)[of]
        kept = nth < most
        yield _found(int(kept.sum()), token=token[x][kept].astype(np.int64), d=d[x][kept], th=th[x][kept], line=line[x][kept], d2=d[y][kept], th2=th[y][kept], line2=line[y][kept], apart=apart[kept].astype(np.int32), n=np.bincount(of)[of][kept])


def _blocks(rows: Columns, begun: Counter, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of long lists, cut into blocks of ``most`` by size."""
    rows = take(rows, np.lexsort((rows["size"], rows["token"])))
    for token, a, b in runs(rows["token"]):
        for k in range(a, b, most):
            some = take(rows, slice(k, min(k + most, b)))
            yield _found(1, token=[token], block=[begun[token]], lo=[int(some["size"][0])], hi=[int(some["size"][-1])], posts=[POST.pack(some)])
            begun[token] += 1


def candidates(classes: DataFrame, n_posts: int, t: float, most: int = 1, ask: np.ndarray | None = None, lists: np.ndarray | None = None) -> DataFrame:
    """token, d, th, line: a line and the token of a list; d2, th2, line2: an earlier line that passes the filters there
    (of a list the nearest ``most`` by ``apart``, the differing parity bits); n: how many of the list pass.

    ask, lists: cells of the lines that ask, and of the tokens whose lists are read; none: all. The number of
    partitions follows the postings, so that a task holds about ``PART`` of them.
    """
    spark = classes.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_posts // PART))
    shared = spark.sparkContext.broadcast((ask, lists))
    n_pairs, n_block, n_held = PAIRS, BLOCK, HELD

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, lists = shared.value
        for b in batches:
            for block, prefix in zip(buffers(b.column("rows")), buffers(b.column("prefix"))):
                rows, token = LINE.unpack([block]), TOKEN.unpack([prefix])["token"]
                count = rows["count"].astype(np.int64)
                of = np.repeat(np.arange(len(count)), count)
                pos = spans(rows["base"].astype(np.int64), count)
                asks = np.ones(len(count), np.uint8) if ask is None else ask[_cell(*(rows[c] for c in LINE_OF))].astype(np.uint8)
                if lists is not None:
                    some = lists[(token & np.uint32(CELLS - 1)).astype(np.int64)]
                    of, pos, token = of[some], pos[some], token[some]
                part = token % np.uint32(n_parts)
                order = np.argsort(part, kind="stable")
                of = of[order]
                posts = {"token": token[order], "pos": pos[order], "ask": asks[of]} | {c: rows[c][of] for c in (*LINE_OF, "size", "s0", "s1")}
                out = [(k, POST.pack(take(posts, slice(x, y)))) for k, x, y in runs(part[order])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["part", "posts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, begun, long = [], 0, Counter(), np.zeros(0, np.uint32)

        def cut(rows: Columns) -> tuple[Columns, Columns]:
            nonlocal long
            found, times = np.unique(rows["token"], return_counts=True)
            long = np.union1d(long, found[times > n_block])
            away = np.isin(rows["token"], long)
            return take(rows, ~away), take(rows, away)

        for b in batches:
            parts.append(POST.unpack(buffers(b.column("posts"))))
            n += len(parts[-1]["token"])
            if n > n_held:
                rows, away = cut(joined(parts))
                yield from _blocks(away, begun, n_block)
                parts, n = [rows], 0
        if parts:
            rows, away = cut(joined(parts))
            parts.clear()
            yield from _blocks(away, begun, n_block)
            yield from _search(rows, t, most, n_pairs)

    found = narrow(classes.select("rows", "prefix").mapInArrow(deal, "part int, posts binary").repartitionById(n_parts, "part").mapInArrow(run, FOUND), "line-candidates", BLOCK_ROWS)
    pairs = found.where("block is null").drop("block", "lo", "hi", "posts")
    blocks = found.where("block is not null").select("token", "block", "lo", "hi", "posts")
    if blocks.count():
        pairs = pairs.unionByName(narrow(_in_blocks(blocks, t, most), "line-candidates", BLOCK_ROWS))
    return pairs


def _in_blocks(blocks: DataFrame, t: float, most: int) -> DataFrame:
    """Candidates of lists that are cut into blocks: pairs of blocks with sizes in reach of each other are dealt out evenly."""
    n_pairs = PAIRS
    meta = blocks.select("token", "block", "lo", "hi")
    later = meta.select("token", F.col("block").alias("block_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    pairs = meta.join(later, "token").where(f"block <= block_b and hi >= {t} * lo_b - 1e-9 and hi_b >= {t} * lo - 1e-9").select("token", "block", "block_b")
    both = pairs.join(blocks.select("token", "block", "posts"), ["token", "block"])
    both = both.join(blocks.select("token", F.col("block").alias("block_b"), F.col("posts").alias("posts_b")), ["token", "block_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, two, same in zip(b.column("posts"), b.column("posts_b"), b.column("same").to_pylist()):
                rows = [POST.unpack([x.as_buffer()]) for x in ((one,) if same else (one, two))]
                side = None if same else np.repeat([0, 1], [len(x["token"]) for x in rows])
                yield from (x.select(_PAIR) for x in _search(joined(rows), t, most, n_pairs, side))

    return both.select("posts", "posts_b", (F.col("block") == F.col("block_b")).alias("same")).mapInArrow(run, ", ".join(f for f in FOUND.split(", ") if f.split()[0] in _PAIR))


_PAIR = [c for c in _FOUND if c not in ("block", "lo", "hi", "posts")]


PAIR = (*LINE_OF, "d2", "th2", "line2")


def _verified(pairs: DataFrame, docs: DataFrame, t: float) -> DataFrame:
    """d, th, line of the pairs (no pair twice) whose lines' words have Jaccard t or more."""
    n_pairs = pairs.count()
    sides = [pairs.select(*PAIR, F.col(f"d{k}").alias("of_d"), F.col(f"th{k}").alias("of_th"), F.col(f"line{k}").alias("of_line")) for k in ("", "2")]
    asked = sides[0].unionByName(sides[1])
    of_doc = written(asked.groupBy("of_d", "of_th").agg(F.collect_set("of_line").alias("numbers")), "wanted-lines")
    n = of_doc.agg(F.count("*").alias("n"), F.sum(F.size("numbers")).alias("m")).first()
    wanted = maybe_broadcast(of_doc, 16 * n["n"] + (n["m"] or 0), 4)
    texts = docs.join(wanted, (F.col("d") == F.col("of_d")) & (F.col("th") == F.col("of_th"))).select("of_d", "of_th", "text", "numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, number, words = [], [], []
            for k, (text, numbers) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "numbers")))):
                lines = text.split("\n")
                doc += [k] * len(numbers)
                number += numbers
                words += [b" ".join(set(tokens(lines[x]))) for x in numbers]
            doc = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("of_d").take(doc), b.column("of_th").take(doc), pa.array(number, pa.int32()), pa.array(words, pa.binary())], names=["of_d", "of_th", "of_line", "words"])

    words = texts.mapInArrow(run, "of_d long, of_th long, of_line int, words binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_pairs // 50_000)
    both = asked.join(words, ["of_d", "of_th", "of_line"]).select(*PAIR, "words").repartition(parts, *PAIR)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple, bytes] = {}
        for b in batches:
            good = []
            for *pair, x in zip(*(b.column(c).to_pylist() for c in (*PAIR, "words"))):
                y = first.pop(pair := tuple(pair), None)
                if y is None:
                    first[pair] = x
                else:
                    x, y = set(x.split()), set(y.split())
                    shared = len(x & y)
                    if shared >= t * (len(x) + len(y) - shared) - 1e-9:
                        good.append(pair)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in good], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=list(LINE_OF))

    return both.mapInArrow(verify, "d long, th long, line int").distinct()


def repeated_lines(docs: DataFrame, t: float = SIMILARITY, min_tokens: int = MIN_TOKENS, cells: int = CELLS) -> DataFrame:
    """d, th, line of every line to remove; docs: d, th (no pair twice), text (see ``_identity``)."""
    rarity, n_tokens = token_rarity(docs, cells)
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_tokens // TOKENS)
    classes = written(_classes(_dealt_sets(docs, rarity, t, min_tokens, n_parts)), "line-classes")
    n_posts = classes.agg(F.sum("n_posts")).first()[0] or 0
    found = candidates(classes, n_posts, t)
    # a pair shows in a list for each prefix token that it shares: only different pairs are more candidates
    other = F.struct("d2", "th2", "line2")
    best = written(found.groupBy(*LINE_OF).agg(F.min(F.struct("apart", "d2", "th2", "line2")).alias("b"), F.max(other).alias("last"), F.min(other).alias("first"), F.max("n").alias("n")), "nearest-lines")
    good = written(_verified(best.select(*LINE_OF, "b.d2", "b.th2", "b.line2"), docs, t), "similar-lines")
    out = _places(classes.select("again")).unionByName(good)
    left = written(best.where("n > 1 or first != last").select(*LINE_OF).join(good, [*LINE_OF], "left_anti"), "open-lines")
    most = WIDER
    while n_left := left.count():
        few = maybe_broadcast(left, n_left, 24)
        lists = _cells(found.join(few, [*LINE_OF], "left_semi").select("token"), lambda b: b.column(0).to_numpy() & (CELLS - 1))
        ask = _cells(left, lambda b: _cell(*(b.column(c).to_numpy() for c in LINE_OF)))
        found = candidates(classes, n_posts, t, most, ask, lists).join(few, [*LINE_OF], "left_semi")
        good = written(_verified(written(found.select(*PAIR).distinct(), "line-pairs"), docs, t), "similar-lines")
        out = out.unionByName(good)
        left = written(found.where(F.col("n") > most).select(*LINE_OF).distinct().join(good, [*LINE_OF], "left_anti"), "open-lines")
        most *= WIDER
    return out.distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "deduped", t: float = SIMILARITY, min_tokens: int = MIN_TOKENS, cells: int = CELLS, digest: bool = False) -> DataFrame:
    """Adds ``deduped`` (the text without its repeated lines), n_lines, n_removed and removed_lines (their numbers from 0).

    Lines are ordered by id, then line number; the first one of similar lines
    stays. Lines of fewer than ``min_tokens`` words stay. Null texts count as
    empty; null ids come first. Rows with one id and equal texts are one
    document: both lose the same lines. Input columns named like added ones are replaced.
    With ``digest`` the sha256 of the text is added instead of the text.
    An empty table gives an empty result. A very long text is split into lines
    by one task; a very long line is one set of words, joined like any other.
    """
    small_batches(docs.sparkSession)
    d, th, repeated = _identity(docs, id_col, text_col)
    known = docs.select(d.alias("d"), th.alias("th"), text_or_empty(text_col).alias("text"))
    if repeated:
        known = known.dropDuplicates(["d", "th"])
    added = (out_col, "n_lines", "n_removed", "removed_lines")
    keep = [c for c in docs.columns if c not in added]
    own_d, own_th, own_text, gone_d, gone_th, gone_lines = unused(docs.columns, "d", "th", "text", "gone_d", "gone_th", "gone_lines")
    with passing():
        removed = repeated_lines(known, t, min_tokens, cells).groupBy("d", "th").agg(F.sort_array(F.collect_list("line")).alias("lines"))
        of_doc = written(removed.select(F.col("d").alias(gone_d), F.col("th").alias(gone_th), F.col("lines").alias(gone_lines)), "repeated-lines", True)
    size = of_doc.agg(F.count("*").alias("n"), F.sum(F.size(gone_lines)).alias("m")).first()
    source = docs.select(*keep, d.alias(own_d), th.alias(own_th), text_or_empty(text_col).alias(own_text))
    joined_rows = source.join(maybe_broadcast(of_doc, 16 * size["n"] + (size["m"] or 0), 4), (F.col(own_d) == F.col(gone_d)) & (F.col(own_th) == F.col(gone_th)), "left")
    source = joined_rows.select(*keep, own_text, gone_lines)
    schema = docs.select(*keep).schema.add(out_col, "string").add("n_lines", "long").add("n_removed", "long").add("removed_lines", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_removed, removed = [], [], [], []
            for text, gone in zip(b.column(own_text).to_pylist(), b.column(gone_lines).to_pylist()):
                n_lines.append(text.count("\n") + 1)
                n_removed.append(len(gone or ()))
                removed.append(",".join(map(str, gone or ())))
                if gone:
                    out = set(gone)
                    text = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in out])
                texts.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.string())], names=[*keep, *added])

    return source.mapInArrow(run, schema)


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines and the digest of what is left of every document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return dedup_lines(source, out_col="deduped_sha256", min_tokens=ALL_LINES, digest=True).select("doc_id", "n_lines", "n_removed", "removed_lines", "deduped_sha256")
