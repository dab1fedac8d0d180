"""Document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes; a chunk ends where its low bits are
zero: with more bits before the normal size and fewer after it (normalised
chunking), never before the least and always at the most size. A boundary
depends on the 32 bytes before it only, so an insertion moves boundaries near
it and no others. A fingerprint is the set of the chunks' digests with their
lengths; likeness is the length of the shared part by that of the smaller or
of both fingerprints.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import small_batches, text_or_empty, unused

LEAST, NORMAL, MOST = 32, 96, 512
#: Low bits of the gear hash that must be zero before and after the normal size.
STRICT_BITS, LOOSE_BITS = 7, 5
#: Bytes that are hashed at a time; it bounds memory for very long texts.
BLOCK = 1 << 20
#: Bytes that the 32-bit gear hash looks back.
WINDOW = 32


def gear_table(seed: str = "gear") -> np.ndarray:
    """A 32-bit number for each byte, from a rule: the head of sha256 of seed and byte."""
    return np.array([int.from_bytes(hashlib.sha256(f"{seed}:{b}".encode()).digest()[:4], "big") for b in range(256)], np.uint32)


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of the last 32 bytes' numbers, each shifted left by its age."""
    h, step = GEAR[data], 1
    while step < WINDOW:  # doubles the window: h over 2 * step bytes from two over step bytes
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def candidate_cuts(data: bytes) -> tuple[list[int], list[int]]:
    """Ends (exclusive) of possible chunks under the strict and the loose mask, in order."""
    raw = np.frombuffer(data, np.uint8)
    strict, loose = [], []
    for at in range(0, len(raw), BLOCK):
        before = min(at, WINDOW)
        h = gear_hashes(raw[at - before : at + BLOCK])[before:]
        ends = np.flatnonzero((h & np.uint32((1 << LOOSE_BITS) - 1)) == 0)
        loose += (ends + at + 1).tolist()
        strict += (ends[(h[ends] & np.uint32((1 << STRICT_BITS) - 1)) == 0] + at + 1).tolist()
    return strict, loose


def chunk_ends(n: int, strict: list[int], loose: list[int], first: int = 0) -> list[int]:
    """The ends of the chunks of bytes ``first`` to ``n``, given possible cuts."""
    ends, start = [], first
    while start < n:
        most = min(start + MOST, n)
        end = most
        k = bisect_left(strict, start + LEAST)
        if k < len(strict) and strict[k] < min(start + NORMAL, most):
            end = strict[k]
        else:
            k = bisect_left(loose, start + NORMAL)
            if k < len(loose) and loose[k] < most:
                end = loose[k]
        ends.append(end)
        start = end
    return ends


def fingerprint(text: str) -> dict[int, int]:
    """Chunk digest (64 bits) -> bytes of its chunk; a repeated chunk counts once. Empty: no chunks."""
    data = text.encode()
    return _chunks_of(data, *candidate_cuts(data))


def _chunks_of(data: bytes, strict: list[int], loose: list[int]) -> dict[int, int]:
    ends = chunk_ends(len(data), strict, loose)
    of = xxhash.xxh3_64_intdigest
    return {of(data[a:b]): b - a for a, b in zip([0, *ends], ends)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Containment of the smaller one: shared chunks' length by the smaller total (0 to 1); two empty ones: 1, one: 0."""
    least = min(sum(a.values()), sum(b.values()))
    return sum(a[k] for k in a.keys() & b.keys()) / least if least else float(not a and not b)


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Length of the shared chunks by the length of ``a``'s (0 to 1): how much of ``a`` is in ``b``; an empty ``a``: 1."""
    own = sum(a.values())
    return sum(a[k] for k in a.keys() & b.keys()) / own if own else 1.0


def shown(fp: dict[int, int]) -> str:
    """Text form: digest:length of each chunk in the order of digests."""
    return " ".join([f"{k:016x}:{n}" for k, n in sorted(fp.items())])


def read(text: str) -> dict[int, int]:
    return {int(k, 16): int(n) for k, _, n in (x.partition(":") for x in text.split())}


def fingerprints(docs: DataFrame, text_col: str = "text", fp_col: str = "fingerprint") -> DataFrame:
    """Adds each whole text's fingerprint in its text form. Null and empty texts: the empty string."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != fp_col]
    (own,) = unused(docs.columns, "own_text")
    source = docs.select(*keep, text_or_empty(text_col).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([shown(fingerprint(t)) for t in b.column(own).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fp], names=[*keep, fp_col])

    return source.mapInArrow(run, docs.select(*keep).schema.add(fp_col, "string"))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many (or all) of the following text's first ones."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


def _compare(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows (range, own, doc_id, text) in order -> results; a range's last row is the first one of the next range."""
    last = None
    for place, own, doc_id, text in rows:
        fp = fingerprint(text)
        if last and last[0] == place:
            yield _result(last, text, fp)
        last = (place, doc_id, text, fp) if own else None


def _result(last: tuple, following: str, next_fp: dict[int, int]) -> tuple:
    _, doc_id, text, fp = last
    new = edited(text, following)
    new_fp = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), shown(fp), shown(new_fp), likeness(fp, new_fp), likeness(fp, next_fp)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows of a range of ids, and most ranges: beyond 80 million rows ranges grow, and are streamed and sorted with spilling as any.
RANGE_ROWS, RANGES = 4096, 20_000


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (see ``edited``), and their likenesses.

    The next document is that of the next id; after the last comes the first.
    Ids are dealt to ranges; each range also gets the first document of the
    next one, so texts are shuffled once and a task is one range, read as a
    stream. Two ids for each range, of at most ``RANGES``, reach the driver.
    Null texts count as empty. Rows with a null id come first. Of rows with the
    same id, which are one range, texts in order follow each other, repeated rows
    too. A single row follows itself. An empty table gives none. Very long texts
    are hashed in blocks. Columns besides id and text aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    n = source.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    n_ranges = min(-(-n // range_rows), RANGES)
    shares = [k / n_ranges for k in range(1, n_ranges)]
    cuts = np.unique(source.agg(F.percentile_approx(order, shares, 100 * n_ranges).alias("c")).first()["c"] if shares else np.empty(0, np.int64)).astype(np.int64)
    place = _place(spark.sparkContext.broadcast(cuts), None)
    first = source.select(order.alias("o")).groupBy(place("o").alias("place")).agg(F.min("o").alias("first")).orderBy("place").collect()
    # the first document of a range also closes the range before it, that of the first one closes the last
    closes = {r["first"]: first[i - 1]["place"]["own"] for i, r in enumerate(first)}
    place = _place(spark.sparkContext.broadcast(cuts), spark.sparkContext.broadcast(closes))
    placed = source.withColumn("p", place(order))
    dealt = placed.select("doc_id", "text", F.explode(F.when(F.col("p.closes").isNull(), F.array("p.own")).otherwise(F.array("p.own", -1 - F.col("p.closes")))).alias("place"))
    own = F.col("place") >= 0
    dealt = dealt.select("doc_id", "text", own.alias("own"), F.when(own, F.col("place")).otherwise(-1 - F.col("place")).alias("place"))
    ordered = dealt.repartitionById(n_ranges, "place").sortWithinPartitions("place", F.col("own").desc(), order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("place", "own", "doc_id", "text")))

        kinds, names = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], [f.split()[0] for f in RESULT.split(", ")]
        out: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

        for r in _compare(rows()):
            out.append(r)
            if len(out) >= 256:
                yield batch()
                out.clear()
        yield batch()

    return ordered.mapInArrow(run, RESULT)


def _place(cuts, closes):
    """The range of an id, and the range that it closes as the first id of the next one (null for most)."""

    @F.pandas_udf("own int, closes int")
    def place(ids: pd.Series) -> pd.DataFrame:
        also = closes.value if closes else {}
        return pd.DataFrame({"own": np.searchsorted(cuts.value, ids.to_numpy(), "right").astype(np.int32), "closes": pd.array([also.get(i) for i in ids], "Int32")})

    return place
