"""Packing into optimal length buckets.

Texts are counted in tokens; longer ones than a sequence are cut into whole
sequences and a rest. The global histogram of lengths, which has at most one
entry for each length up to the sequence's, goes to a dynamic programme that
chooses the buckets' upper bounds with the least padding in total. Inside each
bucket, rows form batches under a token budget. Rows of a bucket are dealt to
slices by hash, so that no bucket, however common its lengths are, is numbered
by one task; a slice ends with at most one batch that isn't full.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm import bpe
from panelforge.llm.common import small_batches, text_or_empty, unused, written

SEQUENCE, BUCKETS, BUDGET = 2048, 8, 65_536
#: Rows of a slice, so that a task's share doesn't grow with the input.
SLICE_ROWS = 50_000
#: Code points from which a text is counted piece by piece, to bound the counting library's stack and backtracking.
LONG_TEXT = 200_000


def best_bounds(histogram: dict[int, int], n_buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least sum of (bound - length); ties take the fewest, lowest bounds."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return []
    n = np.array([histogram[int(k)] for k in lengths], np.int64)
    count, total = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * lengths)))
    # padding of one bucket over lengths i to j - 1, whose bound is the last of them
    cost = lengths[None, :] * (count[None, 1:] - count[:-1, None]) - (total[None, 1:] - total[:-1, None])
    m = len(lengths)
    big = np.iinfo(np.int64).max // 4
    cost = np.where(np.arange(m)[:, None] <= np.arange(m)[None, :], cost, big)
    best, back = [cost[0]], [np.zeros(m, np.int64)]
    for _ in range(min(n_buckets, m) - 1):
        whole = np.concatenate(([big], best[-1][:-1]))[:, None] + cost
        back.append(whole.argmin(0))
        best.append(np.minimum(whole.min(0), big))
    k = int(np.argmin([b[-1] for b in best]))
    bounds, j = [], m - 1
    while True:
        bounds.append(int(lengths[j]))
        if not k:
            return bounds[::-1]
        j, k = int(back[k][j]) - 1, k - 1


def padding(histogram: dict[int, int], bounds: list[int]) -> int:
    return sum(n * (min(b for b in bounds if b >= k) - k) for k, n in histogram.items())


class Counter:
    """Token counts of a byte-level vocabulary of ranks; strings of special tokens are ordinary text."""

    def __init__(self, ranks: bytes):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})

    def count(self, text: str) -> int:
        if len(text) <= LONG_TEXT:
            return len(self.encoding.encode_ordinary(text))
        return sum(len(self.encoding.encode_ordinary(m[0])) for m in WORDS.finditer(text))


WORDS = bpe.regex.compile(bpe.PATTERN)
_LOADED: dict = {}


def _counter(shared) -> Counter:
    if _LOADED.get("file") != shared.value:
        _LOADED.update(file=shared.value, counter=Counter(shared.value))
    return _LOADED["counter"]


def token_counts(docs: DataFrame, ranks_path: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each whole text and drops the text. Null and empty texts: 0."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = bpe.share_tokenizer(spark, ranks_path)
    keep = [c for c in docs.columns if c not in (count_col, text_col)]
    (own,) = unused(docs.columns, "own_text")
    source = docs.select(*keep, text_or_empty(text_col).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _counter(shared).count
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([of(t) for t in b.column(own).to_pylist()], pa.int64())], names=[*keep, count_col])

    return source.mapInArrow(run, docs.select(*keep).schema.add(count_col, T.LongType()))


def pack(lengths: DataFrame, id_col: str = "doc_id", count_col: str = "n_tokens", sequence: int = SEQUENCE, n_buckets: int = BUCKETS, budget: int = BUDGET, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, segment, n_tokens, bucket (from 0), width (its bound), batch (``bucket-slice-number``), slot (from 0) of every segment.

    A row of 0 tokens (also null counts) is one segment of 0. A batch has at
    most ``budget // width`` rows, one at least. Repeated rows are packed each;
    null ids are packed like others. An empty table gives none.
    """
    n = F.greatest(F.coalesce(F.col(count_col).cast("long"), F.lit(0)), F.lit(0))
    whole = F.floor((F.greatest(n, F.lit(1)) - 1) / sequence)
    cut = lengths.select(F.col(id_col).alias("doc_id"), n.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), whole)).alias("segment"))
    segments = cut.select("doc_id", "segment", F.least(F.lit(sequence).cast("long"), F.col("__n") - F.col("segment") * sequence).alias("n_tokens"))
    histogram = {r["n_tokens"]: r["count"] for r in segments.groupBy("n_tokens").count().collect()}  # at most sequence + 1 rows
    bounds = best_bounds(histogram, n_buckets) or [sequence]
    bucket = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(bucket)
    n_slices = max(1, -(-sum(histogram.values()) // slice_rows))
    part = F.pmod(F.xxhash64("doc_id", "segment"), F.lit(n_slices)).cast("int")
    width = F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1).cast("long")
    rows = segments.select("*", bucket.alias("bucket"), part.alias("part"))
    place = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "segment")) - 1
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("width"), F.lit(1))))
    placed = rows.select("*", width.alias("width"), place.cast("long").alias("place"))
    return placed.select("doc_id", "segment", "n_tokens", "bucket", "width", F.concat_ws("-", "bucket", "part", F.floor(F.col("place") / room)).alias("batch"), F.pmod("place", room).alias("slot"))


def pack_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Counts tokens of every whole text once, writes the counts, and packs them.

    A very long text is counted whole, in its task, and its tokens fill as many segments as they need.
    """
    counts = token_counts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ranks_path)
    return pack(written(counts, "token-counts"), **options)
