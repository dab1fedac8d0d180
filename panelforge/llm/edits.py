"""Edit-aware token counts.

A document's pre-tokens, gathered to white-space chunks, are the leaves of a
segment tree that sums code points and tokens. An edit re-encodes from the last
leaf that it can't reach (``CONTEXT`` code points before it) to the first old
leaf boundary behind it at which the new pre-tokens meet the old ones: the
pre-tokenizer looks no further ahead than that and never back, so all other
leaves stay as they are. Only the touched blocks' sums and those of their
ancestors are updated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm import bpe
from panelforge.llm.common import small_batches, text_or_empty, unused

#: The pattern looks at most two code points behind a pre-token's end; one more is left as room.
CONTEXT = 3
#: Leaves of a block, the tree's lowest node; a block that has grown to four times as many is split anew.
BLOCK = 64


class Sums:
    """Segment tree over blocks: sums of code points and tokens, in arrays of twice the number of blocks."""

    def __init__(self, sizes: list[int], counts: list[int]):
        self.n = max(1, len(sizes))
        self.sizes, self.counts = [0] * self.n + (sizes or [0]), [0] * self.n + (counts or [0])
        for k in range(self.n - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.sizes[k] = self.sizes[2 * k] + self.sizes[2 * k + 1]
        self.counts[k] = self.counts[2 * k] + self.counts[2 * k + 1]

    def put(self, block: int, size: int, count: int) -> None:
        k = block + self.n
        self.sizes[k], self.counts[k] = size, count
        while k > 1:
            k //= 2
            self._sum(k)

    def totals(self) -> tuple[int, int]:
        return (self.sizes[1], self.counts[1])

    def before(self, block: int) -> int:
        """Code points of the blocks before this one."""
        lo, hi, out = self.n, block + self.n, 0
        while lo < hi:
            if lo & 1:
                out += self.sizes[lo]
                lo += 1
            if hi & 1:
                hi -= 1
                out += self.sizes[hi]
            lo, hi = lo // 2, hi // 2
        return out

    def block_at(self, at: int) -> int:
        """The block that holds code point ``at``, or the last one."""
        lo, hi = 0, self.n - 1
        while lo < hi:  # n log n steps over prefix sums of the tree
            mid = (lo + hi) // 2
            if self.before(mid + 1) > at:
                hi = mid
            else:
                lo = mid + 1
        return lo


class TokenTree:
    """A text with its leaves' lengths and token counts."""

    def __init__(self, encoder: bpe.ByteBPE, text: str):
        self.encoder, self.text = encoder, text
        self.encoded = 0
        self._plant(*leaves(encoder, text))

    def _plant(self, sizes: list[int], counts: list[int]) -> None:
        self.blocks = [(sizes[k : k + BLOCK], counts[k : k + BLOCK]) for k in range(0, len(sizes), BLOCK)] or [([], [])]
        self.sums = Sums([sum(s) for s, _ in self.blocks], [sum(c) for _, c in self.blocks])

    @property
    def n_tokens(self) -> int:
        return self.sums.totals()[1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces code points ``start`` to ``end`` (cut to the text's length) by ``new``; ``encoded`` counts what was re-encoded."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        first = self.sums.block_at(max(0, start - CONTEXT))
        at = self.sums.before(first)
        keep = 0  # leaves of the first block that end before the edit can reach them
        sizes = self.blocks[first][0]
        restart = at
        while keep < len(sizes) and restart + sizes[keep] <= start - CONTEXT:
            restart += sizes[keep]
            keep += 1
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        # old boundaries at or behind the edit's end, block by block, until the new pre-tokens meet one
        last, pos = first, at
        bounds: dict[int, tuple[int, int]] = {}

        def read(block: int, pos: int) -> int:
            for k, size in enumerate(self.blocks[block][0]):
                if pos >= end:
                    bounds[pos + shift] = (block, k)
                pos += size
            return pos

        pos = read(last, pos)
        new_sizes, new_counts = [], []
        meets, done = None, restart
        for m in self.encoder.words.finditer(self.text, restart):
            while pos + shift <= m.start() and last + 1 < len(self.blocks):
                last += 1
                pos = read(last, pos)
            if m.start() in bounds:
                meets = bounds[m.start()]
                break
            new_sizes.append(m.end() - m.start())
            new_counts.append(len(self.encoder.piece_ids(m[0])))
            done = m.end()
        self.encoded += done - restart
        head = self.blocks[first]
        tail_block, tail_leaf = meets or (len(self.blocks) - 1, len(self.blocks[-1][0]))
        tail = self.blocks[tail_block]
        merged = (head[0][:keep] + new_sizes + tail[0][tail_leaf:], head[1][:keep] + new_counts + tail[1][tail_leaf:])
        if len(merged[0]) > 4 * BLOCK:
            rest = [*self.blocks[:first], merged, *self.blocks[tail_block + 1 :]]
            self._plant([x for s, _ in rest for x in s], [x for _, c in rest for x in c])
            return
        self.blocks[first] = merged
        self.sums.put(first, sum(merged[0]), sum(merged[1]))
        for k in range(first + 1, tail_block + 1):
            self.blocks[k] = ([], [])
            self.sums.put(k, 0, 0)


def leaves(encoder: bpe.ByteBPE, text: str) -> tuple[list[int], list[int]]:
    """Code points and tokens of each white-space chunk, or of each pre-token where white space isn't regular."""
    if not text:
        return [], []
    sizes: list[int] = []
    counts: list[int] = []
    blank, bare = encoder.after_blank, encoder.bare
    try:
        for n, line in enumerate(text.split("\n")):
            if n:
                sizes.append(1)
                counts.append(len(encoder.line_end))
            first, gap, rest = line.partition(" ")
            sizes.append(len(first))
            counts.append(len(bare[first]))
            if gap:
                chunks = rest.split(" ")
                sizes += [len(c) + 1 for c in chunks]
                counts += map(len, map(blank.__getitem__, chunks))
        return sizes, counts
    except bpe.Irregular:
        pieces = encoder.words.findall(text)
        return list(map(len, pieces)), [len(encoder.piece_ids(p)) for p in pieces]


def count_edited(docs: DataFrame, tokenizer_path: str, edits_col: str = "edits", text_col: str = "text") -> DataFrame:
    """Replaces text and edits by n_chars, n_tokens, n_tokens_edited, n_encoded (code points re-encoded).

    edits: array of (start, end, new) in code points, applied one after the
    other to the text as it then is; null edits, bounds outside the text (cut to
    it) and null ``new`` (nothing) are allowed. Null texts count as empty.
    Strings of special tokens are ordinary text. Rows are judged on their own:
    repeated ones get the same counts, an empty table gives none. A very long
    text is held whole by its task, with one tree; input columns named like
    added ones are replaced, all others are passed on.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = bpe.share_tokenizer(spark, tokenizer_path)
    added = ("n_chars", "n_tokens", "n_tokens_edited", "n_encoded")
    keep = [c for c in docs.columns if c not in (*added, edits_col, text_col)]
    own, own_edits = unused(docs.columns, "own_text", "own_edits")
    source = docs.select(*keep, text_or_empty(text_col).alias(own), F.col(edits_col).alias(own_edits))
    schema = docs.select(*keep).schema
    for c in added:
        schema = schema.add(c, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.loaded(shared)
        for b in batches:
            rows = []
            encoder.warm(texts := b.column(own).to_pylist())
            for text, edits in zip(texts, b.column(own_edits).to_pylist()):
                tree = TokenTree(encoder, text)
                before = tree.n_tokens
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["start"] or 0 if e["end"] is None else e["end"], e["new"] or "")
                rows.append((len(text), before, tree.n_tokens, tree.encoded))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))], names=[*keep, *added])

    return source.mapInArrow(run, schema)


def revised_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, n_tokens_edited, n_encoded of every document under three edits that each revision makes:
    a word put in at a quarter, 24 code points taken out at the middle, the last 12 replaced by a date."""
    n = F.length(text_or_empty("text"))

    def edit(start, end, new: str):
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(new).alias("new"))

    middle = F.floor(n / 2)
    edits = F.array(edit(F.floor(n / 4), F.floor(n / 4), " [revised] "), edit(middle, middle + 24, ""), edit(F.greatest(n - 12, F.lit(0)), n, "on 2024-01-31."))
    return count_edited(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", edits.alias("edits")), tokenizer_path)
