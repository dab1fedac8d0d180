"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

A pre-token's parts lie in one list and the ranks of its adjacent pairs in
another of the same order. Merging scans the ranks for the minimum (the
leftmost one of equals), deletes the boundary there and refreshes the two
neighbouring ranks. Pre-tokens of over ``LONG`` bytes keep the same order of
merges in a heap over a linked list, so that a very long run stays n log n.

The new words of a batch are merged together: their parts and ranks are the
rows of two matrices, and each step scans every row for its minimum, deletes
one boundary a row and refreshes the neighbours. White-space chunks repeat, so
their ids are cached in two generations of a fixed size: memory is bounded
whatever the vocabulary of a corpus.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import small_batches, text_or_empty, unused

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 200
#: Bytes of the words that are merged together, by width of their matrix.
WIDTHS = (8, 16, 32)
#: Marks that end a word without any other rule of the pattern applying.
ENDS = frozenset(".,;:!?")
CACHE = 150_000
NEVER = 1 << 30


class Irregular(Exception):
    """A text whose white space is not single blanks and line ends between words."""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of a byte-level BPE tokenizer file's bytes."""

    def __init__(self, tokenizer_json: bytes, cache: int = CACHE):
        spec = json.loads(tokenizer_json)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.pair_rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pair_rank.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.of_byte = [0] * 256
        self.id_bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            known = all(c in letters for c in token)
            self.id_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
            if known and len(token) == 1:
                self.of_byte[letters[token]] = i
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.id_bytes[i] = token.encode()
        self.id_text = [str(i) for i in range(len(self.id_bytes))]
        self.words = regex.compile(PATTERN)
        self.at_special = regex.compile("|".join(sorted(map(regex.escape, self.special), key=len, reverse=True))) if self.special else None
        self.pieces, self.limit = _Kept(cache), cache
        self.after_blank, self.bare = _Chunks(self, " "), _Chunks(self, "")
        order = sorted(self.pair_rank)
        self.pairs, self.pair_ranks = np.array(order, np.int64), np.array([self.pair_rank[k] for k in order], np.int32)
        self.merged_of = np.array(self.merged, np.int32)
        ids = np.array(self.of_byte, np.int64)
        self.byte_of = ids.astype(np.int32)
        self.byte_ranks = self.ranks_of(np.repeat(ids, 256), np.tile(ids, 256)).reshape(256, 256)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if len(piece) > LONG:
            return self._merge_long(piece)
        of, parts = self.pair_rank.get, [self.of_byte[b] for b in piece]
        ranks = [of(a << 20 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            at = ranks.index(low)
            parts[at] = self.merged[low]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = of(parts[at] << 20 | parts[at + 1], NEVER)
            if at:
                ranks[at - 1] = of(parts[at - 1] << 20 | parts[at], NEVER)
        return parts

    def _merge_long(self, piece: bytes) -> list[int]:
        of, n = self.pair_rank.get, len(piece)
        parts, left, right = [self.of_byte[b] for b in piece], list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := of(parts[i] << 20 | parts[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if parts[i] < 0 or j >= n or of(parts[i] << 20 | parts[j], NEVER) != rank:
                continue
            parts[i], parts[j], right[i] = self.merged[rank], -1, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := of(parts[i] << 20 | parts[right[i]], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, i))
            if (k := left[i]) >= 0 and (r := of(parts[k] << 20 | parts[i], NEVER)) != NEVER:
                heapq.heappush(heap, (r, k))
        return [p for p in parts if p >= 0]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; NEVER where a pair doesn't merge."""
        keys = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], NEVER).astype(np.int32)

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of many words of at most WIDTHS[-1] bytes, by rows of a matrix."""
        out: list[tuple[int, ...]] = [()] * len(words)
        for low, width in zip((0, *WIDTHS), WIDTHS):
            which = [k for k, w in enumerate(words) if low < len(w) <= width]
            if not which:
                continue
            raw = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in which), np.uint8).reshape(-1, width)
            size = np.array([len(words[k]) for k in which])
            parts = np.where(np.arange(width) < size[:, None], self.byte_of[raw], -1)
            ranks = np.full(parts.shape, NEVER, np.int32)
            ranks[:, :-1] = np.where(np.arange(1, width) < size[:, None], self.byte_ranks[raw[:, :-1], raw[:, 1:]], NEVER)
            rows, columns = np.array(which), np.arange(width)
            while len(rows):
                at = ranks.argmin(1)
                each = np.arange(len(rows))
                least = ranks[each, at]
                if (done := least == NEVER).any():
                    for k, ids, n in zip(rows[done].tolist(), parts[done].tolist(), (parts[done] >= 0).sum(1).tolist()):
                        out[k] = tuple(ids[:n])
                    more = ~done
                    rows, parts, ranks, at, least = rows[more], parts[more], ranks[more], at[more], least[more]
                    each = each[: len(rows)]
                    if not len(rows):
                        break
                parts[each, at] = self.merged_of[least]
                parts = np.take_along_axis(parts, np.minimum(columns + (columns > at[:, None]), width - 1), 1)
                ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= at[:, None]), width - 1), 1)
                parts[:, -1], ranks[:, -1] = -1, NEVER
                for here, there in ((at, at + 1), (at - 1, at)):
                    a, b = parts[each, here], parts[each, np.minimum(there, width - 1)]
                    ok = (here >= 0) & (b >= 0) & (there < width)
                    ranks[each[ok], here[ok]] = self.ranks_of(a[ok], b[ok])
        return out

    def warm(self, texts: list[str]) -> None:
        """Merges all new words of a batch of texts at once."""
        blank: set[str] = set()
        bare: set[str] = set()
        for text in texts:
            for line in text.split("\n"):
                first, _, rest = line.partition(" ")
                bare.add(first)
                if rest:
                    blank.update(rest.split(" "))
        new: set[str] = set()
        plans = []
        for chunks, kept in ((blank, self.after_blank), (bare, self.bare)):
            for chunk in chunks.difference(kept, kept.older):
                if chunk.isalpha():
                    pieces = [kept.before + chunk]
                elif chunk[-1:] in ENDS and chunk[:-1].isalpha():
                    pieces = [kept.before + chunk[:-1], chunk[-1]]
                elif chunk.split() == [chunk]:
                    pieces = self.words.findall(kept.before + chunk)
                else:
                    continue
                new.update(pieces)
                plans.append((kept, chunk, pieces))
        todo = [(p, w) for p in new.difference(self.pieces, self.pieces.older) if len(w := p.encode()) <= WIDTHS[-1]]
        fresh = dict(zip([p for p, _ in todo], self.merge_many([w for _, w in todo])))
        for piece, ids in fresh.items():
            self.pieces.put(piece, ids)
        for kept, chunk, pieces in plans:
            kept.put(chunk, fresh.get(pieces[0]) or self.piece_ids(pieces[0]) if len(pieces) == 1 else tuple(chain.from_iterable(fresh.get(p) or self.piece_ids(p) for p in pieces)))

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        return self.pieces.get(piece) or self.pieces.again(piece) or self.pieces.put(piece, tuple(self.merge(piece.encode())))

    def chunks(self, text: str) -> list[tuple[int, ...]]:
        """The ids of each white-space chunk and line end, in order, of a text without special tokens."""
        out: list[tuple[int, ...]] = []
        try:
            for n, line in enumerate(text.split("\n")):
                if n:
                    out.append(self.line_end)
                first, _, rest = line.partition(" ")
                out.append(self.bare[first])
                if rest or _:
                    out.extend(map(self.after_blank.__getitem__, rest.split(" ")))
            return out
        except Irregular:
            return list(map(self.piece_ids, self.words.findall(text)))

    @property
    def line_end(self) -> tuple[int, ...]:
        return self.piece_ids("\n")

    def encode(self, text: str) -> list[int]:
        """As the library's encode(text, add_special_tokens=False): special tokens in a text count as such."""
        if not text:
            return []
        if self.at_special is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(self.chunks(text)))
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += self.encode_plain(text[at : m.start()]) + [self.special[m[0]]]
            at = m.end()
        return out + self.encode_plain(text[at:])

    def encode_plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.chunks(text))) if text else []

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        return b"".join(map(self.id_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def ids_text(self, ids: list[int]) -> str:
        return ",".join(map(self.id_text.__getitem__, ids))


class _Kept(dict):
    """Cache in two generations: at the limit the younger one becomes the older, so that what is in use stays."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def put(self, key: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(key) <= 40:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids

    def again(self, key: str) -> tuple[int, ...] | None:
        ids = self.older.get(key)
        return ids and self.put(key, ids)


class _Chunks(_Kept):
    """Ids by white-space chunk; computes what is missing."""

    def __init__(self, bpe: ByteBPE, before: str):
        super().__init__(bpe.limit)
        self.bpe, self.before = bpe, before

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if found := self.again(chunk):
            return found
        if chunk.split() != [chunk]:
            raise Irregular
        pieces = self.bpe.words.findall(self.before + chunk)
        return self.put(chunk, tuple(chain.from_iterable(map(self.bpe.piece_ids, pieces))))


_LOADED: dict = {}


def loaded(shared) -> ByteBPE:
    """A worker's encoder of a broadcast tokenizer file, built once per process."""
    data = shared.value
    if _LOADED.get("file") != data:
        _LOADED.update(file=data, bpe=ByteBPE(data))
    return _LOADED["bpe"]


def share_tokenizer(spark, path: str):
    """Broadcasts a tokenizer file (1.6 MB, independent of the corpus), so that executors need no local copy."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids`` (array of int): the token ids of each whole text. Null and empty texts have no ids."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = share_tokenizer(spark, tokenizer_path)
    keep = [c for c in docs.columns if c != ids_col]
    (own,) = unused(docs.columns, "own_text")
    source = docs.select(*keep, text_or_empty(text_col).alias(own))
    schema = docs.select(*keep).schema.add(ids_col, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared)
        for b in batches:
            bpe.warm(texts := b.column(own).to_pylist())
            ids = pa.array([bpe.encode(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), ids], names=[*keep, ids_col])

    return source.mapInArrow(run, schema)


def bpe_decode(ids: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the text of each list of ids; null lists give empty texts, broken UTF-8 the replacement sign."""
    spark = ids.sparkSession
    small_batches(spark)
    shared = share_tokenizer(spark, tokenizer_path)
    keep = [c for c in ids.columns if c != text_col]
    schema = ids.select(*keep).schema.add(text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared)
        for b in batches:
            texts = pa.array([bpe.decode(x or []) for x in b.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), texts], names=[*keep, text_col])

    return ids.select(*keep).mapInArrow(run, schema)


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded in one pass.

    Null texts count as empty: no tokens and the digests of the empty string.
    Null or repeated ids are passed on row by row; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = share_tokenizer(spark, tokenizer_path)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared)
        for b in batches:
            n, of_ids, of_text = [], [], []
            bpe.warm(texts := b.column("text").to_pylist())
            for text in texts:
                ids = bpe.encode(text)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(bpe.ids_text(ids).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
