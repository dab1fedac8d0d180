"""Rows of numbers as blocks of columns in one binary value, so that a shuffle moves few rows.

A block holds each column's bytes by place (all first bytes, then all second
ones), in which small numbers compress well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

Columns = dict[str, np.ndarray]


class Layout:
    """The fixed columns of a kind of blocks, by name and type."""

    def __init__(self, **kinds: str):
        self.kinds = {name: np.dtype(kind) for name, kind in kinds.items()}
        self.width = sum(kind.itemsize for kind in self.kinds.values())

    def pack(self, rows: Columns) -> bytes:
        return b"".join(_planes(np.ascontiguousarray(rows[name], kind)) for name, kind in self.kinds.items())

    def unpack(self, blocks: Iterable) -> Columns:
        """The rows of all blocks (bytes or buffers) one after the other."""
        parts: dict[str, list[np.ndarray]] = {name: [np.zeros(0, kind)] for name, kind in self.kinds.items()}
        for block in blocks:
            data, at = np.frombuffer(block, np.uint8), 0
            n = len(data) // self.width
            for name, kind in self.kinds.items():
                end = at + n * kind.itemsize
                parts[name].append(np.ascontiguousarray(data[at:end].reshape(kind.itemsize, n).T).view(kind).reshape(n))
                at = end
        return {name: np.concatenate(x) for name, x in parts.items()}


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b""


def buffers(column: pa.Array) -> Iterator[pa.Buffer]:
    """The values of a binary column, without copies; nulls are left out."""
    for x in column:
        if x.is_valid:
            yield x.as_buffer()


def take(rows: Columns, which) -> Columns:
    return {name: x[which] for name, x in rows.items()}


def joined(parts: list[Columns]) -> Columns:
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def runs(sorted_ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of each run of equal numbers."""
    if len(sorted_ids):
        begins = np.concatenate(([0], np.flatnonzero(sorted_ids[1:] != sorted_ids[:-1]) + 1, [len(sorted_ids)]))
        yield from zip(sorted_ids[begins[:-1]].tolist(), begins[:-1].tolist(), begins[1:].tolist())


def spans(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each of these lengths, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(begins, counts)
