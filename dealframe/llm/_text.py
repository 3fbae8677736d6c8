"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Texts are handled in blocks of about BLOCK bytes, so memory is bounded by the
block or by one text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2_000_000
U64 = np.uint64


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string column; null counts as empty."""
    col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def blocks(col: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) of runs of whole texts."""
    data, offs = raw(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Words:
    """Words [^\\x20\\x09-\\x0D]+ and their 64-bit hashes, A-Z lower-cased."""

    def __init__(self) -> None:
        self.isword = np.ones(256, bool)
        self.isword[[9, 10, 11, 12, 13, 32]] = False
        self.tab = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.tab[65:91] = self.tab[97:123]
        self.base = 0x9E3779B97F4A7C15
        self.inv = pow(self.base, -1, 1 << 64)
        self.pows = self.ipows = np.ones(0, np.uint64)

    def spans(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and for each text the index of its first word (one more at the end)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        w = self.isword[data]
        begin, end = w.copy(), w.copy()
        begin[1:] &= ~w[:-1]
        end[:-1] &= ~w[1:]
        at = offs[:-1][offs[:-1] < n]
        begin[at] = w[at]
        at = offs[1:][offs[1:] > 0] - 1
        end[at] = w[at]
        st, en = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return st, en, np.searchsorted(st, offs)

    def _powers(self, n: int) -> None:
        if len(self.pows) < n:
            for name, b in (("pows", self.base), ("ipows", self.inv)):
                p = np.full(n, U64(b))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def hashes(self, data: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
        out, i, step = np.empty(len(st), np.uint64), 0, 1 << 19
        while i < len(st):
            j = max(i + 1, int(np.searchsorted(st, st[i] + step)))
            lo, seg = st[i], data[st[i] : en[j - 1]]
            self._powers(max(step, len(seg)))
            run = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum(self.tab[seg] * self.pows[: len(seg)], out=run[1:])
            s, e = st[i:j] - lo, en[i:j] - lo
            out[i:j] = (run[e] - run[s]) * self.ipows[s] + (e - s).astype(np.uint64) * U64(0xA0761D6478BD642F)
            i = j
        return mix(out)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k of h; of h as one run where it has fewer; none of none."""
    k = min(k, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    out = np.full(n, U64(k))
    for i in range(k):
        out = (out ^ h[i : i + n]) * U64(0x9FB21C651E98DF25)
        out ^= out >> U64(29)
    return mix(out)
