"""Elias-Fano sequences and an n-gram trie on them, memory-mapped and queried in whole arrays."""

from __future__ import annotations

import contextlib
import os
import tempfile

import numpy as np

ONE = np.uint64(1)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` low bits of each value, one after another, in 64-bit words with one to spare."""
    if not bits:
        return np.zeros(1, np.uint64)
    flat = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
    raw = np.packbits(flat.ravel(), bitorder="little")
    words = np.zeros(len(raw) // 8 + 2, np.uint64)
    words.view(np.uint8)[: len(raw)] = raw
    return words


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary (a one per value, a zero per step of the high part)."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int, size: int, buckets: int):
        self.low, self.high, self.bits, self.size = low, high, bits, size
        ones = np.unpackbits(high, bitorder="little")
        self._zeros = np.flatnonzero(ones[: size + buckets] == 0)  # select directory for searches

    @staticmethod
    def encode(values: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
        values = values.astype(np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        top = (values >> np.uint64(bits)).astype(np.int64)
        buckets = (int(top[-1]) if n else 0) + 1
        ones = np.zeros(n + buckets, np.uint8)
        ones[top + np.arange(n)] = 1
        return {"bits": bits, "size": n, "buckets": buckets}, {"low": _pack(values, bits), "high": np.packbits(ones, bitorder="little")}

    def low_bits(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        first = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, ONE)), np.uint64(0))
        return (first | rest) & ((ONE << np.uint64(self.bits)) - ONE)

    def values(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little")[: self.size + len(self._zeros)])
        top = (at - np.arange(self.size)).astype(np.uint64)
        return top << np.uint64(self.bits) | self.low_bits(np.arange(self.size))

    def successor(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, found): where the first value not below each target stands, and whether it equals it."""
        targets = targets.astype(np.uint64)
        top = targets >> np.uint64(self.bits)
        inside = top < np.uint64(len(self._zeros))  # unsigned: a target may be as large as 64 bits allow
        top = np.where(inside, top, np.uint64(0)).astype(np.int64)
        begin = np.where(top > 0, self._zeros[np.maximum(top, 1) - 1] + 1 - top, 0)
        end = self._zeros[top] - top
        begin, end = np.where(inside, begin, self.size), np.where(inside, end, self.size)
        mask = (ONE << np.uint64(self.bits)) - ONE
        want = targets & mask
        found = np.zeros(len(targets), bool)
        # Halve each bucket until the first value that is not lower; buckets hold a value or two on average.
        lo, hi = begin.copy(), end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            less = self.low_bits(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        check = np.flatnonzero(lo < end)
        found[check] = self.low_bits(lo[check]) == want[check]
        return lo, found


class Trie:
    """Words, their successors, and the successors of these pairs, with quantised values, in one memory-mapped file.

    Words are numbers below ``words``. A level's entries are sorted by (parent's place, word); adding the place times ``words`` makes
    them one monotone sequence, in which a successor search relative to the context finds an entry. Pointers, monotone as well, tell where
    the successors of each entry begin. Where the folder cannot be written the same bytes stay in memory.
    """

    def __init__(self, roots: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], codes: dict[str, np.ndarray], words: int, folder: str | None = None):
        """``roots`` are sorted; ``levels`` are (parent's place, word) of each entry; ``codes`` are byte-like arrays by name."""
        self.words = np.uint64(max(1, words))
        self.shape, arrays = {}, dict(codes)
        sequences, above = {"roots": roots}, len(roots)
        for n, (parent, word) in enumerate(levels):
            sequences[f"pointers{n}"] = np.searchsorted(parent, np.arange(above + 1))
            sequences[f"successors{n}"] = parent.astype(np.uint64) * self.words + word.astype(np.uint64)
            above = len(word)
        for name, values in sequences.items():
            self.shape[name], parts = EliasFano.encode(values)
            arrays |= {f"{name}.{k}": v for k, v in parts.items()}
        where, at, raw = {}, 0, []
        for k, v in arrays.items():
            where[k] = (at, v.dtype, len(v))
            raw.append(v.tobytes() + b"\0" * (-v.nbytes % 8))
            at += len(raw[-1])
        self.bytes, self.path = at, None
        try:
            handle, self.path = tempfile.mkstemp(prefix="trie-", dir=folder)
            with os.fdopen(handle, "wb") as f:
                f.writelines(raw or [b"\0"])
            self.map = np.memmap(self.path, np.uint8, "r")
        except OSError:
            self.map = np.frombuffer(b"".join(raw), np.uint8)
        got = {k: self.map[a : a + np.dtype(t).itemsize * n].view(t) for k, (a, t, n) in where.items()}
        self.codes = {k: got[k] for k in codes}
        self.levels = {n: EliasFano(got[f"{n}.low"], got[f"{n}.high"], s["bits"], s["size"], s["buckets"]) for n, s in self.shape.items()}

    def root(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of words as contexts."""
        return self.levels["roots"].successor(word)

    def find(self, level: int, parent: np.ndarray, known: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of ``word`` among the successors of the entries at ``parent``, where these are ``known``."""
        at, hit = self.levels[f"successors{level}"].successor(np.where(known, parent, 0).astype(np.uint64) * self.words + word.astype(np.uint64))
        return at, hit & known

    def close(self) -> None:
        self.levels = self.codes = self.map = None
        if self.path:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(self.path)
