"""Monotone sequences in Elias-Fano form, read from a buffer by whole arrays of queries."""

from __future__ import annotations

import numpy as np

_STEP = 50_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)  # place of its k-th one
_U = {x: np.uint64(x) for x in (1, 2, 4, 8, 255, *(k * 0x0101010101010101 for k in (0x55, 0x33, 0x0F, 1)))}


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary, counts of ones per 64 bits.

    Takes about 2 + log2(universe / n) bits per element. All arrays are views of one buffer, such
    as a memory map.
    """

    def __init__(self, header: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.size, self.width, self.top = (int(x) for x in header)
        self.low, self.high, self.ones = low, high, ones

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        last = int(values[-1]) if n else 0
        width = max(0, (max(1, last) // max(1, n)).bit_length() - 1)
        low = []
        for at in range(0, n, _STEP):  # a step fills whole bytes, and a bit takes eight of them before it is packed
            bits = (values[at : at + _STEP, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
            low.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        low = np.concatenate([*low, np.zeros(16, np.uint8)])
        parts = (values >> np.uint64(width)).astype(np.int64)
        top = int(parts[-1]) if n else 0
        length = -(-(n + top + 1) // 64) * 64
        flags = np.zeros(length, np.uint8)
        flags[parts + np.arange(n)] = 1
        ones = np.concatenate([[0], np.cumsum(flags.reshape(-1, 64).sum(axis=1))]).astype("<i8")
        high = np.packbits(flags, bitorder="little")
        pad = -(24 + len(low)) % 8
        head = np.array([n, width, top], "<i8").tobytes()
        sizes = np.array([len(low) + pad, len(high), len(ones) * 8], "<i8").tobytes()
        return sizes + head + low.tobytes() + bytes(pad) + high.tobytes() + ones.tobytes()

    @staticmethod
    def read(buffer, at: int) -> tuple[EliasFano, int]:
        """The sequence at a byte position of a buffer, and where it ends."""
        low, high, ones = (int(x) for x in np.frombuffer(buffer, "<i8", 3, at))
        header = np.frombuffer(buffer, "<i8", 3, at + 24)
        at += 48
        parts = (
            np.frombuffer(buffer, np.uint8, low, at),
            np.frombuffer(buffer, np.uint8, high, at + low),
            np.frombuffer(buffer, "<i8", ones // 8, at + low + high),
        )
        return EliasFano(header, *parts), at + low + high + ones

    def _select(self, index: np.ndarray, ones: bool) -> np.ndarray:
        """Positions of the index-th one or zero of the high part."""
        counts = self.ones if ones else 64 * np.arange(len(self.ones)) - self.ones
        words = self.high.view("<u8")
        out = np.empty(len(index), np.int64)
        for at in range(0, len(index), _STEP):
            i = index[at : at + _STEP]
            word = np.searchsorted(counts, i, side="right") - 1
            bits = words[word] if ones else ~words[word]
            rest = (i - counts[word]).astype(np.uint64)
            # Each byte of ``seen`` counts the ones in the bytes up to it.
            seen = bits - ((bits >> _U[1]) & _U[0x5555555555555555])
            seen = (seen & _U[0x3333333333333333]) + ((seen >> _U[2]) & _U[0x3333333333333333])
            seen = ((seen + (seen >> _U[4])) & _U[0x0F0F0F0F0F0F0F0F]) * _U[0x0101010101010101]
            octet = (seen.view(np.uint8).reshape(-1, 8) <= rest.astype(np.uint8)[:, None]).sum(axis=1, dtype=np.uint64)
            shift = octet * _U[8]
            rest -= ((seen << _U[8]) >> shift) & _U[255]
            out[at : at + _STEP] = word * 64 + shift.astype(np.int64) + _PLACE[(bits >> shift) & _U[255], rest]
        return out

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), np.int64)
        bit = index * self.width
        gathered = self.low[(bit >> 3)[:, None] + np.arange(8)]
        words = np.ascontiguousarray(gathered).view("<u8").ravel()
        return ((words >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def access(self, index: np.ndarray) -> np.ndarray:
        """Values at given places."""
        index = np.asarray(index, np.int64)
        return ((self._select(index, True) - index) << self.width) | self._low(index)

    def successor(self, targets: np.ndarray) -> np.ndarray:
        """The place of the first element not below each target; the size where there is none."""
        targets = np.asarray(targets, np.int64)
        part = targets >> self.width
        beyond = part > self.top
        part = np.where(beyond, self.top, part)
        end = self._select(part, False) - part
        start = np.where(part > 0, self._select(np.maximum(part - 1, 0), False) - (part - 1), 0)
        rest = targets & ((1 << self.width) - 1)
        open_ = np.flatnonzero(start < end)
        while len(open_):
            middle = (start[open_] + end[open_]) >> 1
            below = self._low(middle) < rest[open_]
            start[open_[below]] = middle[below] + 1
            end[open_[~below]] = middle[~below]
            open_ = open_[start[open_] < end[open_]]
        return np.where(beyond, self.size, start)
