"""Elias-Fano sequences in memory-mapped files.

A file is in the temporary folder of the machine of one task, which alone reads it and leaves nothing behind: a retried task
makes its own.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np


class Levels:
    """A file of arrays that are written one after another and then mapped. It has no name any more once it is open: nothing is left behind."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        place = (self.size, len(data))
        padded = data + b"\0" * (16 - len(data) % 8)  # room for reads of 8 bytes at any place
        self.file.write(padded)
        self.size += len(padded)
        return place

    def open(self) -> memoryview:
        self.file.flush()
        mapped = mmap.mmap(self.file.fileno(), self.size, access=mmap.ACCESS_READ) if self.size else b""
        self.file.close()
        return memoryview(mapped)


#: Bits of a block whose start has a sample, and the places looked for at a time.
SAMPLED, AT_ONCE = 512, 1 << 15
#: In each byte, where its first, second, ... set bit is.
SET_BITS = np.array([[*np.flatnonzero((x >> np.arange(8)) & 1), *[0] * 8][:8] for x in range(256)], np.uint8)


class EliasFano:
    """A sequence of rising integers: low bits packed, high parts in unary.

    It is searched as it is coded, in the mapped file: select finds the sample before a bit, then counts the bits of eight words
    and of a word's bytes. In memory are only the samples, two numbers for every SAMPLED bits.
    """

    def __init__(self, values: np.ndarray, universe: int, levels: Levels):
        n = len(values)
        self.n, self.low_bits = n, min(56, max(0, (universe // max(n, 1)).bit_length() - 1))  # at most 56: one read of 8 bytes has them wherever they begin
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.buckets = int(high[-1]) + 2 if n else 1
        unary = np.zeros(-(-(n + self.buckets) // SAMPLED) * SAMPLED, np.uint8)
        unary[high + np.arange(n)] = 1
        coded = np.packbits(unary, bitorder="little")
        self.high_at = levels.add(coded.tobytes())
        ones = np.cumsum(np.bitwise_count(coded.view("<u8")).reshape(-1, SAMPLED // 64).sum(1, dtype=np.int64))
        self.ones = np.concatenate([[0], ones[:-1]])
        self.zeros = np.arange(len(ones)) * SAMPLED - self.ones
        self.low_at = levels.add(self.packed(values))

    def packed(self, values: np.ndarray) -> bytes:
        if not self.low_bits:
            return b""
        out, shifts = [], np.arange(self.low_bits, dtype=np.uint64)
        for at in range(0, len(values), 8 * 8192):  # whole bytes
            out.append(np.packbits(((values[at : at + 8 * 8192, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes())
        return b"".join(out)

    def open(self, mapped: memoryview) -> None:
        at, size = self.high_at
        self.bits = np.frombuffer(mapped, "<u8", size // 8, at)
        self.at_byte = np.ndarray((size + 1,), "<u8", mapped, at, (1,))
        at, size = self.low_at
        self.words = np.ndarray((size + 1,), "<u8", mapped, at, (1,)) if self.low_bits else None

    def select(self, i: np.ndarray, one: bool) -> np.ndarray:
        """Where the i-th (from 0) set bits, or clear bits, of the unary part are."""
        if len(i) > AT_ONCE:
            return np.concatenate([self.select(i[at : at + AT_ONCE], one) for at in range(0, len(i), AT_ONCE)])
        before = self.ones if one else self.zeros
        block = np.searchsorted(before, i, "right") - 1
        left, word = i - before[block], block * (SAMPLED // 64)
        flip = np.uint64(0 if one else 0xFFFFFFFFFFFFFFFF)
        for _ in range(SAMPLED // 64 - 1):
            n = np.bitwise_count(self.bits[word] ^ flip)
            on = left >= n
            left, word = left - n * on, word + on
        # the counts of a word's bytes so far, each in its byte
        bits = self.bits[word] ^ flip
        sums = bits - ((bits >> np.uint64(1)) & np.uint64(0x5555555555555555))
        sums = (sums & np.uint64(0x3333333333333333)) + ((sums >> np.uint64(2)) & np.uint64(0x3333333333333333))
        sums = ((sums + (sums >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * np.uint64(0x0101010101010101)
        counts = sums.view(np.uint8).reshape(-1, 8)
        byte = (counts <= left[:, None]).sum(1)
        rows = np.arange(len(i))
        left = left - np.where(byte > 0, counts[rows, np.maximum(byte - 1, 0)], 0)
        return word * 64 + byte * 8 + SET_BITS[bits.view(np.uint8).reshape(-1, 8)[rows, byte], left]

    def next_clear(self, at: np.ndarray) -> np.ndarray:
        """Where the first clear bit after each place is, by one read of eight bytes; -1 where these have none."""
        bit = at + 1
        seen = ~(self.at_byte[bit >> 3] >> (bit & 7).astype(np.uint64))
        ahead = np.bitwise_count((seen & (~seen + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        return np.where(ahead < 57, bit + ahead, -1)

    def bucket(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of a bucket's first value and of the one after its last."""
        before = np.where(bucket > 0, self.select(np.maximum(bucket - 1, 0), False), -1)
        end = self.next_clear(before)
        if len(far := np.flatnonzero(end < 0)):
            end[far] = self.select(bucket[far], False)
        return before - bucket + 1, end - bucket

    def low(self, i: np.ndarray) -> np.ndarray:
        if self.words is None:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        value = self.words[bit >> 3] >> (bit & 7).astype(np.uint64)
        return value & np.uint64((1 << self.low_bits) - 1)

    def value(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        return (self.select(i, True) - i << self.low_bits) | self.low(i).astype(np.int64)

    def successors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x, the place of the first value of at least x (n: none), and whether it equals x."""
        x = x.astype(np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = np.minimum(x >> np.uint64(self.low_bits), np.uint64(self.buckets - 1)).astype(np.int64)
        beyond = (x >> np.uint64(self.low_bits)) > np.uint64(self.buckets - 1)
        wanted = x & np.uint64((1 << self.low_bits) - 1)
        first, end = self.bucket(high)
        last = end.copy()
        while len(open_ones := np.flatnonzero(first < last)):
            middle = (first[open_ones] + last[open_ones]) >> 1
            less = self.low(middle) < wanted[open_ones]
            first[open_ones[less]] = middle[less] + 1
            last[open_ones[~less]] = middle[~less]
        first[beyond] = self.n
        hit = (first < end) & ~beyond
        equal = np.zeros(len(x), bool)
        at = np.flatnonzero(hit)
        equal[at] = self.low(first[at]) == wanted[at]
        return first, equal
