"""MD5 of many short texts at once, by array arithmetic: one block of 64 bytes each, as RFC 1321 has it."""

from __future__ import annotations

import hashlib
import math

import numpy as np

SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The longest text of one block, and the texts that are hashed together: their words stay in a core's cache.
LONGEST, TOGETHER = 55, 8192


def words_of(texts: np.ndarray, ending: bytes) -> tuple[list[np.ndarray | None], int]:
    """The sixteen words of texts of one length (rows of bytes) with an ending; None for those that are zero in all."""
    m, k = texts.shape
    block = np.zeros((m, 64), np.uint8)
    block[:, :k] = texts
    block[:, k : k + len(ending) + 1] = np.frombuffer(ending + b"\x80", np.uint8)
    used = (k + len(ending) + 4) // 4
    words = block.view("<u4")
    return [np.ascontiguousarray(words[:, i]) if i < used else None for i in range(16)], 8 * (k + len(ending))


def digests(words: list[np.ndarray | None], bits: int) -> list[np.ndarray]:
    """The four words of each digest."""
    m = len(words[0])
    a, b, c, d = (np.full(m, x, np.uint32) for x in START)
    mixed, high = np.empty(m, np.uint32), np.empty(m, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=mixed), np.bitwise_and(mixed, b, out=mixed), np.bitwise_xor(mixed, d, out=mixed)
            at = i
        elif kind == 1:
            np.bitwise_xor(b, c, out=mixed), np.bitwise_and(mixed, d, out=mixed), np.bitwise_xor(mixed, c, out=mixed)
            at = (5 * i + 1) % 16
        elif kind == 2:
            np.bitwise_xor(b, c, out=mixed), np.bitwise_xor(mixed, d, out=mixed)
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=mixed), np.bitwise_or(mixed, b, out=mixed), np.bitwise_xor(mixed, c, out=mixed)
            at = 7 * i % 16
        add = SINES[i] if at != 14 else np.uint32((int(SINES[i]) + bits) & 0xFFFFFFFF)
        np.add(a, add, out=a), np.add(a, mixed, out=a)
        if words[at] is not None:
            np.add(a, words[at], out=a)
        turn = SHIFTS[kind][i % 4]
        np.left_shift(a, np.uint32(turn), out=high), np.right_shift(a, np.uint32(32 - turn), out=a)
        np.bitwise_or(a, high, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), START, strict=True)]


def pairs(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that the first and the second 13 hexadecimal digits of digests give, over 16^13: in [0, 1)."""
    first, second, third, fourth = (x.byteswap().astype(np.uint64) for x in words)
    left, right = first << np.uint64(32) | second, third << np.uint64(32) | fourth
    one = left >> np.uint64(12)
    two = (left & np.uint64(0xFFF)) << np.uint64(40) | right >> np.uint64(24)
    return one / float(1 << 52), two / float(1 << 52)


def uniform_pairs(texts: np.ndarray, ending: bytes) -> tuple[np.ndarray, np.ndarray]:
    """pairs() of the digests of texts of one length with an ending."""
    if texts.shape[1] + len(ending) <= LONGEST:
        return pairs(digests(*words_of(texts, ending)))
    found = b"".join(hashlib.md5(bytes(text) + ending).digest() for text in texts)
    return pairs(list(np.ascontiguousarray(np.frombuffer(found, "<u4").reshape(-1, 4).T)))
