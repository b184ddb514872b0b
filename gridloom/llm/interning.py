"""An open-addressed table in NumPy that gives equal byte strings of a batch one slot, and CRC-32 sums of joined words.

A key's place is its XXH64 value modulo the table's size, then the next free place; a place is shared only by keys whose bytes are equal,
so equal hash values of different keys do no harm. All keys of a batch are placed abreast.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Keys of more bytes are hashed one by one.
ABREAST = 512
#: Zero bytes that must follow the last key in a buffer.
PAD = 8


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _at(buf: np.ndarray, dtype: str) -> np.ndarray:
    """The little-endian numbers that begin at each byte of buf."""
    size = np.dtype(dtype).itemsize
    return np.ndarray((len(buf) - size + 1,), dtype, buffer=buf, strides=(1,))


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of buf[start : start + length] for each of many keys; buf has PAD bytes more."""
    out = np.empty(len(start), np.uint64)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    far = int(np.searchsorted(-length, -ABREAST, side="left"))
    for i in range(far):
        out[order[i]] = xxhash.xxh64_intdigest(buf[start[i] : start[i] + length[i]].tobytes())
    order, start, length = order[far:], start[far:], length[far:]
    if not len(order):
        return out
    lanes, halves = _at(buf, "<u8"), _at(buf, "<u4")
    h = np.full(len(order), _P5)
    at = start.copy()
    wide = int(np.searchsorted(-length, -32, side="right"))
    if wide:
        acc = [np.full(wide, v) for v in (np.uint64((int(_P1) + int(_P2)) % 2**64), _P2, np.uint64(0), np.uint64(2**64 - int(_P1)))]
        for s in range(int(length[0]) // 32):
            k = int(np.searchsorted(-length[:wide], -32 * (s + 1), side="right"))
            for j in range(4):
                acc[j][:k] = _rotl(acc[j][:k] + lanes[at[:k] + 8 * j] * _P2, 31) * _P1
            at[:k] += 32
        sums = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            sums = (sums ^ (_rotl(a * _P2, 31) * _P1)) * _P1 + _P4
        h[:wide] = sums
    h += length.astype(np.uint64)
    left = length - (at - start)
    while len(some := np.flatnonzero(left >= 8)):
        h[some] = _rotl(h[some] ^ (_rotl(lanes[at[some]] * _P2, 31) * _P1), 27) * _P1 + _P4
        at[some] += 8
        left[some] -= 8
    if len(some := np.flatnonzero(left >= 4)):
        h[some] = _rotl(h[some] ^ (halves[at[some]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[some] += 4
        left[some] -= 4
    while len(some := np.flatnonzero(left > 0)):
        h[some] = _rotl(h[some] ^ (buf[at[some]].astype(np.uint64) * _P5), 11) * _P1
        at[some] += 1
        left[some] -= 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    out[order] = h
    return out


def _equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes of the keys at a and b, of equal lengths, are the same."""
    lanes = _at(buf, "<u8")
    same = np.ones(len(a), bool)
    live, done = np.arange(len(a)), 0
    while len(live):
        rest = np.minimum(length[live] - done, 8)
        mask = np.uint64(2**64 - 1) >> (np.uint64(8) * (np.uint64(8) - rest.astype(np.uint64)))
        same[live] = ((lanes[a[live] + done] ^ lanes[b[live] + done]) & mask) == 0
        done += 8
        live = live[same[live] & (length[live] > done)]
    return same


class Table:
    """The distinct keys of one batch. slot: of each occurrence; first: of each slot, an occurrence with its key; count: of each slot."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        n = len(start)
        size = 1 << max(4, int(2 * n).bit_length())
        key = xxh64(buf, start, length)
        owner = np.full(size, -1, np.int64)
        place = (key & np.uint64(size - 1)).astype(np.int64)
        found = np.empty(n, np.int64)
        waiting = np.arange(n)
        while len(waiting):
            at = place[waiting]
            free = owner[at] < 0
            owner[at[free]] = waiting[free]
            held = owner[at]
            same = held == waiting
            alike = np.flatnonzero(~same & (key[held] == key[waiting]) & (length[held] == length[waiting]))
            same[alike] = _equal(buf, start[held[alike]], start[waiting[alike]], length[waiting[alike]])
            found[waiting[same]] = at[same]
            waiting = waiting[~same]
            place[waiting] = (place[waiting] + 1) & (size - 1)
        used = np.flatnonzero(owner >= 0)
        number = np.empty(size, np.int64)
        number[used] = np.arange(len(used))
        self.slot, self.first = number[found], owner[used]
        self.count = np.bincount(self.slot, minlength=len(used))


def packed(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buf, start, length) of keys that are the columns' numbers, 4 bytes each."""
    width = 4 * len(columns)
    n = len(columns[0])
    buf = np.zeros(n * width + PAD, np.uint8)
    buf[: n * width] = np.column_stack(columns).astype("<u4").reshape(-1).view(np.uint8)
    return buf, np.arange(n, dtype=np.int64) * width, np.full(n, width, np.int64)


def _shift(zeros: int) -> np.ndarray:
    """uint32[4, 256]: by a CRC's four bytes, what `zeros` further zero bytes make of it; its parts are joined by exclusive or."""
    tail = bytes(zeros)
    none = zlib.crc32(tail, 0)
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        row, k = out[bit // 8], bit % 8
        row[1 << k : 2 << k] = row[: 1 << k] ^ np.uint32(zlib.crc32(tail, 1 << bit) ^ none)
    return out


def crc_of_joined(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """CRC-32 of left's bytes and then right's, from the sums of both and right's length."""
    lengths, which = np.unique(right_length, return_inverse=True)
    tables = np.stack([_shift(int(k)) for k in lengths]) if len(lengths) else np.zeros((1, 4, 256), np.uint32)
    out = right.astype(np.uint32)
    for b in range(4):
        out = out ^ tables[which, b, (left >> np.uint32(8 * b)) & np.uint32(255)]
    return out
