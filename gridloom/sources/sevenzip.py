"""Members of 7z archives, read from the archive's bytes: only the folder that holds a member is unpacked, and no further than the member's end.

Coders known are copy, LZMA, LZMA2, deflate, delta and the x86 filter, one after another; others, and encryption, are errors.
"""

from __future__ import annotations

import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the format: the mark at the beginning, kinds of header entries, ids of coders.
MAGIC = b"7z\xbc\xaf\x27\x1c"
END, HEADER, STREAMS, FILES, PACKS, FOLDERS, PARTS, SIZE, SUMS, FOLDER, UNPACKED, NUMBER, EMPTY, NAMES, ENCODED = 0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 17, 23
COPY, DELTA, X86, LZMA2, LZMA1, DEFLATE = "00", "03", "03030103", "21", "030101", "040108"


@dataclass
class Folder:
    """A run of packed bytes: where they are, the coders that unpack them (id, properties) in order, and the sizes of the members inside."""

    start: int
    packed: int
    coders: list[tuple[str, bytes]]
    size: int
    members: list[int]


class _Reader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("broken 7z header")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """As many leading ones as bytes follow; the rest of the first byte is the highest part."""
        first = self.byte()
        more = next((k for k in range(8) if not first & 0x80 >> k), 8)
        low = int.from_bytes(self.take(more), "little")
        return low | ((first & (0x7F >> more)) << 8 * more if more < 8 else 0)

    def bits(self, n: int) -> list[bool]:
        held = self.take(-(-n // 8))
        return [bool(held[k // 8] & 0x80 >> k % 8) for k in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def sums(self, n: int) -> None:
        self.take(4 * sum(self.defined(n)))


def _folders(r: _Reader) -> list[Folder]:
    """The streams' part of a header."""
    start, packed, coders, sizes, members = 0, [], [], [], None
    while (kind := r.byte()) != END:
        if kind == PACKS:
            start, n = 32 + r.number(), r.number()
            while (part := r.byte()) != END:
                if part == SIZE:
                    packed = [r.number() for _ in range(n)]
                elif part == SUMS:
                    r.sums(n)
        elif kind == FOLDERS:
            if r.byte() != FOLDER:
                raise ValueError("broken 7z header")
            n = r.number()
            if r.byte():
                raise ValueError("folders kept elsewhere are not supported")
            coders = [_coders(r) for _ in range(n)]
            while (part := r.byte()) != END:
                if part == UNPACKED:
                    sizes = [[r.number() for _ in own] for own, _ in coders]
                elif part == SUMS:
                    r.sums(n)
        elif kind == PARTS:
            members = _parts(r, [own[last] for own, (_, last) in zip(sizes, coders)])
    starts = [start + sum(packed[:k]) for k in range(len(packed))]
    whole = [own[last] for own, (_, last) in zip(sizes, coders)]
    members = members or [[s] for s in whole]
    return [Folder(a, p, c, s, m) for a, p, (c, _), s, m in zip(starts, packed, coders, whole, members)]


def _coders(r: _Reader) -> tuple[list[tuple[str, bytes]], int]:
    """(coders from the packed end on, place of the one whose output is the folder's)."""
    found = []
    for _ in range(r.number()):
        flags = r.byte()
        name = r.take(flags & 15).hex()
        if flags & 16:
            raise ValueError("coders of several streams are not supported")
        found.append((name, r.take(r.number()) if flags & 32 else b""))
    into = {}
    for _ in range(len(found) - 1):
        reads, gives = r.number(), r.number()
        into[gives] = reads
    last = next((k for k in range(len(found)) if k not in into), 0)
    order = [k for k in range(len(found)) if k not in into.values()]  # reads the packed bytes
    while order[-1] in into:
        order.append(into[order[-1]])
    return [found[k] for k in order], last


def _parts(r: _Reader, whole: list[int]) -> list[list[int]]:
    number, sizes = [1] * len(whole), None
    while (part := r.byte()) != END:
        if part == NUMBER:
            number = [r.number() for _ in whole]
        elif part == SIZE:
            sizes = []
            for n, size in zip(number, whole):
                own = [r.number() for _ in range(n - 1)]
                sizes.append(own + [size - sum(own)] if n else [])
        elif part == SUMS:
            r.sums(sum(n for n in number if n != 1) + sum(n == 1 for n in number))
    return sizes if sizes is not None else [[s] if n else [] for n, s in zip(number, whole)]


def _unpacked(data: bytes, folder: Folder, upto: int) -> bytes:
    """The folder's first bytes."""
    raw = data[folder.start : folder.start + folder.packed]
    chain, deflated = [], False
    for name, own in folder.coders:
        if name == LZMA1:
            rest, lc = divmod(own[0], 9)
            pb, lp = divmod(rest, 5)
            chain.append({"id": lzma.FILTER_LZMA1, "lc": lc, "lp": lp, "pb": pb, "dict_size": max(4096, int.from_bytes(own[1:5], "little"))})
        elif name == LZMA2:
            chain.append({"id": lzma.FILTER_LZMA2, "dict_size": (2 | own[0] & 1) << own[0] // 2 + 11 if own[0] < 40 else (1 << 32) - 1})
        elif name == DELTA:
            chain.append({"id": lzma.FILTER_DELTA, "dist": own[0] + 1})
        elif name == X86:
            chain.append({"id": lzma.FILTER_X86})
        elif name == DEFLATE:
            deflated = True
        elif name != COPY:
            raise ValueError(f"the 7z coder {name} is not supported")
    if deflated:
        return zlib.decompressobj(-15).decompress(raw, upto) if upto else b""
    if not chain:
        return raw[:upto]
    reader, out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=chain[::-1]), bytearray()
    feed = raw
    while len(out) < upto:
        part = reader.decompress(feed, max_length=upto - len(out))
        feed = b""
        if not part and reader.needs_input:
            break
        out += part
    return bytes(out)


def listing(data: bytes) -> list[tuple[str, Folder | None, int, int]]:
    """(name, folder, offset in it, size) of the archive's members; members without bytes have no folder."""
    if data[:6] != MAGIC:
        raise ValueError("not a 7z archive")
    offset, size = int.from_bytes(data[12:20], "little"), int.from_bytes(data[20:28], "little")
    if not size:
        return []
    r = _Reader(data[32 + offset : 32 + offset + size])
    while (kind := r.byte()) == ENCODED:
        folder = _folders(r)[0]
        r = _Reader(_unpacked(data, folder, folder.size))
    if kind != HEADER:
        raise ValueError("broken 7z header")
    folders, names, empty = [], [], None
    while (kind := r.byte()) != END:
        if kind == STREAMS:
            folders = _folders(r)
        elif kind == FILES:
            n = r.number()
            while (part := r.byte()) != END:
                own = _Reader(r.take(r.number()))
                if part == NAMES:
                    own.byte()
                    names = own.data[1:].decode("utf-16-le").split("\0")[:n]
                elif part == EMPTY:
                    empty = own.bits(n)
        else:
            raise ValueError("broken 7z header")
    places = [(f, sum(f.members[:k]), size) for f in folders for k, size in enumerate(f.members)]
    held = iter(places)
    return [(name, *(next(held) if not (empty and empty[k]) else (None, 0, 0))) for k, name in enumerate(names)]


def members(data: bytes, pattern: str) -> Iterator[tuple[str, bytes]]:
    """name, content of the members whose whole names match."""
    for name, folder, at, size in listing(data):
        if re.fullmatch(pattern, name):
            yield name, _unpacked(data, folder, at + size)[at:] if folder else b""


def unpack(files: DataFrame, pattern: str) -> DataFrame:
    """binaryFile rows to file, member, content of the archives' members whose names match. An archive is one task's, a member one row."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                for name, data in members(bytes(content), pattern):
                    yield pd.DataFrame([(path, name, data)], columns=["file", "member", "content"])

    return files.select("path", "content").mapInPandas(run, "file string, member string, content binary")
