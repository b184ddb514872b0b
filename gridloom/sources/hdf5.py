"""NetCDF version 4: the part of the HDF5 format that such files use, read by seeking, so that only wanted chunks are unpacked.

Read are: superblocks 0 to 3; object headers 1 and 2; groups as symbol tables or as links in the header; attributes in the header or in a
fractal heap; numbers and strings, of fixed and variable length; compact, contiguous and chunked layouts, these by their B-tree of version 1; the
filters deflate, shuffle and fletcher32 (whose sums are not compared). Other layouts and filters are errors. Dimensions are named by the scales
that a variable refers to.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from math import prod

import numpy as np

#: Fixed values of the format.
MAGIC = b"\x89HDF\r\n\x1a\n"
NONE = (1 << 64) - 1
DATASPACE, LINK_INFO, DATATYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, SYMBOLS, ATTRIBUTE_INFO = 1, 2, 3, 5, 6, 8, 11, 12, 16, 17, 21
DEFLATE, SHUFFLE, FLETCHER32 = 1, 2, 3


class Bytes:
    """A cursor over bytes in memory, little-endian."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def left(self) -> int:
        return len(self.data) - self.at

    def align(self, n: int = 8) -> None:
        self.at += -self.at % n


class Type:
    """A datatype: its size, and either a NumPy type, or what else it is: 'string', 'vlen' (of `base`), 'other'."""

    def __init__(self, data: bytes) -> None:
        b = Bytes(data)
        first, bits, self.size = b.number(1), b.take(3), b.number(4)
        kind, self.base, self.dtype, self.is_text = first & 15, None, None, False
        self.kind = {0: "number", 1: "number", 3: "string", 9: "vlen"}.get(kind, "other")
        if kind == 0:
            self.dtype = np.dtype(f"{'>' if bits[0] & 1 else '<'}{'i' if bits[0] & 8 else 'u'}{self.size}")
        elif kind == 1:
            self.dtype = np.dtype(f"{'>' if bits[0] & 1 else '<'}f{self.size}")
        elif kind == 9:
            self.base, self.is_text = Type(b.data[8:]), bits[0] & 15 == 1


class Hdf5:
    """The root group's datasets as variables of name, dims, shape, attributes and, where chunked, chunk."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as self._f:
            self._root = self._superblock()
            members = self._links(self._header(self._root))
            objects = {name: self._header(address) for name, address in members.items()}
            names = {address: name for name, address in members.items()}
            self.variables = {name: self._variable(name, messages, names) for name, messages in objects.items() if any(k == LAYOUT for k, _ in messages)}
        del self._f

    # ---- structure

    def _read(self, at: int, n: int) -> bytes:
        self._f.seek(self._base + at)
        return self._f.read(n)

    def _superblock(self) -> int:
        self._base = 0
        b = Bytes(self._read(0, 160), 8)
        version = b.number(1)
        if version < 2:
            b.at = 13
            self._O, self._L = b.number(1), b.number(1)
            b.at = 24 + 4 * (version == 1)
            self._base = b.number(self._O)
            b.at += 3 * self._O + self._O
            return b.number(self._O)
        self._O, self._L = b.number(1), b.number(1)
        b.at += 1
        self._base = b.number(self._O)
        b.at += 2 * self._O
        return b.number(self._O)

    def _header(self, address: int) -> list[tuple[int, bytes]]:
        """(kind, data) of an object's messages."""
        head = self._read(address, 64)
        if head[:4] == b"OHDR":
            flags, at = head[5], 6
            at += 16 * bool(flags & 32) + 4 * bool(flags & 16)
            size = 1 << (flags & 3)
            blocks = [(address + at + size, int.from_bytes(head[at : at + size], "little"))]
            prefix = "v2", 4 + 2 * bool(flags & 4)
        elif head[0] == 1:
            blocks = [(address + 16, int.from_bytes(head[8:12], "little"))]
            prefix = "v1", 8
        else:
            raise ValueError(f"{self.path}: no object header at {address}")
        out = []
        while blocks:
            at, size = blocks.pop(0)
            b = Bytes(self._read(at, size))
            while b.left() >= prefix[1]:
                kind, n, flags = (b.number(2), b.number(2), b.number(1)) if prefix[0] == "v1" else (b.number(1), b.number(2), b.number(1))
                b.take(3 if prefix[0] == "v1" else prefix[1] - 4)
                data = b.take(n)
                if flags & 2:
                    raise ValueError(f"{self.path}: shared messages are not supported")
                if kind == CONTINUED:
                    c = Bytes(data)
                    start, length = c.number(self._O), c.number(self._L)
                    blocks.append((start, length) if prefix[0] == "v1" else (start + 4, length - 8))
                elif kind:
                    out.append((kind, data))
        return out

    def _links(self, messages: list[tuple[int, bytes]]) -> dict[str, int]:
        """name: address of a group's members."""
        out = {}
        for kind, data in messages:
            b = Bytes(data)
            if kind == SYMBOLS:
                tree, heap = b.number(self._O), b.number(self._O)
                h = Bytes(self._read(heap, 8 + 2 * self._L + self._O), 8)
                size = h.number(self._L)
                h.number(self._L)
                names = self._read(h.number(self._O), size)
                for node in self._leaves(tree, self._L):
                    s = Bytes(self._read(node, 8 + self._entries_bytes(node)), 6)
                    for _ in range(s.number(2)):
                        name, address = s.number(self._O), s.number(self._O)
                        s.take(24)
                        out[names[name : names.index(b"\0", name)].decode()] = address
            elif kind == LINK:
                name, address = self._link(data)
                if address is not None:
                    out[name] = address
            elif kind == LINK_INFO:
                flags = b.data[1]
                b.at = 2 + 8 * (flags & 1)
                heap, index = b.number(self._O), b.number(self._O)
                if heap != NONE:
                    for record in self._records(index):
                        name, address = self._link(self._heap_object(heap, record[4:]))
                        if address is not None:
                            out[name] = address
        return out

    def _entries_bytes(self, node: int) -> int:
        return int.from_bytes(self._read(node + 6, 2), "little") * (2 * self._O + 24)

    def _link(self, data: bytes) -> tuple[str, int | None]:
        b = Bytes(data, 1)
        flags = b.number(1)
        kind = b.number(1) if flags & 8 else 0
        b.take(8 * bool(flags & 4) + bool(flags & 16))
        name = b.take(b.number(1 << (flags & 3))).decode()
        return name, b.number(self._O) if kind == 0 else None

    def _leaves(self, address: int, key: int):
        """The children of the lowest nodes of a B-tree of version 1, with keys of `key` bytes; for chunks (key, child)."""
        head = Bytes(self._read(address, 8), 4)
        kind, level, used = head.number(1), head.number(1), head.number(2)
        b = Bytes(self._read(address + 8 + 2 * self._O, used * (key + self._O)))
        for _ in range(used):
            own, child = b.take(key), b.number(self._O)
            if level:
                yield from self._leaves(child, key)
            else:
                yield (own, child) if kind else child

    def _records(self, address: int) -> list[bytes]:
        """The records of a B-tree of version 2."""
        b = Bytes(self._read(address, 24 + self._O + 2 + self._L), 6)
        node, size, depth = b.number(4), b.number(2), b.number(2)
        b.take(2)
        root, n = b.number(self._O), b.number(2)
        if root == NONE:
            return []
        most = [(node - 10) // size]  # records of a node by its height, and what the counts of all below it take
        total = [most[0]]
        width = lambda v: max(1, (v.bit_length() + 7) // 8)
        for h in range(1, depth + 1):
            pointer = self._O + width(most[h - 1]) + (width(total[h - 1]) if h > 1 else 0)
            most.append((node - 10 - pointer) // (size + pointer))
            total.append((most[h] + 1) * total[h - 1] + most[h])

        def walk(at: int, count: int, h: int) -> list[bytes]:
            c = Bytes(self._read(at, node), 6)
            own = [c.take(size) for _ in range(count)]
            if not h:
                return own
            out = []
            for k in range(count + 1):
                child, below = c.number(self._O), c.number(width(most[h - 1]))
                if h > 1:
                    c.number(width(total[h - 1]))
                out += walk(child, below, h - 1) + own[k : k + 1]
            return out

        return walk(root, n, depth)

    def _heap_object(self, heap: int, key: bytes) -> bytes:
        """The object of a fractal heap with this id."""
        b = Bytes(self._read(heap, 26 + 12 * self._L + 3 * self._O), 5)
        b.number(2)
        if b.number(2):
            raise ValueError(f"{self.path}: heaps with filters are not supported")
        b.number(1)
        managed = b.number(4)
        b.take(self._L + self._O + self._L + self._O + 8 * self._L)
        wide, start, largest, bits, _ = b.number(2), b.number(self._L), b.number(self._L), b.number(2), b.number(2)
        root, rows = b.number(self._O), b.number(2)
        if key[0] >> 4 & 3:
            raise ValueError(f"{self.path}: only managed objects of heaps are supported")
        k = Bytes(key, 1)
        space = (bits + 7) // 8
        limit = min(largest, managed)
        offset, length = k.number(space), k.number((limit.bit_length() + 7) // 8)

        def find(block: int, rows: int, begin: int) -> bytes:
            if not rows:
                return self._read(block + offset - begin, length)
            at = block + 5 + self._O + space
            for r in range(rows):
                size = start << max(0, r - 1)
                for _ in range(wide):
                    child = int.from_bytes(self._read(at, self._O), "little")
                    if begin <= offset < begin + size:
                        if size <= largest:
                            return find(child, 0, begin)
                        return find(child, (size // (start * wide)).bit_length(), begin)
                    at, begin = at + self._O, begin + size
            raise ValueError(f"{self.path}: a heap's object is beyond its blocks")

        return find(root, rows, 0)

    def _global(self, address: int, index: int) -> bytes:
        """An object of a global heap."""
        size = int.from_bytes(self._read(address + 8, self._L), "little")
        b = Bytes(self._read(address, size), 8 + self._L)
        while b.left() >= 8 + self._L:
            number = b.number(2)
            b.take(6)
            data = b.take(b.number(self._L))
            if number == index:
                return data
            if not number:
                break
            b.align()
        return b""

    # ---- variables

    @staticmethod
    def _shape(data: bytes, size: int) -> list[int]:
        b = Bytes(data)
        version, rank = b.number(1), b.number(1)
        b.at = 8 if version == 1 else 4
        return [b.number(size) for _ in range(rank)]

    def _attribute(self, data: bytes) -> tuple[str, object]:
        b = Bytes(data)
        version, _, n_name, n_type, n_space = b.number(1), b.number(1), b.number(2), b.number(2), b.number(2)
        b.take(version == 3)
        parts = []
        for n in (n_name, n_type, n_space):
            parts.append(b.take(n))
            if version == 1:
                b.align()
        kind, count = Type(parts[1]), prod(self._shape(parts[2], self._L))
        raw, value = b.take(kind.size * count), None
        if kind.kind == "number":
            value = np.frombuffer(raw, kind.dtype)
        elif kind.kind == "string":
            value = raw.split(b"\0")[0].decode("utf-8", "replace")
        elif kind.kind == "vlen":
            c = Bytes(raw)
            held = [(c.number(4), c.number(self._O), c.number(4)) for _ in range(count)]
            found = [self._global(a, i)[: n * kind.base.size] for n, a, i in held]
            value = b"".join(found).split(b"\0")[0].decode("utf-8", "replace") if kind.is_text else found
        return parts[0].split(b"\0")[0].decode(), value

    def _attributes(self, messages: list[tuple[int, bytes]]) -> dict[str, object]:
        own = [data for kind, data in messages if kind == ATTRIBUTE]
        for kind, data in messages:
            if kind == ATTRIBUTE_INFO:
                b = Bytes(data, 2 + 2 * (data[1] & 1))
                heap, index = b.number(self._O), b.number(self._O)
                if heap != NONE:
                    own += [self._heap_object(heap, record[:8]) for record in self._records(index)]
        return dict(self._attribute(data) for data in own)

    def _variable(self, name: str, messages: list[tuple[int, bytes]], names: dict[int, str]) -> dict:
        held = dict(messages)
        attributes, shape = self._attributes(messages), self._shape(held[DATASPACE], self._L)
        scales = attributes.get("DIMENSION_LIST")
        dims = [names.get(int.from_bytes(s[: self._O], "little"), "") for s in scales] if scales else [name] * len(shape)
        out = {"dims": dims, "shape": shape, "attributes": attributes, "dtype": Type(held[DATATYPE]).dtype, "filters": self._filters(held.get(FILTERS))}
        b = Bytes(held[LAYOUT])
        version, kind = b.number(1), b.number(1)
        if version not in (3, 4) or kind > 2 or version == 4 and kind == 2:
            raise ValueError(f"{self.path}: the layout of {name} is not supported")
        if kind == 0:
            out["data"] = b.take(b.number(2))
        elif kind == 1:
            out["begin"] = b.number(self._O)
        else:
            rank, tree = b.number(1), b.number(self._O)
            out["chunk"] = tuple(b.number(4) for _ in range(rank))[:-1]
            out["tree"] = tree
        out["fill"] = self._fill(held.get(FILL), out["dtype"])
        # references to scales are no attributes of the variable's own
        out["attributes"] = {k: a for k, a in attributes.items() if a is not None and not isinstance(a, list)}
        return out

    @staticmethod
    def _fill(data: bytes | None, dtype: np.dtype | None):
        """What stands where no chunk was written."""
        if not data or dtype is None:
            return 0
        b = Bytes(data)
        version, flags = b.number(1), b.number(1)
        defined = flags & 32 if version == 3 else True
        if version < 3:
            b.take(1)
            defined = version == 1 or b.number(1)
            b.at = 4
        if not defined:
            return 0
        size = b.number(4)
        return np.frombuffer(b.take(size), dtype)[0] if size == dtype.itemsize else 0

    def _filters(self, data: bytes | None) -> list[tuple[int, list[int]]]:
        if not data:
            return []
        b = Bytes(data)
        version, n = b.number(1), b.number(1)
        b.take(6 if version == 1 else 0)
        out = []
        for _ in range(n):
            kind = b.number(2)
            length = b.number(2) if version == 1 or kind >= 256 else 0
            b.take(2)
            values = b.number(2)
            b.take(length + (-length % 8 if version == 1 else 0))
            out.append((kind, [b.number(4) for _ in range(values)]))
            b.take(4 * (version == 1 and values % 2))
        unknown = {k for k, _ in out} - {DEFLATE, SHUFFLE, FLETCHER32}
        if unknown:
            raise ValueError(f"{self.path}: filters {sorted(unknown)} are not supported")
        return out

    def _chunks(self, v: dict) -> dict[tuple[int, ...], tuple[int, int, int]]:
        """Where each chunk begins in the variable: (address, bytes, filters left out)."""
        rank = len(v["chunk"])
        out = {}
        if v["tree"] != NONE:
            for key, child in self._leaves(v["tree"], 8 + 8 * (rank + 1)):
                b = Bytes(key)
                size, mask = b.number(4), b.number(4)
                out[tuple(b.number(8) for _ in range(rank))] = child, size, mask
        return out

    def _unpack(self, v: dict, data: bytes, mask: int) -> np.ndarray:
        for i, (kind, _) in reversed(list(enumerate(v["filters"]))):
            if mask >> i & 1:
                continue
            if kind == DEFLATE:
                data = zlib.decompress(data)
            elif kind == FLETCHER32:
                data = data[:-4]
            else:
                size = v["dtype"].itemsize
                whole = len(data) // size * size
                data = np.frombuffer(data[:whole], np.uint8).reshape(size, -1).T.tobytes() + data[whole:]
        return np.frombuffer(data, v["dtype"])[: prod(v["chunk"])].reshape(v["chunk"])

    def _box(self, v: dict, low: list[int], high: list[int], chunks: dict | None = None) -> np.ndarray:
        """The raw values from low up to high along each dimension."""
        shape = [b - a for a, b in zip(low, high)]
        if "chunk" not in v:
            whole = v.get("data")
            size = prod(v["shape"]) * v["dtype"].itemsize
            if whole is None and v["begin"] == NONE:
                return np.full(shape, v["fill"], v["dtype"])
            if whole is None:
                # rows of the leading dimension are together; only the wanted ones are read
                step = size // max(1, v["shape"][0]) if v["shape"] else size
                first = low[0] if low else 0
                rows = self._read(v["begin"] + first * step, step * (high[0] - first if high else 1))
                return np.frombuffer(rows, v["dtype"]).reshape([*shape[:1], *v["shape"][1:]])[tuple([slice(None), *map(slice, low[1:], high[1:])][: len(shape)])]
            return np.frombuffer(whole, v["dtype"]).reshape(v["shape"])[tuple(map(slice, low, high))]
        chunks = self._chunks(v) if chunks is None else chunks
        out = np.full(shape, v["fill"], v["dtype"])
        for start in itertools.product(*(range(a // c * c, b, c) for a, b, c in zip(low, high, v["chunk"]))):
            if start in chunks:
                at, size, mask = chunks[start]
                part = self._unpack(v, self._read(at, size), mask)
                source = [slice(max(a - s, 0), min(b - s, c)) for a, b, s, c in zip(low, high, start, v["chunk"])]
                target = [slice(max(s - a, 0), max(s - a, 0) + q.stop - q.start) for a, s, q in zip(low, start, source)]
                out[tuple(target)] = part[tuple(source)]
        return out

    def values(self, name: str, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As of a classic file: steps first to last of the leading dimension, unpacked, and which of them are missing."""
        from gridloom.sources.raster import unpacked

        v = self.variables[name]
        last = v["shape"][0] if last is None else last
        with open(self.path, "rb") as self._f:
            raw = self._box(v, [first, *[0] * (len(v["shape"]) - 1)], [last, *v["shape"][1:]])
        return unpacked(raw.reshape(last - first, -1), v["attributes"])

    def steps(self, name: str, steps: list[int], rows: np.ndarray, columns: np.ndarray):
        """(step, values, missing) of the wanted rows and columns; only chunks that hold some of them are read, each once a run of steps."""
        from gridloom.sources.raster import unpacked

        v = self.variables[name]
        if not len(steps) or not len(rows) or not len(columns):
            return
        with open(self.path, "rb") as self._f:
            chunks = self._chunks(v) if "chunk" in v else None
            deep = v.get("chunk", (1,))[0]
            for _, group in itertools.groupby(steps, lambda k: k // deep):
                own = list(group)
                low, high = [own[0], int(rows[0]), int(columns[0])], [own[-1] + 1, int(rows[-1]) + 1, int(columns[-1]) + 1]
                raw = self._box(v, low, high, chunks)[:, rows - rows[0]][:, :, columns - columns[0]]
                for k in own:
                    yield k, *unpacked(raw[k - own[0]], v["attributes"])
