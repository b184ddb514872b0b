import lzma
import struct
import zlib

import pytest

from gridloom.sources import sevenzip as Z


def number(n):
    for more in range(8):
        if n < 1 << 7 * (more + 1):
            return bytes([(0xFF00 >> more) & 0xFF | n >> 8 * more]) + (n & ((1 << 8 * more) - 1)).to_bytes(more, "little")
    return b"\xff" + n.to_bytes(8, "little")


def pack(data, coder):
    if coder == "copy":
        return data, [(b"\x00", b"")]
    if coder == "deflate":
        c = zlib.compressobj(9, zlib.DEFLATED, -15)
        return c.compress(data) + c.flush(), [(b"\x04\x01\x08", b"")]
    if coder == "lzma":
        return lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}]), [(b"\x03\x01\x01", struct.pack("<BI", 93, 1 << 16))]
    if coder == "lzma2":
        return lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}]), [(b"\x21", bytes([8]))]
    # delta, then LZMA2: the folder's output is the first coder's, which reads the second's
    return lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_DELTA, "dist": 4}, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}]), [(b"\x03", bytes([3])), (b"\x21", bytes([8]))]


def streams(folders, at, sums=True):
    """The header's part on folders: (coder, [members' contents])."""
    packs = [pack(b"".join(parts), coder) for coder, parts in folders]
    out = b"\x06" + number(at) + number(len(packs)) + b"\x09" + b"".join(number(len(p)) for p, _ in packs) + b"\x00"
    out += b"\x07\x0b" + number(len(packs)) + b"\x00"
    for _, coders in packs:
        out += number(len(coders))
        for name, own in coders:
            out += bytes([len(name) | (32 if own else 0)]) + name + (number(len(own)) + own if own else b"")
        out += b"".join(number(k) + number(k + 1) for k in range(len(coders) - 1))
    out += b"\x0c" + b"".join(number(sum(map(len, parts))) * len(c) for (_, parts), (_, c) in zip(folders, packs)) + b"\x00"
    out += b"\x08\x0d" + b"".join(number(len(parts)) for _, parts in folders) + b"\x09" + b"".join(number(len(p)) for _, parts in folders for p in parts[:-1])
    if sums:
        out += b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(p)) for _, parts in folders for p in parts)
    return b"".join(p for p, _ in packs), out + b"\x00\x00"


def archive(path, folders, empty=(), encoded=True):
    """folders: (coder, [(name, content)]); names of empty members come last."""
    body, info = streams([(c, [d for _, d in parts]) for c, parts in folders], 0)
    names = [n for _, parts in folders for n, _ in parts] + list(empty)
    listed = b"\x00" + b"".join(n.encode("utf-16-le") + b"\0\0" for n in names)
    files = number(len(names)) + b"\x11" + number(len(listed)) + listed
    if empty:
        bits = "".join("1" if n in empty else "0" for n in names)
        bits += "0" * (-len(bits) % 8)
        held = int(bits, 2).to_bytes(len(bits) // 8, "big")
        files += b"\x0e" + number(len(held)) + held
    header = b"\x01\x04" + info + b"\x05" + files + b"\x00\x00"
    if encoded:
        packed, info = streams([("lzma", [header])], len(body), sums=False)
        body, header = body + packed, b"\x17" + info
    path.write_bytes(Z.MAGIC + b"\x00\x04" + bytes(4) + struct.pack("<QQI", len(body), len(header), zlib.crc32(header)) + body + header)


CODERS = ["copy", "deflate", "lzma", "lzma2", "delta"]


def content(k):
    return bytes((i * k) % 251 for i in range(3000 + 100 * k)) + b"end %d" % k


@pytest.mark.parametrize("encoded", [True, False])
def test_members(spark, tmp_path, encoded):
    folders = [(c, [(f"025d/GDP{2000 + 3 * k + j}.tif", content(3 * k + j)) for j in range(3)]) for k, c in enumerate(CODERS)]
    archive(tmp_path / "a.7z", folders, ("empty.txt", "日本/none"), encoded)
    data = (tmp_path / "a.7z").read_bytes()
    assert [n for n, *_ in Z.listing(data)] == [n for _, parts in folders for n, _ in parts] + ["empty.txt", "日本/none"]
    assert dict(Z.members(data, ".*")) == {n: d for _, parts in folders for n, d in parts} | {"empty.txt": b"", "日本/none": b""}
    df = spark.read.format("binaryFile").load(str(tmp_path / "a.7z"))
    rows = Z.unpack(df, r"025d/GDP20(07|13)\.tif").collect()
    assert {r.member: bytes(r.content) for r in rows} == {"025d/GDP2007.tif": content(7), "025d/GDP2013.tif": content(13)}
    assert Z.unpack(df, "nothing").count() == 0


def test_only_the_members_folder_is_unpacked(tmp_path, monkeypatch):
    archive(tmp_path / "a.7z", [("lzma2", [("a", content(1)), ("b", content(2)), ("c", content(3))]), ("lzma", [("d", content(4))])])
    data = bytearray((tmp_path / "a.7z").read_bytes())
    other = next(f for n, f, *_ in Z.listing(bytes(data)) if n == "d")
    data[other.start : other.start + other.packed] = bytes(other.packed)  # the other folder is broken
    asked, plain = [], Z._unpacked
    monkeypatch.setattr(Z, "_unpacked", lambda d, f, upto: asked.append((f.start, upto)) or plain(d, f, upto))
    assert dict(Z.members(bytes(data), "b")) == {"b": content(2)}
    assert asked[-1] == (32, len(content(1)) + len(content(2)))  # and no further than the member


def test_other_files_are_errors(tmp_path):
    for data in (b"PK\x03\x04" + bytes(40), Z.MAGIC + bytes(6) + struct.pack("<QQI", 0, 9, 0) + b"\x05" * 9):
        with pytest.raises(ValueError):
            Z.listing(data)
    assert Z.listing(Z.MAGIC + bytes(26)) == []
