"""Media columns: Netpbm and BMP images decoded to arrays, resized by areas through integral images, cut to NPY tiles, with difference hashes.

`payload` makes an image of any bytes, losslessly: filled with bytes 255 to a positive multiple of 576, laid out in rows of 24 samples.

Nulls: a null text is empty and becomes one block of 576 bytes 255. Repeated rows and equal texts get equal values. Very long texts are
tall images. An empty table gives an empty result. Broken images raise ValueError in decode; `image_features` gives nulls for them.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import map_rows, stored

BLOCK, WIDTH = 576, 24
#: Samples that an integral image is summed up for at once.
STRIP = 1 << 18


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A grey image of uint8 as binary Netpbm."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A grey image of uint8 as BMP with a grey palette; rows from the bottom, filled to four bytes."""
    h, w = pixels.shape
    stride = -(-w // 4) * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = pixels[::-1]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    offset = 14 + 40 + len(palette)
    return struct.pack("<2sIHHI", b"BM", offset + rows.size, 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Netpbm P1 to P6 and BMP of 8 or 24 bits, without compression, to (height, width) or (height, width, 3) of uint8, or uint16 for deep Netpbm."""
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    while len(head) < (2 if kind in (1, 4) else 3):
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        head.append(int(data[at:end]))
        at = end
    w, h = head[:2]
    deep = head[2] if len(head) > 2 else 1
    bands = 3 if kind in (3, 6) else 1
    if kind == 1:
        flat = np.frombuffer(bytes(c for c in data[at:] if c in b"01"), np.uint8)[: w * h] == 48
        out = flat.astype(np.uint8) * 255
    elif kind == 4:
        stride = -(-w // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * h, at + 1).reshape(h, stride), axis=1)[:, :w]
        out = (1 - bits.ravel()) * np.uint8(255)
    elif kind in (2, 3):
        out = np.array(data[at:].split()[: w * h * bands], np.int64).astype(np.uint8 if deep < 256 else np.uint16)
    else:
        out = np.frombuffer(data, np.uint8 if deep < 256 else ">u2", w * h * bands, at + 1)
    if out.size != w * h * bands:
        raise ValueError("Netpbm has too few samples")
    return out.reshape((h, w, 3) if bands == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    offset, (size, w, h), (bits, packed) = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<Iii", data, 14), struct.unpack_from("<HI", data, 28)
    if packed or bits not in (8, 24):
        raise ValueError("only BMP of 8 or 24 bits without compression")
    stride = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 24:
        return rows.reshape(abs(h), w, 3)[:, :, ::-1]
    n = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, 4 * n, 14 + size).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][rows]
    return palette[rows]


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of a colour image by the usual weights; a grey one stays."""
    return pixels if pixels.ndim == 2 else (pixels @ np.array([299, 587, 114])) // 1000


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the areas that the new samples cover, with fractional edges, read off the integral image; float64."""
    h, w = pixels.shape

    def edges(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.linspace(0, size, n + 1)
        low = np.minimum(edge.astype(np.int64), size - 1)
        return low, (edge - low)[:, None]

    def between(below: np.ndarray, above: np.ndarray, share: np.ndarray) -> np.ndarray:
        return np.diff(below * (1 - share) + above * share, axis=0)

    low, share = edges(height, h)
    lines = _integral_lines(pixels, np.unique(np.concatenate([low, low + 1])))
    tall = between(np.array([lines[i] for i in low.tolist()]), np.array([lines[i] for i in (low + 1).tolist()]), share).T
    low, share = edges(width, w)
    return between(tall[low], tall[low + 1], share).T / ((h / height) * (w / width))


def _integral_lines(pixels: np.ndarray, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """The wanted lines of the integral image, which is summed up in strips, so that a tall image takes no more memory than its samples."""
    h, w = pixels.shape
    lines, carry = {0: np.zeros(w + 1)}, np.zeros(w + 1)
    strip = max(1, STRIP // w)
    for top in range(0, h, strip):
        end = min(top + strip, h)
        own = np.zeros((end - top, w + 1))
        np.cumsum(np.cumsum(pixels[top:end], 0, dtype=np.float64), 1, out=own[:, 1:])
        own += carry
        lines |= {int(i): own[i - top - 1].copy() for i in wanted[(wanted > top) & (wanted <= end)].tolist()}
        carry = own[-1]
    return lines


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 8 areas is brighter than its right neighbour, of the image resized to 8 x 9."""
    small = np.round(resize(grey(pixels), 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def tiles(pixels: np.ndarray, side: int) -> list[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of the tiles of side x side samples; those at the edge are smaller."""
    out = []
    for r in range(0, pixels.shape[0], side):
        for c in range(0, pixels.shape[1], side):
            held = io.BytesIO()
            np.save(held, np.ascontiguousarray(pixels[r : r + side, c : c + side]), allow_pickle=False)
            out.append((r // side, c // side, held.getvalue()))
    return out


def image_features(images: DataFrame, side: int = 64, size: int = 64) -> DataFrame:
    """images(id long, data binary) to id, height, width, bands, dhash, and the NPY tiles of the grey image resized to size x size. Broken or null images give nulls."""

    def run(rows: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("id", "height", "width", "bands", "dhash", "tiles")}
        for key, data in zip(rows["id"], rows["data"]):
            try:
                pixels = decode(data or b"")
                found = (*pixels.shape[:2], 3 if pixels.ndim == 3 else 1, difference_hash(pixels), [{"row": r, "col": c, "npy": b} for r, c, b in tiles(np.round(resize(grey(pixels), size, size)).astype(np.uint8), side)])
            except (ValueError, IndexError, struct.error):
                found = (None,) * 5
            for k, v in zip(out, (key, *found)):
                out[k].append(v)
        return out

    return map_rows(images.select("id", "data"), "id long, height int, width int, bands int, dhash string, tiles array<struct<row:int,col:int,npy:binary>>", run)


def payload(data: bytes) -> bytes:
    size = max(1, -(-len(data) // BLOCK)) * BLOCK
    return data.ljust(size, b"\xff")


def text_images(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """documents to doc_id, n_bytes, media (the stored image) as binary."""
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def run(rows: dict[str, list]) -> dict[str, object]:
        data = [(t or "").encode("utf-8", "replace") for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "n_bytes": [len(d) for d in data], "media": [encode(np.frombuffer(payload(d), np.uint8).reshape(-1, WIDTH)) for d in data]}

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_bytes long, media binary", run)


def features(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """The texts' images written to the shared folder, read back, and cut to NPY tiles, which are written and read back in their turn.

    One row per document: digests and sizes of what was read, and the feature: the difference hash, and the crc32 of the tiles of the image
    resized to 16 x 16. Both tables stay there for the result, which reads the second."""

    def run(rows: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dhash", "tiles")}
        for doc, n, media in zip(rows["doc_id"], rows["n_bytes"], rows["media"]):
            pixels = decode(media)
            back = pixels.tobytes()
            cut = [npy for _, _, npy in tiles(np.round(resize(pixels, 16, 16)).astype(np.uint8), 8)]
            values = (doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(pixels), cut)
            for k, v in zip(out, values):
                out[k].append(v)
        return out

    media = stored(text_images(docs, form), "media")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tiles array<binary>"
    made = stored(map_rows(media.select("doc_id", "n_bytes", "media"), schema, run), "tiles")
    sums = F.crc32(F.concat(*[F.col("tiles")[k] for k in range(4)]))
    return made.select(*[c for c in made.columns if c not in ("dhash", "tiles")], F.concat_ws("-", "dhash", F.lpad(F.lower(F.hex(sums)), 8, "0")).alias("feature"))
