import hashlib
import io
import zlib

import numpy as np
import pytest

from gridloom.llm import media

R = np.random.default_rng(0)


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (24, 24), (7, 13)])
def test_round_trips(shape):
    pixels = R.integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(media.encode_pgm(pixels)) == pixels).all()
    assert (media.decode(media.encode_bmp(pixels)) == pixels).all()


def test_other_formats():
    assert media.decode(b"P1\n# note\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 255 7 9").tolist() == [[7, 9]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    assert media.decode(b"P6 1 1 255\nabc").tolist() == [[[97, 98, 99]]]
    for broken in (b"", b"P5 9 9 255\nab", b"GIF89a", b"P5 x"):
        with pytest.raises(ValueError):
            media.decode(broken)


def area_mean(pixels, height, width):
    h, w = pixels.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            y0, y1, x0, x1 = i * h / height, (i + 1) * h / height, j * w / width, (j + 1) * w / width
            total = 0.0
            for y in range(h):
                for x in range(w):
                    total += pixels[y, x] * max(0, min(y1, y + 1) - max(y0, y)) * max(0, min(x1, x + 1) - max(x0, x))
            out[i, j] = total / ((y1 - y0) * (x1 - x0))
    return out


@pytest.mark.parametrize("shape, to", [((5, 7), (3, 2)), ((2, 2), (8, 9)), ((24, 24), (8, 9)), ((1, 24), (8, 9))])
def test_resize_equals_brute_force(shape, to):
    pixels = R.integers(0, 256, shape).astype(np.uint8)
    assert np.allclose(media.resize(pixels, *to), area_mean(pixels, *to))


def test_tiles():
    pixels = R.integers(0, 256, (10, 7)).astype(np.uint8)
    back = np.zeros_like(pixels)
    for r, c, npy in media.tiles(pixels, 4):
        part = np.load(io.BytesIO(npy))
        back[r * 4 : r * 4 + part.shape[0], c * 4 : c * 4 + part.shape[1]] = part
    assert (back == pixels).all()


def npy(tile):
    """A tile of bytes in the NPY format, version 1.0, by its definition."""
    head = ("{'descr': '|u1', 'fortran_order': False, 'shape': (%d, %d), }" % tile.shape).encode()
    head += b" " * (-(len(head) + 11) % 64) + b"\n"
    return b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head + bytes(int(v) for row in tile for v in row)


def plain_feature(whole):
    pixels = np.frombuffer(whole, np.uint8).reshape(-1, 24)
    small = np.round(area_mean(pixels, 8, 9), 6)
    bits = "".join("01"[int(small[i, j] > small[i, j + 1])] for i in range(8) for j in range(8))
    tile = np.round(area_mean(pixels, 16, 16)).astype(np.uint8)
    return f"{int(bits, 2):016x}-{zlib.crc32(b''.join(npy(tile[i : i + 8, j : j + 8]) for i in (0, 8) for j in (0, 8))):08x}"


def test_strips(monkeypatch):
    pixels = R.integers(0, 256, (500, 24)).astype(np.uint8)
    whole = media.resize(pixels, 16, 16)
    monkeypatch.setattr(media, "STRIP", 24 * 7)
    assert (media.resize(pixels, 16, 16) == whole).all() and np.allclose(whole, area_mean(pixels, 16, 16))


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_payloads_of_odd_rows(odd_docs, no_docs, form):
    rows = media.features(odd_docs, form).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd_docs.collect() if r["doc_id"] is not None}
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            data = texts[r["doc_id"]]
            whole = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
            assert r["media_bytes"] > r["payload_bytes"] and (len(data) > 5000 or r["feature"] == plain_feature(whole))
    same = {(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (2, 3)}
    assert len(same) == 1
    assert media.features(no_docs, form).collect() == []


def test_image_table(spark):
    pixels = R.integers(0, 256, (40, 30, 3)).astype(np.uint8)
    ppm = b"P6 30 40 255\n" + pixels.tobytes()
    rows = {r["id"]: r for r in media.image_features(spark.createDataFrame([(1, ppm), (2, b"broken"), (3, None)], "id long, data binary"), side=32, size=64).collect()}
    assert (rows[1]["height"], rows[1]["width"], rows[1]["bands"], len(rows[1]["tiles"])) == (40, 30, 3, 4) and rows[2]["dhash"] is None and rows[3]["tiles"] is None
