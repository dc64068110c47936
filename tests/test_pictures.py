"""PNG decoding against pictures made here, of every kind that is read."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest

from waymark.sources.pictures import SIGNATURE, decode_alpha, encode_png, measured, read_pictures


def png(width, height, bits, colour, lines, extra=(), interlaced=0, cut=None):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    data = zlib.compress(b"".join(b"\0" + line for line in lines))
    body = b"".join(chunk(b"IDAT", data[i : i + 7]) for i in range(0, len(data), 7))  # many chunks are one stream
    raw = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlaced)) + b"".join(chunk(k, b) for k, b in extra) + body + chunk(b"IEND", b"")
    return raw[:cut]


@pytest.mark.parametrize("samples", [1, 2, 3, 4])
@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0]])
def test_filters(samples, filters):
    pixels = np.random.default_rng(samples).integers(0, 256, (9, 7, samples))
    alpha = decode_alpha(encode_png(pixels, filters))
    want = pixels[..., -1] / 255 if samples in (2, 4) else np.ones((9, 7))
    np.testing.assert_allclose(alpha, want)


def test_palette_with_alpha_at_all_depths():
    for bits in (1, 2, 4, 8):
        n = min(4, 1 << bits)
        wide = [random.Random(y).randrange(n) for y in range(5)]
        packed = "".join(f"{v:0{bits}b}" for v in wide).ljust(-(-5 * bits // 8) * 8, "0")
        line = bytes(int(packed[i : i + 8], 2) for i in range(0, len(packed), 8))
        raw = png(5, 2, bits, 3, [line, line], [(b"PLTE", bytes(3 * n)), (b"tRNS", bytes([0, 51]))])
        assert decode_alpha(raw).tolist() == [[[0.0, 0.2, 1.0, 1.0][v] for v in wide]] * 2


def test_sixteen_bits_and_one_clear_colour():
    raw = png(2, 1, 16, 6, [struct.pack(">8H", 1, 2, 3, 65535, 4, 5, 6, 13107)])
    np.testing.assert_allclose(decode_alpha(raw), [[1.0, 0.2]])
    assert decode_alpha(png(3, 1, 8, 2, [bytes([1, 2, 3, 4, 5, 6, 1, 2, 3])], [(b"tRNS", struct.pack(">3H", 1, 2, 3))])).tolist() == [[0.0, 1.0, 0.0]]
    assert decode_alpha(png(3, 1, 2, 0, [bytes([0b01101100])], [(b"tRNS", struct.pack(">H", 2))])).tolist() == [[1.0, 0.0, 1.0]]


def test_what_cannot_be_read_is_none():
    good = encode_png(np.full((4, 4, 4), 7), [4])
    bad = bytearray(good)
    bad[len(good) // 2] ^= 1
    for raw in (b"", b"GIF89a", good[:20], good[:-12], bytes(bad), png(4, 4, 8, 6, [bytes(16)] * 4, interlaced=1), png(4, 4, 8, 6, [bytes(16)] * 2), png(1 << 20, 1 << 20, 8, 0, [b"x"]), png(0, 1, 8, 0, [b""]), png(2, 1, 3, 0, [b"xx"]), png(2, 1, 8, 3, [b"\5\0"], [(b"PLTE", bytes(6)), (b"tRNS", b"\0")])):
        assert decode_alpha(raw) is None


def test_files_and_broken_rows(spark, tmp_path):
    pixels = np.zeros((4, 5, 4), int)
    pixels[1:3, 2:4, 3] = 255
    (tmp_path / "signs").mkdir()
    (tmp_path / "signs" / "TS1.png").write_bytes(encode_png(pixels))
    (tmp_path / "signs" / "TS2.png").write_bytes(b"broken")
    (tmp_path / "signs" / "notes.txt").write_bytes(b"no picture")
    got = {r.name: r for r in measured(read_pictures(spark, str(tmp_path))).collect()}
    assert set(got) == {"TS1", "TS2"}
    assert tuple(got["TS1"])[1:] == (5, 4, 0.2, 4, 2, 1, 4, 3)
    assert tuple(got["TS2"])[1:] == (None,) * 8
    df = spark.createDataFrame([("a", None, 1), ("b", b"", 2)], "name string, content binary, width int")
    assert [tuple(r)[1:] for r in measured(df).collect()] == [(None,) * 8] * 2
    empty = measured(spark.createDataFrame([("c", bytearray(encode_png(np.zeros((2, 2, 4), int))))], "name string, content binary")).first()
    assert tuple(empty)[1:] == (2, 2, 0.0, 0, 0, 0, 0, 0)
