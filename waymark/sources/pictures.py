"""PNG pictures: decoding inside tasks, without an imaging library.

A picture's bytes are decoded as the format's public specification says: chunks,
inflate, the five scan-line filters, and samples of 1 to 16 bits in gray, colour,
palette or with alpha.  Interlaced and broken files give nulls, not errors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# The format's signature, and samples per pixel of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels of a picture at most: a few bytes of file can claim a huge one.
MOST_PIXELS = 1 << 26

_FACTS = "width int, height int, coverage double, opaque long, left int, top int, right int, bottom int"


def read_pictures(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """name (the file's name without folder and ending) and content of picture files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("name"), "content")


def _chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(raw):
        (n,) = struct.unpack_from(">I", raw, at)
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != struct.unpack_from(">I", raw, at + 8 + n)[0]:
            raise ValueError("broken chunk")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("no end")


def _unfiltered(data: bytes, height: int, row: int, step: int) -> np.ndarray:
    """The bytes of all scan lines with their filters undone."""
    lines = np.frombuffer(data, np.uint8)[: height * (row + 1)].reshape(height, row + 1)
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:]
        if kind == 0:
            own = line
        elif kind == 2:
            own = line + above
        elif kind == 1:  # each byte adds the one a pixel to its left: running sums per position in the pixel
            padded = np.zeros(-(-row // step) * step, np.uint8)
            padded[:row] = line
            own = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:row]
        elif kind in (3, 4):
            own = np.array(_sequential(kind, line.tolist(), above.tolist(), step), np.uint8)
        else:
            raise ValueError("unknown filter")
        out[y] = above = own
    return out


def _sequential(kind: int, line: list[int], above: list[int], step: int) -> list[int]:
    """The average and the Paeth filter, in which every byte needs the one before."""
    out = [0] * len(line)
    for i, v in enumerate(line):
        left, up, corner = (out[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        out[i] = (v + guess) & 255
    return out


def decode_alpha(raw: bytes) -> np.ndarray | None:
    """A picture's alpha from 0 to 1, a row per line; 1 throughout without transparency; None if it can't be read."""
    try:
        return _alpha(raw)
    except (ValueError, struct.error, zlib.error, IndexError):
        return None


def _alpha(raw: bytes) -> np.ndarray:
    if not raw.startswith(SIGNATURE):
        raise ValueError("no PNG")
    data, clear, header, palette = [], None, None, 0
    for kind, body in _chunks(raw):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = len(body) // 3
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
    if header is None:
        raise ValueError("no header")
    width, height, bits, colour, _, _, interlaced = header
    if not width or not height or width * height > MOST_PIXELS or interlaced or colour not in SAMPLES or bits not in (1, 2, 4, 8, 16) or bits < 8 and colour not in (0, 3):
        raise ValueError("unread kind")
    samples = SAMPLES[colour]
    row, step = -(-width * samples * bits // 8), max(1, samples * bits // 8)
    inflate = zlib.decompressobj()
    plain = inflate.decompress(b"".join(data), height * (row + 1))
    if len(plain) < height * (row + 1):
        raise ValueError("too short")
    lines = _unfiltered(plain, height, row, step)
    if bits == 16:
        values = lines.reshape(height, width * samples, 2).astype(np.int64) @ np.array([256, 1])
    elif bits == 8:
        values = lines.astype(np.int64)
    else:
        values = (np.unpackbits(lines, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits)[::-1])).astype(np.int64)[:, : width * samples]
    pixels = values.reshape(height, width, samples)
    if colour in (4, 6):
        return pixels[..., -1] / (2.0**bits - 1)
    out = np.ones((height, width))
    if clear is not None and colour == 3:
        if palette and pixels.max() >= palette:
            raise ValueError("no such colour")
        table = np.ones(256)
        table[: len(clear)] = np.frombuffer(clear, np.uint8) / 255.0
        out = table[pixels[..., 0]]
    elif clear is not None:  # one colour is fully transparent
        out[(pixels == np.array(struct.unpack(f">{samples}H", clear[: 2 * samples]))).all(-1)] = 0.0
    return out


def encode_png(pixels: np.ndarray, filters: list[int] | None = None) -> bytes:
    """A PNG of 8-bit pixels (height, width, samples), each line with the given filter, 0 by default."""
    height, width, samples = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[samples]
    lines = pixels.astype(np.uint8).reshape(height, -1)
    out, above = [], np.zeros(width * samples, np.int64)
    for y in range(height):
        own = lines[y].astype(np.int64)
        left, corner = (np.concatenate([np.zeros(samples, np.int64), x[:-samples]]) for x in (own, above))
        kind = (filters or [0])[y % len(filters or [0])]
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * own, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][kind]
        out.append(bytes([kind]) + ((own - guess) % 256).astype(np.uint8).tobytes())
        above = own

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(out))) + chunk(b"IEND", b"")


def bar_picture(width: int, height: int, seed: int) -> bytes:
    """A picture of known coverage: an upright bar of full alpha on the left, one pixel of a fifth beside it, all filters in turn."""
    pixels = np.zeros((height, width, 4), np.uint8)
    bar = seed % (width - 1)
    pixels[:, :bar] = (seed % 251, 90, 200, 255)
    pixels[seed % height, bar, 3] = 51
    return encode_png(pixels, [seed % 5, 4, 3, 2, 1, 0])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _FACTS.split(", ")]
    for batch in batches:
        rows = []
        for raw in batch.column("content"):
            alpha = decode_alpha(raw.as_py()) if raw.is_valid else None
            if alpha is None:
                rows.append((None,) * len(names))
                continue
            y, x = np.nonzero(alpha > 0)
            box = (int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1) if len(x) else (0, 0, 0, 0)
            rows.append((alpha.shape[1], alpha.shape[0], float(alpha.mean()), len(x), *box))
        kinds = {"int": pa.int32(), "double": pa.float64(), "long": pa.int64()}
        columns = [pa.array([r[i] for r in rows], kinds[c.split()[1]]) for i, c in enumerate(_FACTS.split(", "))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "content"), *columns], [*(c for c in batch.schema.names if c != "content"), *names])


def measured(pictures: DataFrame, key: str = "name") -> DataFrame:
    """``key``, width, height, coverage (mean alpha), opaque (pixels of any alpha) and the box that holds them.

    Of a picture that can't be read all but the key is null.
    """
    types = dict(pictures.dtypes)
    return pictures.select(key, "content").mapInArrow(_measured, f"{key} {types[key]}, {_FACTS}")


def drawn(df: DataFrame, key: str, width: Column, height: Column, draw: Callable[[int, int, int], bytes], seed: Column) -> DataFrame:
    """``key`` and content of a picture per row: the bytes that ``draw(width, height, seed)`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, s = (batch.column(c).to_pylist() for c in ("_w", "_h", "_s"))
            content = [draw(*args) for args in zip(w, h, s, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(content, pa.binary())], [key, "content"])

    own = df.select(key, width.cast("int").alias("_w"), height.cast("int").alias("_h"), seed.cast("long").alias("_s"))
    schema = own.select(key).schema.add("content", BinaryType())
    return own.mapInArrow(run, schema)
