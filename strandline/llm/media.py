"""Bytes as PNG pictures in a binary column, and low-frequency cosine hashes of them (operator 9).

A payload becomes an 8-bit grey picture of ``WIDTH`` samples a row. The writer makes the chunks itself (length, type,
data, CRC-32), filters each row as none, sub or up, by the smallest sum of absolute differences, and packs them with
zlib. The reader tests every chunk's checksum, unpacks, and undoes all five row filters with numpy. The hash shrinks
the picture to 32 x 32 means, takes the 8 x 8 lowest frequencies of its cosine transform, and sets a bit for each
coefficient above the median of those other than the mean.

Cases: null texts count as empty; an empty text is one row of zeros; equal texts give equal pictures and features;
repeated rows repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_arrow, written

WIDTH = 64
LEVEL = 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
KEYWORD = b"Bytes"
SIDE, LOW = 32, 8
_COSINES = np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes, n_bytes: int) -> bytes:
    """Grey picture of a payload whose length is a multiple of WIDTH; n_bytes goes to a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    up[1:] = rows[:-1]
    kinds = np.stack([rows, rows - left, rows - up])
    cost = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = kinds[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    text = KEYWORD + b"\0" + str(n_bytes).encode()
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", text) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> tuple[np.ndarray, int | None]:
    """(rows of samples, bytes from the text chunk) of an 8-bit grey picture; ValueError if it is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, size, n_bytes, ended = 8, [], None, None, False
    while at < len(data) and not ended:
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        at += 12 + n
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlaced) != (8, 0, 0):
                raise ValueError("not an 8-bit grey picture without interlacing")
            size = height, width
        elif kind == b"tEXt" and body.startswith(KEYWORD + b"\0"):
            n_bytes = int(body[len(KEYWORD) + 1 :])
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
    if size is None or not ended:
        raise ValueError("the picture is cut short")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(lines) != size[0] * (size[1] + 1):
        raise ValueError("the picture has not as many samples as it says")
    lines = lines.reshape(size[0], size[1] + 1)
    return unfiltered(lines[:, 0], lines[:, 1:]), n_bytes


def unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Samples of filtered rows: runs of rows with one filter at a time, or by diagonals where a filter looks at samples
    of two rows at once."""
    if (kinds > 4).any():
        raise ValueError(f"no row filter {kinds.max()}")
    if (kinds > 2).any():
        return _by_diagonals(kinds, lines)
    out = lines.copy()
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)]):
        if a < b and kinds[a] == 1:
            out[a:b] = np.cumsum(lines[a:b], axis=1, dtype=np.uint8)
        elif a < b and kinds[a] == 2:
            out[a:b] = np.cumsum(lines[a:b], axis=0, dtype=np.uint8) + (out[a - 1] if a else np.uint8(0))
    return out


def _by_diagonals(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """All five filters: a sample needs those at its left, above, and above left, which are on the two diagonals before."""
    n, width = lines.shape
    out = np.zeros((n + 1, width + 1), np.uint8)
    for d in range(n + width - 1):
        x = np.arange(max(0, d - n + 1), min(width, d + 1))
        r = d - x
        left, up, corner = (v.astype(np.int16) for v in (out[r + 1, x], out[r, x + 1], out[r, x]))
        near = [np.abs(left + up - corner - v) for v in (left, up, corner)]
        nearest = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        guess = np.choose(kinds[r], [np.zeros_like(left), left, up, (left + up) // 2, nearest])
        out[r + 1, x + 1] = lines[r, x] + guess.astype(np.uint8)
    return out[1:, 1:]


def cosine_hash(rows: np.ndarray) -> str:
    """64 bits of the lowest frequencies, as hex digits."""

    def means(x: np.ndarray) -> np.ndarray:
        n = len(x)
        if n < SIDE:
            return x[np.arange(SIDE) * n // SIDE]
        cuts = np.arange(SIDE + 1) * n // SIDE
        return np.add.reduceat(x, cuts[:-1], axis=0) / np.diff(cuts)[:, None]

    small = means(means(rows.astype(np.float64)).T).T
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()  # where they are zero, rounding must not decide
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): a picture of each text's padded UTF-8 bytes, written to the shared folder."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode("utf-8") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([write_png(padded(r), len(r)) for r in raw], pa.binary())], [id_col, "media"])

    return written(map_arrow(rows, fn, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, media binary"), "media")


def read(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload, media, feature) of stored pictures, after their checksums are tested."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [read_png(m) for m in batch.column(1).to_pylist()]
        columns = [pa.array([n for _, n in got], pa.int64()), pa.array([r.tobytes() for r, _ in got], pa.binary()), batch.column(1), pa.array([cosine_hash(r) for r, _ in got], pa.string())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_bytes", "payload", "media", "feature"])

    schema = f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, n_bytes long, payload binary, media binary, feature string"
    return map_arrow(media.select(id_col, "media"), fn, schema)
