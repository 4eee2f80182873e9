"""PNG images to pixels, in Arrow batches: chunks, inflation, unfiltering, bit depths, palettes. What can't be read gives null and
a message; nothing is raised for a damaged image. Interlaced images aren't read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type, and the bit depths that go with it.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Pixels of an image at most; larger ones give a message, so that a forged header takes no memory.
MOST_PIXELS = 1 << 26


class Unreadable(ValueError):
    """Why an image can't be read."""


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at < len(data):
        if at + 12 > len(data):
            raise Unreadable("cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise Unreadable("a damaged chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise Unreadable("no end")


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes from filtered rows, of which the first byte names the filter; ``step`` bytes are a pixel, or one."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    up = np.zeros(out.shape[1], np.uint8)
    for y, line in enumerate(raw):
        kind, x = line[0], line[1:]
        if kind == 0:
            row = x
        elif kind == 1:
            padded = np.pad(x, (0, -len(x) % step)).reshape(-1, step)
            row = np.cumsum(padded, axis=0, dtype=np.uint8).ravel()[: len(x)]
        elif kind == 2:
            row = x + up
        elif kind in (3, 4):
            row = np.array(_from_left(x.tolist(), up.tolist(), step, kind == 4), np.uint8)
        else:
            raise Unreadable("an unknown filter")
        out[y] = up = row
    return out


def _from_left(x: list[int], up: list[int], step: int, paeth: bool) -> list[int]:
    """The filters whose value depends on the decoded byte to the left."""
    row = [0] * len(x)
    for i, v in enumerate(x):
        a, b = (row[i - step] if i >= step else 0), up[i]
        if paeth:
            c = up[i - step] if i >= step else 0
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if da <= db and da <= dc else b if db <= dc else c
        else:
            guess = (a + b) >> 1
        row[i] = v + guess & 255
    return row


@dataclass
class Packed:
    """An image's filtered rows as bytes, and how to read them."""

    size: tuple[int, int, int, int]  # height, width, samples of a pixel, bits of a sample
    colour: int
    raw: bytes
    palette: np.ndarray | None
    alpha: np.ndarray | None

    @property
    def wide(self) -> int:
        """Bytes of a row."""
        _, width, n, depth = self.size
        return (width * n * depth + 7) // 8

    @property
    def step(self) -> int:
        return max(1, self.size[2] * self.size[3] // 8)

    def filtered(self) -> np.ndarray:
        return np.frombuffer(self.raw, np.uint8).reshape(self.size[0], self.wide + 1)


def _unpack(data: bytes) -> Packed:
    if not data.startswith(SIGNATURE):
        raise Unreadable("not a PNG")
    head, palette, alpha, body = None, None, None, []
    for kind, chunk in _chunks(data):
        if kind == b"IHDR" and len(chunk) == 13:
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8)[: len(chunk) // 3 * 3].reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(chunk, np.uint8)
        elif kind == b"IDAT":
            body.append(chunk)
    if head is None:
        raise Unreadable("no header")
    width, height, depth, colour, _, _, interlaced = head
    if colour not in SAMPLES or depth not in DEPTHS[colour] or not width or not height:
        raise Unreadable("an invalid header")
    if interlaced:
        raise Unreadable("interlaced")
    if width * height > MOST_PIXELS:
        raise Unreadable("too many pixels")
    n = SAMPLES[colour]
    wide = (width * n * depth + 7) // 8
    need = height * (wide + 1)
    try:
        raw = zlib.decompressobj().decompress(b"".join(body), need)
    except zlib.error as error:
        raise Unreadable("damaged data") from error
    if len(raw) < need:
        raise Unreadable("too little data")
    return Packed((height, width, n, depth), colour, raw, palette, alpha)


def _picture(packed: Packed, rows: np.ndarray) -> np.ndarray:
    """The image of rows without filters."""
    (height, width, n, depth), colour, palette, alpha = packed.size, packed.colour, packed.palette, packed.alpha
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2).astype(np.uint8)[:, : width * n]
        if colour == 0:
            rows = rows * np.uint8(255 // ((1 << depth) - 1))
    image = rows.reshape(height, width, n)
    if colour != 3:
        return image
    if palette is None or image.max() >= len(palette):
        raise Unreadable("no such colour in the palette")
    if alpha is None:
        return palette[image[:, :, 0]]
    full = np.full(len(palette), 255, np.uint8)
    full[: len(alpha)] = alpha[: len(palette)]
    return np.concatenate([palette, full[:, None]], axis=1)[image[:, :, 0]]


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels (1 grey, 2 grey and alpha, 3 colours, 4 with alpha) of 8 bits; deeper samples lose their low
    byte, shallower ones are spread over 0 to 255, palettes become colours. Raises Unreadable."""
    packed = _unpack(data)
    return _picture(packed, _unfilter(packed.filtered(), packed.step))


#: Images of one size from which on they are unfiltered side by side.
ALIKE = 16


def _unfilter_alike(raw: np.ndarray, step: int) -> np.ndarray:
    """``_unfilter`` for several images of one size, and which of them have an unknown filter."""
    n, height, wide = len(raw), raw.shape[1], raw.shape[2] - 1
    out, up = np.zeros((n, height, wide), np.uint8), np.zeros((n, wide), np.uint8)
    for y in range(height):
        for kind in np.unique(raw[:, y, 0]):
            which = np.flatnonzero(raw[:, y, 0] == kind)
            x, above = raw[which, y, 1:], up[which]
            if kind == 1:
                row = np.pad(x, ((0, 0), (0, -wide % step))).reshape(len(x), -1, step).cumsum(1, dtype=np.uint8).reshape(len(x), -1)[:, :wide]
            elif kind == 2:
                row = x + above
            elif kind in (3, 4):
                row, left, corner = np.zeros_like(x), np.zeros((len(x), step), np.int16), np.zeros((len(x), step), np.int16)
                for at in range(0, wide, step):
                    b = above[:, at : at + step].astype(np.int16)
                    a, c = left[:, : b.shape[1]], corner[:, : b.shape[1]]
                    if kind == 3:
                        guess = (a + b) >> 1
                    else:
                        da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                        guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                    row[:, at : at + step] = x[:, at : at + step] + guess.astype(np.uint8)
                    left, corner = row[:, at : at + step].astype(np.int16), b
            else:
                row = x
            out[which, y] = row
        up = out[:, y]
    return out, (raw[:, :, 0] > 4).any(1)


def decode_all(items: list[bytes]) -> list[np.ndarray | str]:
    """``decode`` for many images at once: those of one size are unfiltered side by side. A text says why one can't be read."""
    out, alike = [""] * len(items), {}
    for i, data in enumerate(items):
        try:
            packed = _unpack(data)
            alike.setdefault(packed.size, []).append((i, packed))
        except Unreadable as error:
            out[i] = str(error)
    for group in alike.values():
        unfiltered = None
        if len(group) >= ALIKE:
            unfiltered, unknown = _unfilter_alike(np.stack([p.filtered() for _, p in group]), group[0][1].step)
        for k, (i, packed) in enumerate(group):
            try:
                if unfiltered is not None and unknown[k]:
                    raise Unreadable("an unknown filter")
                out[i] = _picture(packed, _unfilter(packed.filtered(), packed.step) if unfiltered is None else unfiltered[k])
            except Unreadable as error:
                out[i] = str(error)
    return out


#: Images that are decoded together, and bytes that they may take before and after, told by their headers.
TOGETHER, BYTES = 1024, 16 << 20


def _stretches(items: list[bytes]) -> Iterator[slice]:
    """Stretches of images to be decoded together: a large one goes alone."""
    first, size = 0, 0
    for i, data in enumerate(items):
        width, height = struct.unpack_from(">II", data, 16) if len(data) >= 24 else (0, 0)
        more = len(data) + 8 * min(width * height, MOST_PIXELS)
        if i > first and (size + more > BYTES or i - first == TOGETHER):
            yield slice(first, i)
            first, size = i, 0
        size += more
    if items:
        yield slice(first, len(items))


DECODED = pa.schema([("path", pa.string()), ("shape", pa.list_(pa.int32())), ("pixels", pa.binary()), ("message", pa.string())])


def decode_images(images: DataFrame) -> DataFrame:
    """(path, shape, pixels, message) of images (path, content). Shape is height, width, channels; of an image that can't be read,
    and of null content, shape and pixels are null, and the message says why."""

    def run(batches):
        for batch in batches:
            items = [content or b"" for content in batch.column("content").to_pylist()]
            for part in _stretches(items):
                decoded = decode_all(items[part])
                shapes = [None if isinstance(x, str) else list(x.shape) for x in decoded]
                pixels = [None if isinstance(x, str) else np.ascontiguousarray(x).tobytes() for x in decoded]
                why = [x if isinstance(x, str) else None for x in decoded]
                columns = [batch.column("path").slice(part.start, len(decoded)), shapes, pixels, why]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, DECODED, strict=True)], schema=DECODED)

    return images.select("path", "content").mapInArrow(run, "path string, shape array<int>, pixels binary, message string")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(image: np.ndarray, filters: list[int] | None = None, depth: int = 8) -> bytes:
    """A PNG of an image of 8 bits (depth 8 or 16), its rows filtered in turn by ``filters``."""
    return encode_all(image[None], filters, depth)[0]


def encode_all(images: np.ndarray, filters: list[int] | None = None, depth: int = 8) -> list[bytes]:
    """PNGs of several images of one size."""
    count, height, width, n = images.shape
    step, rows = n * depth // 8, np.repeat(images.reshape(count, height, width * n), depth // 8, axis=2).astype(np.int16)
    out, up = np.zeros((count, height, rows.shape[2] + 1), np.uint8), np.zeros((count, rows.shape[2]), np.int16)
    for y in range(height):
        row, kind = rows[:, y], (filters or [0])[y % len(filters or [0])]
        a, c = (np.concatenate([np.zeros((count, step), np.int16), x[:, :-step]], axis=1) for x in (row, up))
        if kind == 4:
            da, db, dc = np.abs(up - c), np.abs(a - c), np.abs(a + up - 2 * c)
            guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, up, c))
        else:
            guess = {0: 0, 1: a, 2: up, 3: (a + up) >> 1}[kind]
        out[:, y, 0], out[:, y, 1:] = kind, ((row - guess) & 255).astype(np.uint8)
        up = row
    head = SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0))
    tail = _chunk(b"IEND", b"")
    return [head + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + tail for rows in out]
