"""Pixels of image files, decoded in tasks.

Pixels are dictionaries with height, width, nChannels, mode and data, blue first, as Spark's
image source has them. Pillow decodes where it is installed; without it PNG files of eight bits
a channel can be read, which need no more than zlib.
"""

from __future__ import annotations

import zlib
from io import BytesIO

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 6: 4}  # grey, RGB, RGB with alpha


class NoCodec(RuntimeError):
    """No decoder is there for a kind of file; that is not a fault of the file."""


def as_pixels(array: np.ndarray) -> dict:
    """A height x width x channels array of bytes, red first, as pixels."""
    height, width, channels = array.shape
    if channels >= 3:
        array = np.concatenate([array[:, :, 2::-1], array[:, :, 3:]], axis=2)
    return {
        "height": height, "width": width, "nChannels": channels, "mode": 8 * (channels - 1),
        "data": np.ascontiguousarray(array).tobytes(),
    }


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """One row of a PNG, given as pixels x channels, with its filter undone."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, axis=0, dtype=np.uint8)
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise ValueError(f"row filter {kind}")
    done = np.zeros((len(row) + 1, row.shape[1]), np.int64)
    up = np.concatenate([np.zeros((1, row.shape[1]), np.int64), above.astype(np.int64)])
    for x in range(len(row)):
        left, over, corner = done[x], up[x + 1], up[x]
        if kind == 3:
            guess = (left + over) // 2
        else:
            a, b, c = abs(over - corner), abs(left - corner), abs(left + over - 2 * corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, over, corner))
        done[x + 1] = (row[x] + guess) & 255
    return done[1:].astype(np.uint8)


def _png(content: bytes) -> dict:
    at, header, packed = len(_PNG), b"", []
    while at < len(content):
        size = int.from_bytes(content[at:at + 4], "big")
        kind, body = content[at + 4:at + 8], content[at + 8:at + 8 + size]
        if kind == b"IHDR":
            header = body
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    if len(header) != 13:
        raise ValueError("not a whole PNG file")
    width, height = int.from_bytes(header[:4], "big"), int.from_bytes(header[4:8], "big")
    depth, colour, interlaced = header[8], header[9], header[12]
    if depth != 8 or colour not in _CHANNELS or interlaced:
        raise NoCodec("install Pillow on the executors for PNG files of this kind, or pass a decoder")
    channels = _CHANNELS[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    above, done = np.zeros((width, channels), np.uint8), []
    for row in rows:
        above = _unfiltered(int(row[0]), row[1:].reshape(width, channels), above)
        done.append(above)
    return as_pixels(np.stack(done))


def decode_image(content: bytes) -> dict:
    """Pixels of an image file; raises ValueError for a broken one, NoCodec for a kind it cannot read."""
    try:
        from PIL import Image, UnidentifiedImageError
    except ImportError:
        if content.startswith(_PNG):
            try:
                return _png(content)
            except zlib.error as failure:
                raise ValueError(str(failure)) from failure
        if content[:3] == b"\xff\xd8\xff" or content[:4] in (b"GIF8", b"RIFF") or content[:2] == b"BM":
            raise NoCodec("install Pillow on the executors for JPEG, GIF, WebP and BMP files, or pass a decoder") from None
        raise ValueError("not an image") from None
    try:
        with Image.open(BytesIO(content)) as image:
            return as_pixels(np.asarray(image.convert("RGB")))
    except (UnidentifiedImageError, OSError) as failure:
        raise ValueError(str(failure)) from failure
