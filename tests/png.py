"""PNG files written by hand, as no image library is at hand."""

import struct
import zlib


def _chunk(kind, data):
    body = kind + data
    return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))


def png(width, height, pixel, colour_type=2):
    """``pixel(x, y)`` gives the bytes of one pixel: 3 for RGB, 1 for grey, 4 for RGBA."""
    rows = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    header = struct.pack(">IIBBBBB", width, height, 8, colour_type, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", header)
        + _chunk(b"IDAT", zlib.compress(rows)) + _chunk(b"IEND", b"")
    )


def gradient(x, y):
    return (10 * x, 20 * y, 5)
