"""PNG pages, and manifests inside image streams.

A stream is a list of parts (tag, offset, body).  A format names its reader, the
tag of the parts that may hold a manifest, the part before which a new one goes,
and how a part is written; embedding and extracting are the same for all.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Fixed values of the formats.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
JPEG_SIGNATURE = b"\xff\xd8"
KEYWORD = b"folio-manifest"
#: Largest manifest in bytes.
MOST = 48 * 1024

Part = tuple[bytes, int, bytes]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    h, w = gray.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), gray], axis=1)
    return PNG_SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_chunks(data: bytes) -> list[Part] | None:
    """(kind, offset, body) of every chunk; null if it is no complete PNG."""
    if not data.startswith(PNG_SIGNATURE):
        return None
    at, out = len(PNG_SIGNATURE), []
    while at + 12 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + n > len(data):
            return None
        out.append((data[at + 4 : at + 8], at, data[at + 8 : at + 8 + n]))
        at += 12 + n
    return out


def gray_of(data: bytes) -> np.ndarray:
    """The pixels of a PNG written by ``png``."""
    chunks = {k: b for k, _, b in png_chunks(data) or []}
    w, h = struct.unpack(">II", chunks[b"IHDR"][:8])
    return np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(h, w + 1)[:, 1:]


def jpeg(scan: bytes) -> bytes:
    """The segments of a gray JPEG around given scan data, without tables: a stream to embed in, not to decode."""
    return JPEG_SIGNATURE + b"\xff\xe0\x00\x04ab\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + scan.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def _jpeg_segments(data: bytes) -> list[Part] | None:
    """The header segments up to the scan, which comes last with all that follows; null if it is no JPEG with a scan."""
    if not data.startswith(JPEG_SIGNATURE):
        return None
    out, view = [], memoryview(data)
    at = len(JPEG_SIGNATURE)
    while at + 4 <= len(data):
        lead, tag, size = struct.unpack_from(">BBH", view, at)
        if lead != 0xFF or size < 2:
            return None
        if tag == 0xDA:
            return [*out, (b"\xda", at, bytes(view[at:]))]
        out.append((bytes([tag]), at, bytes(view[at + 4 : at + 2 + size])))
        at += 2 + size
    return None


@dataclass(frozen=True)
class Format:
    read: Callable[[bytes], list[Part] | None]
    holder: bytes
    #: Tag of the part the manifest goes before; empty for the first part.
    before: bytes
    write: Callable[[bytes], bytes]
    #: What stands between the keyword and the manifest.
    gap: bytes
    most: int


FORMATS = (
    Format(png_chunks, b"iTXt", b"IEND", lambda body: _chunk(b"iTXt", body), bytes(5), MOST),
    Format(_jpeg_segments, b"\xef", b"", lambda body: b"\xff\xef" + struct.pack(">H", len(body) + 2) + body, b"\0", MOST),
)


def _parsed(data: bytes) -> tuple[Format, list[Part]] | None:
    return next(((f, parts) for f in FORMATS if (parts := f.read(data))), None)


def embed(data: bytes, manifest: bytes) -> bytes:
    """The stream with the manifest as a part of its own; the pixels stay untouched.

    ValueError for a stream of no known format and for a manifest over MOST bytes.
    """
    parsed = _parsed(data)
    if parsed is None:
        raise ValueError("no complete image stream")
    f, parts = parsed
    if len(manifest) > f.most:
        raise ValueError("manifest over the limit")
    place = next((at for tag, at, _ in parts if tag == f.before or not f.before), None)
    if place is None:
        raise ValueError("image stream without an end")
    return b"".join((data[:place], f.write(KEYWORD + f.gap + manifest), data[place:]))


def extract(data: bytes) -> bytes | None:
    """The first manifest in a stream, null where it holds none."""
    f, parts = _parsed(data) or (None, [])
    return next((body[len(KEYWORD + f.gap) :] for tag, _, body in parts if tag == f.holder and body.startswith(KEYWORD + f.gap)), None)


#: How a page of each EXIF orientation is turned upright (quarter turns, then mirrored).
_UPRIGHT = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (3, True), 6: (3, False), 7: (1, True), 8: (1, False)}


def orientation(data: bytes | None) -> int:
    """The EXIF orientation of a JPEG, 1 (upright) where it names none."""
    for tag, _, body in _jpeg_segments(data or b"") or []:
        if tag != b"\xe1" or not body.startswith(b"Exif\0\0"):
            continue
        tiff = body[6:]
        end = {b"II": "<", b"MM": ">"}.get(tiff[:2])
        if end is None or len(tiff) < 8:
            return 1
        start = struct.unpack_from(end + "I", tiff, 4)[0]
        count = struct.unpack_from(end + "H", tiff, start)[0] if start + 2 <= len(tiff) else 0
        for k in range(min(count, (len(tiff) - start - 2) // 12)):
            name, kind, n, value = struct.unpack_from(end + "HHIH", tiff, start + 2 + 12 * k)
            if (name, kind, n) == (0x112, 3, 1) and value in _UPRIGHT:
                return value
    return 1


def upright(pixels: np.ndarray, value: int) -> np.ndarray:
    """Pixels (height, width, ...) turned as an EXIF orientation asks for."""
    turns, mirrored = _UPRIGHT.get(value, (0, False))
    turned = np.rot90(pixels, turns)
    return turned[:, ::-1] if mirrored else turned
