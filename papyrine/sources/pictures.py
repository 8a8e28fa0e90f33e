"""What a writer has to know of a picture: its kind and its size in pixels, from the file's head."""

from __future__ import annotations

import struct
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

from papyrine.operators.markdown import target

Finder = Callable[[str], bytes | None]
REMOTE = ("http", "https", "data", "ftp")


def measure(data: bytes) -> tuple[str, int, int] | None:
    """(suffix, width, height) of a PNG, GIF, BMP or JPEG file; None for what is none of these."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return "bmp", width, abs(height)
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return "jpeg", width, height
        at += 2 + size
    return None


def found(src: str, finder: Finder | None, warnings: list[str]) -> tuple[bytes, str, int, int] | None:
    """(bytes, suffix, width, height) of the picture that a link points to; a warning says why there is none."""
    address = target(src)
    if finder is None or not address:
        return None
    if urlsplit(address).scheme.lower() in REMOTE:
        warnings.append(f"a remote picture is not fetched: {address}")
        return None
    data = finder(unquote(address))
    if data is None:
        warnings.append(f"the picture was not found: {src}")
        return None
    seen = measure(data)
    if seen is None:
        warnings.append(f"the picture could not be read: {src}")
        return None
    return data, *seen
