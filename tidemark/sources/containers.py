"""Where a file keeps its metadata: containers walked by their own structure, with seeks, so that picture data is never read.

`parts` gives ('exif', offset, size) of TIFF directories, ('xmp', offset, size) of XMP packets and ('size', width, height). What
merely looks like metadata (a thumbnail's own, bytes in picture data) is in no place that the structure leads to.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

Part = tuple[str, int, int]
_XMP_JPEG, _XMP_PNG = b"http://ns.adobe.com/xap/1.0/\0", b"XML:com.adobe.xmp\0"
#: Heads of TIFF files and of raw formats that are TIFF by another name.
TIFF = (b"II*\0", b"MM\0*", b"IIRO", b"IIRS", b"MMOR", b"IIU\0")
#: More entries than this in one table are damage.
ENTRIES = 4096


class View:
    """Bytes of a file by offset; counts what is read. Beyond the end there is nothing."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size, self.read = file, size, 0

    def at(self, offset: int, n: int) -> bytes:
        if offset < 0 or n <= 0 or offset >= self.size:
            return b""
        self.file.seek(offset)
        found = self.file.read(min(n, self.size - offset))
        self.read += len(found)
        return found


def boxes(view: View, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end of the payload) of the boxes of one level; a broken size ends it."""
    for _ in range(ENTRIES):
        head = view.at(start, 16)
        if len(head) < 8 or start + 8 > end:
            return
        size, payload = struct.unpack_from(">I", head)[0], start + 8
        if size == 1:
            if len(head) < 16:
                return
            size, payload = struct.unpack_from(">Q", head, 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < payload - start or start + size > end:
            return
        yield head[4:8], payload, start + size
        start += size


def _jpeg(view: View) -> Iterator[Part]:
    at = 2
    while len(head := view.at(at, 4)) == 4 and head[0] == 0xFF:
        if head[1] == 0xFF:  # a fill byte
            at += 1
            continue
        if head[1] in (0xD9, 0xDA):  # picture data begin
            return
        if head[1] == 0x01 or 0xD0 <= head[1] <= 0xD8:  # markers without a length
            at += 2
            continue
        size = struct.unpack(">H", head[2:])[0]
        if size < 2:
            return
        if head[1] == 0xE1:
            begin = view.at(at + 4, min(len(_XMP_JPEG), size - 2))
            if begin.startswith(b"Exif\0\0"):
                yield "exif", at + 10, size - 8
            elif begin == _XMP_JPEG:
                yield "xmp", at + 4 + len(_XMP_JPEG), size - 2 - len(_XMP_JPEG)
        elif 0xC0 <= head[1] <= 0xCF and head[1] not in (0xC4, 0xC8, 0xCC) and len(frame := view.at(at + 5, 4)) == 4:
            height, width = struct.unpack(">HH", frame)
            yield "size", width, height
        at += 2 + size


def _png(view: View) -> Iterator[Part]:
    at = 8
    while len(head := view.at(at, 8)) == 8:
        size, kind, begin = struct.unpack(">I", head[:4])[0], head[4:], at + 8
        if kind == b"IHDR" and len(frame := view.at(begin, 8)) == 8:
            yield "size", *struct.unpack(">II", frame)
        elif kind == b"eXIf":
            yield "exif", begin, size
        elif kind == b"iTXt" and (said := view.at(begin, min(size, 256))).startswith(_XMP_PNG):
            text = said[len(_XMP_PNG) + 2 :].split(b"\0", 2)  # after two flags: language, translated keyword, text
            if said[len(_XMP_PNG)] == 0 and len(text) == 3:
                skip = len(_XMP_PNG) + 2 + len(text[0]) + len(text[1]) + 2
                yield "xmp", begin + skip, size - skip
        elif kind == b"IEND":
            return
        at = begin + size + 4


def _riff(view: View) -> Iterator[Part]:
    at = 12
    while len(head := view.at(at, 8)) == 8:
        size, begin = struct.unpack("<I", head[4:])[0], at + 8
        if head[:4] == b"EXIF":
            skip = 6 if view.at(begin, 6) == b"Exif\0\0" else 0
            yield "exif", begin + skip, size - skip
        elif head[:4] == b"XMP ":
            yield "xmp", begin, size
        at = begin + size + (size & 1)


def _items(view: View, start: int, end: int) -> dict[int, bytes]:
    """item -> type ('mime' items as their content type) of an iinf box."""
    head = view.at(start, 8)
    if len(head) < 8:
        return {}
    first = start + (6 if head[0] == 0 else 8)
    found = {}
    for kind, a, b in boxes(view, first, end):
        body = view.at(a, min(b - a, 512))
        if kind == b"infe" and len(body) >= 12 and body[0] in (2, 3):
            wide = 4 if body[0] == 3 else 2
            item, what = int.from_bytes(body[4 : 4 + wide], "big"), body[6 + wide : 10 + wide]
            if what == b"mime":
                names = body[10 + wide :].split(b"\0")
                what = names[1] if len(names) > 1 else what
            found[item] = what
    return found


def _places(view: View, start: int, end: int, data: int) -> dict[int, tuple[int, int]]:
    """item -> (offset, size) of items of one extent in an iloc box; data: begin of the idat box's payload."""
    body = view.at(start, min(end - start, 1 << 20))
    if len(body) < 8:
        return {}
    version, sizes, at = body[0], struct.unpack_from(">H", body, 4)[0], 6
    of_offset, of_length, of_base, of_index = (sizes >> shift & 15 for shift in (12, 8, 4, 0))
    wide = 4 if version == 2 else 2

    def number(n: int) -> int:
        nonlocal at
        if at + n > len(body):
            raise ValueError("the table ends early")
        at += n
        return int.from_bytes(body[at - n : at], "big")

    found = {}
    try:
        for _ in range(min(number(wide), ENTRIES)):
            item, method = number(wide), number(2) & 15 if version else 0
            number(2)
            base, extents = number(of_base), []
            for _ in range(number(2)):
                if version:
                    number(of_index)
                extents.append((number(of_offset), number(of_length)))
            if len(extents) == 1 and method in (0, 1):
                found[item] = (base + extents[0][0] + (data if method else 0), extents[0][1])
    except ValueError:
        pass
    return found


def _heif(view: View) -> Iterator[Part]:
    for kind, a, b in boxes(view, 0, view.size):
        if kind != b"meta":
            continue
        inner = {k: (x, y) for k, x, y in boxes(view, a + 4, b)}
        if b"iinf" in inner and b"iloc" in inner:
            places = _places(view, *inner[b"iloc"], inner.get(b"idat", (0, 0))[0])
            for item, what in _items(view, *inner[b"iinf"]).items():
                if item in places:
                    at, size = places[item]
                    if what == b"Exif" and len(skip := view.at(at, 4)) == 4:
                        ahead = 4 + struct.unpack(">I", skip)[0]
                        yield "exif", at + ahead, size - ahead
                    elif what == b"application/rdf+xml":
                        yield "xmp", at, size


def parts(view: View) -> Iterator[Part]:
    """The metadata of a JPEG, PNG, WebP, HEIF or TIFF file or an XMP text; nothing for what is none of them."""
    head = view.at(0, 16)
    if head[:2] == b"\xff\xd8":
        yield from _jpeg(view)
    elif head[:8] == b"\x89PNG\r\n\x1a\n":
        yield from _png(view)
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        yield from _riff(view)
    elif head[4:8] == b"ftyp":
        yield from _heif(view)
    elif head[:4] in TIFF:
        yield "exif", 0, view.size
    elif head.removeprefix(b"\xef\xbb\xbf").lstrip()[:1] == b"<":
        yield "xmp", 0, view.size
