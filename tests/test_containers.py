"""Metadata where the structure of a file has it, decoys where it hasn't, and how much is read."""

import io
import struct
import zlib

import pytest

from tidemark.sources import containers, metadata


def tiff(date=b"2013:07:04 10:00:00\0", order="<", xmp=None):
    """A TIFF directory with a capture date in an EXIF directory of its own, a camera and, if asked for, an XMP tag."""
    pack = lambda f, *x: struct.pack(order + f, *x)
    entries = [(0x0110, 2, 4, b"X1\0\0"), (0x8769, 4, 1, None)] + ([(0x02BC, 1, len(xmp), None)] if xmp else [])
    after = 8 + 2 + 12 * len(entries) + 4
    inner = pack("H", 1) + pack("HHII", 0x9003, 2, len(date), after + 2 + 12 + 4) + b"\0" * 4 + date
    body = b"".join(pack("HHI", tag, kind, n) + (value or pack("I", after if tag == 0x8769 else after + len(inner))) for tag, kind, n, value in entries)
    return (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 8) + pack("H", len(entries)) + body + b"\0" * 4 + inner + (xmp or b"")


XMP = b'<x:xmpmeta><a xmpMM:DocumentID="doc1" stRef:documentID="doc0" xmp:CreatorTool="Picasa"/></x:xmpmeta>'
DECOY = b"Exif\0\0" + tiff(b"1999:01:01 00:00:00\0") + b"<x:xmpmeta xmpMM:DocumentID=\"wrong\"></x:xmpmeta>"
PIXELS = DECOY + bytes(range(256)) * 2000


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(b"\xff" + m + struct.pack(">H", len(b) + 2) + b for m, b in segments) + b"\xff\xda\0\2" + PIXELS + b"\xff\xd9"


def png(*chunks):
    one = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + b"".join(one(k, b) for k, b in [(b"IHDR", struct.pack(">IIBBBBB", 40, 30, 8, 2, 0, 0, 0)), (b"IDAT", PIXELS), *chunks, (b"IEND", b"")])


def webp(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for k, b in [(b"VP8 ", PIXELS + b"x"), *chunks])
    return b"RIFF" + struct.pack("<I", len(body)) + body


def heic(version=1, idat=False):
    box = lambda kind, body: struct.pack(">I", len(body) + 8) + kind + body
    infe = lambda item, what, name=b"\0": box(b"infe", b"\2\0\0\0" + struct.pack(">HH", item, 0) + what + name)
    exif = struct.pack(">I", 6) + b"Exif\0\0" + tiff(order=">")
    items = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 3) + infe(1, b"hvc1") + infe(2, b"Exif") + infe(3, b"mime", b"\0application/rdf+xml\0"))
    head = box(b"ftyp", b"heic\0\0\0\0heic")

    def table(first):
        rows = b""
        for item, at, n in ((1, 0, 4), (2, first, len(exif)), (3, first + len(exif), len(XMP))):
            rows += struct.pack(">H", item) + (struct.pack(">H", 1 if idat and item > 1 else 0) if version else b"") + struct.pack(">HH", 0, 1) + struct.pack(">II", at, n)
        return box(b"iloc", bytes([version, 0, 0, 0, 0x44, 0]) + struct.pack(">H", 3) + rows)

    inner = lambda first: box(b"meta", b"\0\0\0\0" + items + table(first) + (box(b"idat", exif + XMP) if idat else b""))
    if idat:
        return head + inner(0) + box(b"mdat", PIXELS)
    lead = len(head) + len(inner(0)) + 8 + len(PIXELS)
    return head + inner(lead) + box(b"mdat", PIXELS + exif + XMP)


WHOLE = {"original": "2013:07:04 10:00:00", "model": "X1", "document_id": "doc1", "derived_from": "doc0", "software": "Picasa"}
FILES = {
    "jpeg": (jpeg((b"\xe0", b"JFIF\0"), (b"\xe1", b"http://ns.adobe.com/xap/1.0/\0" + XMP), (b"\xe1", b"Exif\0\0" + tiff()), (b"\xed", DECOY), (b"\xc0", b"\x08" + struct.pack(">HH", 30, 40) + b"\0" * 10)), WHOLE | {"width": 40, "height": 30}),
    "jpeg without": (jpeg((b"\xed", DECOY)), {}),
    "png": (png((b"eXIf", tiff(order=">")), (b"iTXt", b"XML:com.adobe.xmp\0\0\0en\0\0" + XMP)), WHOLE | {"width": 40, "height": 30}),
    "png without": (png(), {"width": 40, "height": 30}),
    "webp": (webp((b"EXIF", b"Exif\0\0" + tiff()), (b"XMP ", XMP)), WHOLE), "webp without": (webp(), {}),
    "heic": (heic(), WHOLE), "heic 0": (heic(0), WHOLE), "heic idat": (heic(1, True), WHOLE), "tiff": (tiff(xmp=XMP) + PIXELS, WHOLE), "xmp": (XMP, {k: v for k, v in WHOLE.items() if k not in ("original", "model")}), "text": (b"Exif\0\0" + tiff(), {}), "empty": (b"", {}),
}


@pytest.mark.parametrize("name", FILES)
def test_tags_and_what_is_read(name):
    data, want = FILES[name]
    view = containers.View(io.BytesIO(data), len(data))
    assert metadata.read_tags(view) == want
    assert view.read < 4000  # picture data of half a megabyte aren't


@pytest.mark.parametrize("name", FILES)
def test_damage_is_no_error(name):
    data, _ = FILES[name]
    for cut in [*range(0, min(len(data), 1200), 7), len(data) - 3]:
        metadata.read_tags(containers.View(io.BytesIO(data[:cut]), max(cut, 0)))
    for at in range(0, min(len(data), 900), 5):
        bad = data[:at] + b"\xff\xfe\x00\x01" + data[at + 4 :]
        metadata.read_tags(containers.View(io.BytesIO(bad), len(bad)))
