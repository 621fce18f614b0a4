"""File kinds from names and leading bytes, as one CASE in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.functions import values as V

#: Magic bytes in order: offset (from 0), bytes in hex, kind, format.
MAGIC = (
    (0, "FFD8", "photo", "jpeg"), (0, "89504E470D0A1A0A", "photo", "png"), (0, "47494638", "photo", "gif"), (0, "38425053", "photo", "psd"), (0, "49492A00", "photo", "tiff"), (0, "4D4D002A", "photo", "tiff"),
    (0, "424D", "photo", "bmp"), (0, "0000000C6A502020", "photo", "jp2"), (0, "FF4FFF51", "photo", "jp2"),
)
LATER_MAGIC = ((0, "1A45DFA3", "video", "matroska"), (0, "3026B275", "video", "asf"), (0, "000001BA", "video", "mpeg-ps"))
LAST_MAGIC = ((0, "4F676753", "audio", "ogg"), (0, "494433", "audio", "mp3"), (0, "FFFB", "audio", "mp3"), (0, "FFF3", "audio", "mp3"), (0, "2321414D52", "audio", "amr"))
RIFF = (("57454250", "photo", "webp"), ("41564920", "video", "avi"), ("57415645", "audio", "wav"))


def _at(head: Column, offset: int, n: int) -> Column:
    return F.hex(F.substring(head, offset + 1, n))


def is_transport_stream(head: Column) -> Column:
    sync = lambda a, b: (_at(head, a, 1) == "47") & (_at(head, b, 1) == "47")
    return sync(0, 188) | sync(4, 196)


def identify(name: Column, head: Column) -> Column:
    """struct<kind,format> of a file name and its first SNIFF_BYTES bytes."""
    made = lambda kind, fmt: F.struct(F.lit(kind).alias("kind"), (fmt if isinstance(fmt, Column) else F.lit(fmt).cast("string")).alias("format"))
    out = F.when(paths.is_junk_name(name), made("junk", None))
    for offset, magic, kind, fmt in MAGIC:
        out = out.when(_at(head, offset, len(magic) // 2) == magic, made(kind, fmt))
    brand = F.trim(F.lower(F.decode(F.substring(head, 9, 4), "ISO-8859-1")))
    box = _at(head, 4, 4) == "66747970"
    out = out.when(box & brand.isin(*V.PHOTO_BRANDS), made("photo", "heic")).when(box, made("video", F.coalesce(F.nullif(brand, F.lit("")), F.lit("mp4"))))
    for magic, kind, fmt in RIFF:
        out = out.when((_at(head, 0, 4) == "52494646") & (_at(head, 8, 4) == magic), made(kind, fmt))
    for offset, magic, kind, fmt in LATER_MAGIC:
        out = out.when(_at(head, offset, len(magic) // 2) == magic, made(kind, fmt))
    out = out.when(is_transport_stream(head), made("video", "mpeg-ts"))
    for offset, magic, kind, fmt in LAST_MAGIC:
        out = out.when(_at(head, offset, len(magic) // 2) == magic, made(kind, fmt))
    return out.when(_at(head, 0, 2).rlike("^FF(F0|F1|F8|F9)$"), made("audio", "aac")).otherwise(made("other", None))
