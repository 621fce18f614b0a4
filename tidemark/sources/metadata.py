"""Dates and facts inside files: EXIF directories, XMP packets, MP4 movie headers, sidecars."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, paths
from tidemark.functions import values as V
from tidemark.operators.evidence import claim
from tidemark.sources import containers

_TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "modified", 0x9003: "original", 0x0100: "width", 0x0101: "height", 0xA002: "width", 0xA003: "height"}
RAW = "make string, model string, software string, original string, modified string, width int, height int, document_id string, derived_from string, xmp_modified string, xmp_original string, container_s bigint"
_NAMES = [x.split()[0] for x in RAW.split(", ")]
_MOVIE_EPOCH, _LONGEST = 2_082_844_800, 1 << 16


def _directory(view: containers.View, base: int, at: int, order: str, found: dict, seen: set[int]) -> None:
    """One TIFF image file directory and the EXIF directory that it points to; offsets count from base."""
    head = view.at(base + at, 2)
    if at in seen or len(head) < 2:
        return
    seen.add(at)
    (count,) = struct.unpack(f"{order}H", head)
    entries = view.at(base + at + 2, 12 * count)
    for i in range(len(entries) // 12):
        tag, kind, n = struct.unpack_from(f"{order}HHI", entries, 12 * i)
        value = entries[12 * i + 8 : 12 * i + 12]
        (there,) = struct.unpack(f"{order}I", value)
        if tag == 0x8769:
            _directory(view, base, there, order, found, seen)
        elif tag == 0x02BC and kind in (1, 7):
            found["xmp"] = (base + there, n)
        elif name := _TAGS.get(tag):
            if kind == 2:
                if text := (value[:n] if n <= 4 else view.at(base + there, min(n, _LONGEST))).split(b"\0")[0].decode("latin-1").strip():
                    found[name] = text
            elif kind in (3, 4) and (number := struct.unpack(f"{order}H", value[:2])[0] if kind == 3 else there):
                found[name] = number


def _packet(xml: str) -> dict:
    """The XMP properties in use."""
    value = lambda p: (m := re.search(rf'{p}\s*=\s*"([^"]*)"|<{p}>([^<]*)<', xml)) and (m[1] or m[2])
    named = (("document_id", value("xmpMM:DocumentID")), ("derived_from", value("stRef:documentID")), ("xmp_modified", value("xmp:ModifyDate") or value("xmp:CreateDate")), ("xmp_original", next(filter(None, map(value, V.XMP_DATES)), None)), ("software", value("xmp:CreatorTool")))
    return {k: v for k, v in named if v}


def read_tags(view: containers.View) -> dict:
    """EXIF tags, the XMP properties in use and the frame size, from where the file's own structure has them; damage gives fewer tags, no error."""
    tags: dict = {}
    packet, frame = None, {}
    for kind, a, b in containers.parts(view):
        if kind == "size":
            frame = {"width": a, "height": b}
        elif kind == "xmp":
            packet = packet or (a, b)
        elif not tags and (head := view.at(a, 8))[:2] in (b"II", b"MM") and len(head) == 8:
            order = "<" if head[:2] == b"II" else ">"
            try:
                _directory(view, a, struct.unpack(f"{order}I", head[4:])[0], order, tags, set())
            except struct.error:
                pass
    packet = packet or tags.get("xmp")
    tags.pop("xmp", None)
    said = _packet(view.at(*packet).decode("utf-8", "replace")) if packet else {}
    return said | tags | frame


def movie_seconds(view: containers.View) -> int | None:
    """Creation time of an MP4 movie header in Unix seconds; unset or earlier than 1970 is none."""
    first = lambda kind, a, b: next(((x, y) for k, x, y in containers.boxes(view, a, b) if k == kind), None)
    if not (movie := first(b"moov", 0, view.size)) or not (header := first(b"mvhd", *movie)):
        return None
    body = view.at(header[0], 20)
    if len(body) < 12:
        return None
    seconds = struct.unpack_from(">Q" if body[0] == 1 else ">I", body, 4)[0]
    return seconds - _MOVIE_EPOCH if seconds > _MOVIE_EPOCH else None


def read_raw(assets: DataFrame, root: str) -> DataFrame:
    """(path, RAW columns) of media files and sidecars; unreadable files give nulls. Files are read by seeks, at the places where their structure keeps metadata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"width": pa.int32(), "height": pa.int32(), "container_s": pa.int64()}
        for batch in batches:
            rows = []
            for path, kind in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                tags: dict = {}
                try:
                    full = os.path.join(root, path)
                    with open(full, "rb") as file:
                        view = containers.View(file, os.path.getsize(full))
                        tags = {"container_s": movie_seconds(view)} if kind == "video" else read_tags(view)
                except (OSError, struct.error):
                    tags = {}
                rows.append(tags)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in _NAMES)], ["path", *_NAMES])

    wanted = F.col("kind").isin("photo", "video") | paths.is_sidecar(F.col("path"))
    return assets.filter(wanted).select("path", "kind").mapInArrow(run, f"path string, {RAW}")


def _parsed(text: Column, pattern: str, parts: int) -> Column:
    return dates.wall(*[F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in range(1, parts + 1)])


def exif_wall(text: Column) -> Column:
    return _parsed(text, r"^([0-9]{4}):([0-9]{2}):([0-9]{2})[ T]([0-9]{2}):([0-9]{2}):([0-9]{2})", 6)


def xmp_wall(text: Column) -> Column:
    """The local time as written; the offset is dropped."""
    return _parsed(text, r"^([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})", 6)


def sidecar_wall(text: Column) -> Column:
    """struct<wall,date_only> of a sidecar's capture date, with or without a time."""
    full = _parsed(text, r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]([0-9]{2}):([0-9]{2}):([0-9]{2})", 6)
    day = _parsed(F.trim(text), r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", 3)
    both = F.coalesce(full, day)
    return F.when(both.isNotNull(), F.struct(both.alias("wall"), full.isNull().alias("date_only")))


def xmp_capture_date(xml: Column) -> Column:
    """struct<wall,date_only> of the first capture property of an XMP text, as an attribute or an element."""
    texts = [F.regexp_extract(xml, pattern, 1) for prop in V.XMP_DATES for pattern in (rf'{prop}\s*=\s*"([^"]*)"', rf"<{prop}>([^<]*)<")]
    # one parser over an array of the texts, not one for each
    return F.get(F.filter(F.transform(F.array(*texts), sidecar_wall), F.isnotnull), F.lit(0))


def is_editor(software: Column) -> Column:
    return F.coalesce(software.rlike(V.EDITORS), F.lit(False))


def photo_claims(raw: DataFrame) -> Column:
    """Claims of a file's own metadata: the capture date, and the saved date as what it is worth."""
    original = exif_wall(F.col("original"))
    saved = F.coalesce(exif_wall(F.col("modified")), xmp_wall(F.col("xmp_modified")))
    edited = is_editor(F.col("software")) & original.isNull()
    instant = F.timestamp_seconds("container_s")
    return F.array_compact(F.array(
        claim("exif-original", original, detail="DateTimeOriginal"), F.when(edited, claim("editor-save", saved, detail=F.col("software"))), F.when(~edited, claim("exif-modify", saved, detail="DateTime")),
        claim("container-created", instant=instant, detail="mvhd"),
    ))


def facts(raw: DataFrame) -> DataFrame:
    return raw.select("path", "software", "make", "model", "width", "height", "document_id", "derived_from", is_editor(F.col("software")).alias("editor"))
