"""State of a library's root, the command line and originals found by their pixels."""

import json
import struct
from datetime import datetime

import numpy as np
import pytest

from tests.test_pixels import picture
from tidemark import cli, engine
from tidemark.operators import pairing
from tidemark.plans import executor, reports
from tidemark.sources import library, metadata

RUN = "run-20240201-100000-ab12cd"


def test_receipt_holds_each_run_once(spark, tmp_path):
    other = RUN.replace("0201", "0301")
    assert library.record_run(spark, str(tmp_path), RUN, 12, datetime(2024, 2, 1, 10)) == 1
    assert library.record_run(spark, str(tmp_path), other, 3) == 2 and library.record_run(spark, str(tmp_path), RUN, 12) == 2
    assert [r for r, _ in library._receipt(spark, str(tmp_path))] == [RUN, other]
    assert library.forget_run(spark, str(tmp_path), RUN) == 1 and library.forget_run(spark, str(tmp_path), RUN) == 1
    assert library.forget_run(spark, str(tmp_path), other) == 0 and not library.receipt_path(str(tmp_path)).exists()


def test_decisions_keep_their_answers(spark, tmp_path):
    rows = spark.createDataFrame([("misc", "placeholder", 3), ("tmp", "placeholder", 1)], "dir string, reason string, files long")
    assert library.decisions(spark, str(tmp_path)).count() == 0 and library.save_decisions(spark, str(tmp_path), rows) == 2
    file = library.decisions_path(str(tmp_path))
    file.write_text(file.read_text().replace("misc =", "misc = sort"))
    assert library.save_decisions(spark, str(tmp_path), rows) == 1
    assert [tuple(r) for r in library.decisions(spark, str(tmp_path)).collect()] == [("misc", "sort")]


def test_inbox_and_years(spark, tmp_path):
    with pytest.raises(NotADirectoryError):
        library.create_inbox(str(tmp_path / "none"))
    inbox = library.create_inbox(str(tmp_path))
    assert library.create_inbox(str(tmp_path)) == inbox and not (tmp_path / "none").exists()
    dirs = spark.createDataFrame([("НОВОЕ",), ("2011",), ("2014",), ("1899",), ("2014/x",)], "dir string")
    files = spark.createDataFrame([("НОВОЕ/a/b.jpg",), ("НОВОЕ.txt",)], "path string")
    assert tuple(library.inbox(dirs, files).first()) == (True, 1)
    assert library.shape(spark, str(tmp_path), dirs) == {"library": False, "years": ["2014", "2011"], "runs": 0}


def test_command_line_refuses_and_undoes(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark.__class__, "stop", lambda self: None)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/IMG_20140121_183801.mp3").write_bytes(b"ID3 x")
    assert cli.main(["rollback", str(tmp_path), RUN]) == 2
    assert cli.main(["apply", str(tmp_path), "--json"]) == 0
    run = json.loads(capsys.readouterr().out.strip().split("\n")[-1])["run_id"]
    assert library.shape(spark, str(tmp_path), spark.createDataFrame([], "dir string"))["runs"] == 1
    assert library.undoable(spark, str(tmp_path), run) is None and library.undoable(spark, str(tmp_path), "../..") == "outside"
    log = tmp_path / executor.RUNS_DIR / run / "journal.jsonl"
    whole = log.read_text()
    log.write_text("\n".join(whole.split("\n")[:-2]) + "\n")
    assert cli.main(["apply", str(tmp_path)]) == 3 and run in capsys.readouterr().out
    assert library.undoable(spark, str(tmp_path), run) == "not-undoable"
    log.write_text(whole)
    assert cli.main(["rollback", str(tmp_path), run]) == 0
    assert (tmp_path / "a/IMG_20140121_183801.mp3").exists() and not library.receipt_path(str(tmp_path)).exists()


def save_jpeg(spark, path, image, exif):
    """A JPEG of a picture with an EXIF directory, encoded by the JVM's own writer from a bitmap."""
    h, w = image.shape[:2]
    pad = -w * 3 % 4
    body = b"".join(row.tobytes() + b"\0" * pad for row in image[::-1])
    bitmap = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body
    jvm = spark.sparkContext._jvm
    read = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(bitmap)))
    jvm.javax.imageio.ImageIO.write(read, "jpg", jvm.java.io.File(str(path)))
    coded = path.read_bytes()
    path.write_bytes(coded[:2] + exif + coded[2:])


def tags(date, software=None):
    entry = lambda tag, text, at: struct.pack("<HHII", tag, 2, len(text), at)
    texts = [(0x0131, software.encode() + b"\0\0\0\0"), (0x0132, date.encode() + b"\0")] if software else [(0x9003, date.encode() + b"\0")]
    at, entries, data = 8 + 2 + 12 * len(texts) + 4, b"", b""
    for tag, text in texts:
        entries += entry(tag, text, at + len(data))
        data += text
    body = b"Exif\0\0II*\0" + struct.pack("<IH", 8, len(texts)) + entries + b"\0" * 4 + data
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


def test_pixel_original(spark, tmp_path):
    """A crop that an editor saved gets the date of the photo that it was cut from; a picture of something else gets none."""
    (tmp_path / "album one").mkdir()
    for i in range(4):
        save_jpeg(spark, tmp_path / f"album one/p{i}.jpg", picture(i), tags(f"2013:07:0{i + 1} 10:00:00"))
    save_jpeg(spark, tmp_path / "album one/crop.jpg", np.ascontiguousarray(picture(2)[:192, 32:288]), tags("2014:02:09 11:09:09", "Adobe Photoshop CS3"))
    save_jpeg(spark, tmp_path / "album one/other.jpg", picture(99), tags("2014:02:09 11:09:09", "Adobe Photoshop CS3"))
    found = engine.scan(spark, str(tmp_path))
    raw = metadata.read_raw(found.assets, str(tmp_path))
    rows = {r.path.split("/")[1]: r for r in engine.annotate(found.assets, 2026, raw, str(tmp_path)).collect()}
    assert (rows["crop.jpg"].winner, rows["crop.jpg"].date) == ("pixel-original", "2013-07-03 10:00:00")
    assert rows["other.jpg"].winner != "pixel-original"
    made = engine.make_plan(found, engine.annotate(found.assets, 2026, raw))
    lines = list(reports.plan_report(made, "root"))
    assert lines[0] == "Plan for root" and "\nMoves" in lines and sum(" -> " in x for x in lines) == 6


def test_nomination_widens_and_counts_what_it_cuts(spark):
    """Pools stop at the first full level, are cut by path and say how many there were; the own directory counts without what is below it."""
    photos = [("a/b/1.jpg", "X", "2013-01-01"), ("a/b/c/2.jpg", None, "2013-01-02"), ("a/3.jpg", "X", "2013-02-01"), ("a/4.jpg", "Y", "2013-01-01"), ("a/5.jpg", "X", "2015-01-01"), ("6.jpg", "X", "2012-01-01")]
    candidates = spark.createDataFrame(photos, "path string, model string, day string")
    queries = spark.createDataFrame([("a/b/q.jpg", "X", "2014-02"), ("a/b/r.jpg", None, None), ("s.jpg", None, None), ("z/y/x/t.jpg", "X", None)], "path string, model string, latest string")
    rows = {}
    for r in pairing.nominate(queries, candidates, most=2).orderBy("query", "candidate").collect():
        rows.setdefault((r.query, r.level, r.available), []).append(r.candidate)
    assert rows == {("a/b/q.jpg", 1, 3): ["a/3.jpg", "a/b/1.jpg"], ("a/b/r.jpg", 1, 5): ["a/3.jpg", "a/4.jpg"]}
