import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, identify, paths, words
from tidemark.operators import evidence
from tidemark.sources import metadata

NOW = 2026


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_walls_keep_second_60_and_check_the_calendar(spark):
    wall = lambda *p: one(spark, dates.format_wall(dates.wall(*map(F.lit, p))))
    assert wall(2013, 2, 28, 23, 59, 60) == "2013-02-28 23:59:60"
    assert wall(2016, 2, 29) == "2016-02-29 00:00:00"
    assert wall(2015, 2, 29) is None and wall(2000, 2, 29) is not None and wall(1900, 2, 29) is None
    assert wall(2013, 13, 1) is None and wall(2013, 1, 1, 24) is None and wall(0, 1, 1) is None


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("IMG_20140121_183801.jpg", [("filename-timestamp", "high", "android-camera", "2014-01-21 18:38:01"), ("filename-timestamp", "medium", "compact-anywhere", "2014-01-21 18:38:01")]),
        ("Screenshot_2017-05-27-19-34-56_app.png", [("filename-timestamp", "high", "screenshot", "2017-05-27 19:34:56"), ("filename-timestamp", "medium", "iso-date-anywhere", "2017-05-27 00:00:00"), ("filename-year", "low", "year-anywhere", "2017-01-01 00:00:00")]),
        ("IMG-20150102-WA0003.jpg", [("filename-timestamp", "high", "whatsapp", "2015-01-02 00:00:00")]),
        ("2013-07-19 18.08.41.jpg", [("filename-timestamp", "high", "ios-dotted", "2013-07-19 18:08:41"), ("filename-timestamp", "high", "leading-iso-date", "2013-07-19 00:00:00"), ("filename-timestamp", "medium", "iso-date-anywhere", "2013-07-19 00:00:00"), ("filename-year", "low", "year-anywhere", "2013-01-01 00:00:00")]),
        ("IMG_20141321_183801.jpg", []), ("IMG_20140121_253801.jpg", []), ("aB3dEf6hIjK.jpg", []), ("trip1899.jpg", []), (".2014-01-01", [("filename-timestamp", "medium", "iso-date-anywhere", "2014-01-01 00:00:00"), ("filename-year", "low", "year-anywhere", "2014-01-01 00:00:00")]),
    ],
)
def test_names(spark, name, expected):
    claims = one(spark, evidence.name_claims(F.lit(name), NOW))
    assert [(c.kind, c.confidence, c.detail, "{:04}-{:02}-{:02} {:02}:{:02}:{:02}".format(*c.wall)) for c in claims] == expected


def test_epoch_names(spark):
    ms = lambda name: one(spark, F.transform(evidence.name_claims(F.lit(name), NOW), lambda c: F.unix_millis(c["instant"])))
    assert ms("1374250121884.jpg") == [1374250121884]
    assert ms("photo1374250121.jpg") == [1374250121000]
    assert ms("x (1374250121).jpg") == [1374250121000]
    assert ms("1000000000.jpg") == [] and ms("99999999999.jpg") == []


@pytest.mark.parametrize(("path", "year", "season"), [("2013/Лето 2013/a.jpg", 2013, "лето"), ("2013/осень 2013/a.jpg", 2013, "осень"), ("2013/2012 зима/x/a.jpg", 2012, "зима"), ("2012/ОСЕНЬ/a.jpg", 2012, "осень"), ("none/a.jpg", None, None), ("a2013.jpg", None, None), ("1899/a.jpg", None, None)])
def test_directories(spark, path, year, season):
    found = one(spark, evidence.directory_claim(F.lit(path), NOW))
    assert (found and (found.wall.year, found.season)) == ((year, season) if year else None)


def test_paths(spark):
    at = lambda f, *a: one(spark, f(*map(F.lit, a)))
    assert at(paths.stem_of, "a.b.jpg") == "a.b" and at(paths.stem_of, ".nomedia") == ".nomedia"
    assert at(paths.ext_of, "A.JPG") == ".jpg" and at(paths.ext_of, ".nomedia") == ""
    assert at(paths.ancestors, "a/b/c.x") == ["a", "a/b"] and at(paths.ancestors, "c.x") == []
    assert at(paths.dir_of, "a/b/c.x") == "a/b" and at(paths.dir_of, "c.x") == ""
    assert all(at(paths.looks_like_a_copy, f"d/{n}.jpg") for n in ("x (1)", "x - копия", "x (КОПИЯ 2)", "x copy")) and not at(paths.looks_like_a_copy, "d/copyright.jpg")
    assert all(at(paths.is_technical, s) for s in ("DCIM", "100APPLE", "2013", "Лето 2013", "2013 (осень)", " ", "ПРОЧЕЕ")) and not at(paths.is_technical, "Отпуск 2013")
    assert at(paths.suspicion, "Разное") == "placeholder" and at(paths.suspicion, "Скриншоты") == "device" and at(paths.suspicion, "deadbeef00") is None and at(paths.suspicion, "2013") is None
    assert at(paths.suffixed, "a/b.jpg", 2) == "a/b (2).jpg"
    assert at(paths.same_path, "A/b/", "a\\B") and at(paths.is_inside, "C:\\a\\b", "c:/A") and not at(paths.is_inside, "ab", "a")
    assert at(paths.flat_name, "a/b.jpg") == "a__b.jpg" and at(paths.flat_name, "ПРОЧЕЕ/_мусор/b.jpg") == "b.jpg"


@pytest.mark.parametrize(("name", "head", "kind", "fmt"), [("a.x", b"\xff\xd8\xff", "photo", "jpeg"), ("thumbs.DB", b"\xff\xd8", "junk", None), ("a.THM", b"\xff\xd8", "junk", None), ("a", b"\x00\x00\x00\x18ftypheic", "photo", "heic"), ("a", b"\x00\x00\x00\x18ftypqt  ", "video", "qt"), ("a", b"RIFF\0\0\0\0AVI ", "video", "avi"), ("a", b"\x47" + b"\0" * 187 + b"\x47", "video", "mpeg-ts"), ("a", b"\xff\xf1", "audio", "aac"), ("a", b"", "other", None), ("a", b"#!AMR", "audio", "amr")])
def test_kinds(spark, name, head, kind, fmt):
    found = one(spark, identify.identify(F.lit(name), F.lit(head)))
    assert (found.kind, found.format) == (kind, fmt)


def test_words(spark):
    w = lambda f, n: one(spark, f(F.lit(n)))
    assert [w(lambda c: words.plural(c, "файл", "файла", "файлов"), n) for n in (1, 2, 5, 11, 21, 112)] == ["файл", "файла", "файлов", "файлов", "файл", "файлов"]
    assert [w(words.human_bytes, n) for n in (0.0, 1023.0, 1536.0, 150.0 * 1024, 3.5 * 1024**3, -1.0)] == ["0 Б", "1023 Б", "1.5 КБ", "150 КБ", "3.5 ГБ", "?"]
    assert [w(words.human_duration, n) for n in (900, 61_000, 3_720_000)] == ["1 с", "1 мин 1 с", "1 ч 2 мин"]


def test_sidecar_dates(spark):
    found = lambda xml: one(spark, metadata.xmp_capture_date(F.lit(xml)))
    assert found('<x exif:DateTimeOriginal="2014-02-09T11:09:09+03:00"/>').wall.hour == 11
    assert found("<photoshop:DateCreated>2014-02-09</photoshop:DateCreated>").date_only
    assert found('<x xmp:ModifyDate="2014-02-09T11:09:09"/>') is None
