"""Golden cases, and the laws of plans: idempotence, inverse, equivalence, permutation, conservation."""

import random
import re
import struct
from datetime import datetime, timezone

import pytest

from tidemark import engine, schemas
from tidemark.operators import corpus, dedupe, evidence, pairing, verdict
from tidemark.plans import executor, plan
from tidemark.sources import cache, inventory, metadata, texts

NOW = 2026
DAY = datetime(2015, 1, 1, tzinfo=timezone.utc).timestamp() * 1000

ASSETS = [  # path, kind, content
    ("phone/IMG_20140121_183801.jpg", "photo", "a"), ("2013/осень 2013/leaf.jpg", "photo", "b"), ("2013/зима/snow.jpg", "photo", "c"), ("x/1374250121884.mp4", "video", "d"), ("x/aB3dEf6hIjK.jpg", "photo", "e"),
    ("deep/er/PTT-20160304-WA0001.ogg", "audio", "f"), ("2012/dup.jpg", "photo", "g"), ("2012/other/dup - копия.jpg", "photo", "g"), ("dup2.jpg", "photo", "g"), ("x/thumbs.db", "junk", "h"), ("docs/readme.txt", "other", "i"),
    ("misc/2001-05-05 a.jpg", "photo", "j"), ("misc/2002-07-05 b.jpg", "photo", "k"), ("one/2015-08-01.jpg", "photo", "l"), ("two/2015-08-01.jpg", "photo", "m"),
]


def assets_df(spark, rows=ASSETS):
    return spark.createDataFrame([(p, 1, DAY, k, None, c) for p, k, c in rows], schemas.struct(schemas.ASSET))


def dirs_df(spark, rows=ASSETS):
    found = {"/".join(p.split("/")[: i + 1]) for p, *_ in rows for i in range(p.count("/"))}
    return spark.createDataFrame([(d,) for d in sorted(found)], "dir string")


def planned(spark, rows=ASSETS, decisions=None, verdicts=None):
    assets = assets_df(spark, rows)
    return plan.build_plan(assets, verdicts or engine.annotate(assets, NOW), dirs_df(spark, rows), decisions)


@pytest.fixture(scope="module")
def verdicts(spark):
    return engine.annotate(assets_df(spark), NOW)


@pytest.fixture(scope="module")
def golden(spark, verdicts):
    made = planned(spark, verdicts=verdicts)
    return made, {r["from"]: r for r in made.operations.collect()}


def test_destinations(golden):
    made, ops = golden
    assert {k: v.to for k, v in ops.items()} == {
        "phone/IMG_20140121_183801.jpg": "2014/Зима начало года/phone/IMG_20140121_183801.jpg", "2013/осень 2013/leaf.jpg": "2013/Осень/leaf.jpg", "2013/зима/snow.jpg": "2013/прочее/snow.jpg",
        "x/1374250121884.mp4": "2013/Лето/видео/x/1374250121884.mp4", "x/aB3dEf6hIjK.jpg": "ПРОЧЕЕ/x/aB3dEf6hIjK.jpg", "deep/er/PTT-20160304-WA0001.ogg": "ПРОЧЕЕ/аудио/deep/er/PTT-20160304-WA0001.ogg",
        "2012/dup.jpg": "2012/прочее/dup.jpg", "2012/other/dup - копия.jpg": "ПРОЧЕЕ/_дубликаты/2012__other__dup - копия.jpg", "dup2.jpg": "ПРОЧЕЕ/_дубликаты/dup2.jpg", "x/thumbs.db": "ПРОЧЕЕ/_мусор/x__thumbs.db",
        "misc/2001-05-05 a.jpg": "НА_РАЗБОР/misc/2001-05-05 a.jpg", "misc/2002-07-05 b.jpg": "НА_РАЗБОР/misc/2002-07-05 b.jpg", "one/2015-08-01.jpg": "2015/Лето/one/2015-08-01.jpg", "two/2015-08-01.jpg": "2015/Лето/two/2015-08-01.jpg",
    }
    assert [r["from"] for r in made.stay.collect()] == ["docs/readme.txt"]
    assert [(r.dir, r.files) for r in made.suspicious.collect()] == [("misc", 2)]
    assert ("2013/зима/snow.jpg", "ambiguous-season") in {(r.path, r.issue) for r in made.disputed.collect()}


def test_conservation(golden):
    made, ops = golden
    assert len(ops) + made.stay.count() + made.in_place.count() == len(ASSETS)
    assert {r.what: r.n for r in made.counts().collect()}["operations"] == len(ops)


def test_permutation(spark, golden):
    mixed = ASSETS[:]
    random.Random(5).shuffle(mixed)
    assert {r["from"]: r.to for r in planned(spark, mixed).operations.collect()} == {k: v.to for k, v in golden[1].items()}


def test_idempotence(spark, verdicts):
    """Planning the planned layout moves nothing; held folders were answered before."""
    answers = spark.createDataFrame([("misc", "sort")], "dir string, decision string")
    first = planned(spark, decisions=answers, verdicts=verdicts)
    moved = {r["from"]: r.to for r in first.operations.collect()}
    again = [(moved.get(p, p), k, c) for p, k, c in ASSETS]
    second = planned(spark, again, answers)
    assert second.operations.count() == 0 and second.emptied.count() == 0


def test_emptied(golden):
    assert [r.dir for r in golden[0].emptied.collect()] == ["deep/er", "2013/осень 2013", "2013/зима", "2012/other", "x", "two", "phone", "one", "misc", "deep"]


def test_keeper_reasons(spark, verdicts):
    rows = assets_df(spark).filter("sha256 = 'g'")
    for order in ("path", "path DESC"):
        found = dedupe.duplicate_groups(rows.orderBy(order.split()[0], ascending="DESC" not in order), verdicts).first()
        assert (found.keeper, found.n) == ("2012/dup.jpg", 3)
        assert found.reason == "у него самая надёжная дата; далее — его имя не помечено как копия"


def test_collisions_in_sequence(spark):
    """A given name can take a later natural one: x, x, x (2)."""
    moves = spark.createDataFrame([("a", "d/x.jpg"), ("b", "d/x.jpg"), ("c", "d/x (2).jpg"), ("e", "d/y.jpg"), ("f", "D/x.jpg")], "`from` string, `to` string")
    assert {r["from"]: r.final for r in plan.collisions(moves).collect()} == model_of_collisions([("a", "d/x.jpg"), ("b", "d/x.jpg"), ("c", "d/x (2).jpg"), ("e", "d/y.jpg"), ("f", "D/x.jpg")])


def model_of_collisions(rows):
    taken, out = set(), {}
    for source, target in sorted(rows, key=lambda r: (r[1], r[0])):
        head, _, base = target.rpartition("/")
        m = re.match(r"(.+)(\.[^.]*)$", base)
        stem, ext = m.groups() if m else (base, "")
        name, n = target, 2
        while name in taken:
            name, n = f"{head}/{stem} ({n}){ext}", n + 1
        taken.add(name)
        out[source] = name
    return out


def test_collisions_against_a_model(spark):
    rng = random.Random(3)
    rows = [(f"s{i:03}", f"d/{rng.choice('ab')}{rng.choice(['', ' (2)', ' (3)', ' (2) (2)'])}.jpg") for i in range(60)]
    assert {r["from"]: r.final for r in plan.collisions(spark.createDataFrame(rows, "`from` string, `to` string")).collect()} == model_of_collisions(rows)


@pytest.mark.parametrize("ends", [[".jpg"], [""], ["", ".jpg", ".", ".x (2).jpg"]])
def test_free_names_of_nested_numbers(spark, ends):
    """Numbers asked for and given, with gaps, nested ones, leading zeros and no extension."""
    rng = random.Random(8)
    tails = ["", "", "", " (2)", " (3)", " (5)", " (02)", " (1)", " (11)", " (2) (2)", " (2) (3)", " (3) (2)", " (2) (2) (2)", " (999999999999999999999)"]
    rows = [(f"s{i:04}", f"{rng.choice(['d/', 'd/e (2)/', ''])}{rng.choice(['a', 'a', '.b', ' '])}{rng.choice(tails)}{rng.choice(ends)}") for i in range(700)]
    found = plan.collisions(spark.createDataFrame(rows, "`from` string, `to` string").repartition(5))
    given = {r["from"]: r.final for r in found.collect()}
    taken, want = set(), {}
    for source, target in sorted(rows, key=lambda r: (r[1], r[0])):
        head, slash, base = target.rpartition("/")
        m = re.match(r"(?s)(.+)(\.[^.]*)$", base)
        stem, ext = m.groups() if m else (base, "")
        name, n = target, 2
        while name in taken:
            name, n = f"{head}{slash}{stem} ({n}){ext}", n + 1
        taken.add(name)
        want[source] = name
    assert given == want and len(set(given.values())) == len(rows)


def test_one_name_claimed_by_most(spark):
    rows = [(f"s{i:05}", "d/x.jpg" if i % 3 else f"d/x ({i}).jpg") for i in range(3000)]
    found = {r["from"]: r.final for r in plan.collisions(spark.createDataFrame(rows, "`from` string, `to` string").repartition(5)).collect()}
    free = (n for n in range(2, 9000) if n % 3 or n >= 3000)
    want = {s: t for s, t in rows if t != "d/x.jpg"} | {s: "d/x.jpg" if i == 0 else f"d/x ({next(free)}).jpg" for i, s in enumerate(sorted(s for s, t in rows if t == "d/x.jpg"))}
    assert found == want


def test_a_photo_is_no_neighbour_of_its_own(spark):
    """The only photo of a model finds no family by it; with one more it does, and its own year doesn't count."""
    from tidemark.operators import pairing

    facts = [("d/a.jpg", "X1", 100, 60), ("d/b.jpg", "X2", 100, 60), ("d/c.jpg", "X2", 10, 20), ("d/e.jpg", None, 1, 60), *[(f"d/n{i}.jpg", "X3", 50, 60) for i in range(3)]]
    years = {"d/a.jpg": 2001, "d/b.jpg": 2002, "d/c.jpg": 2003, **{f"d/n{i}.jpg": 2010 + i for i in range(3)}}
    census = corpus.camera_census(spark.createDataFrame([(p, y, "dirname", "medium") for p, y in years.items()], "path string, year int, winner string, confidence string"), spark.createDataFrame(facts, "path string, model string, width int, height int"))
    queries = spark.createDataFrame([(p, "d", m, w, h, years.get(p) if m else None) for p, m, w, h in facts], "path string, dir string, model string, width int, height int, own_year int")
    found = {r.path: (r.model, r.matched_by, r.first_year, r.last_year, r.neighbours) for r in pairing.family_match(queries, census).collect()}
    assert found == {
        "d/a.jpg": ("X3", "geometry", 2010, 2012, 3), "d/b.jpg": ("X2", "exif", 2003, 2003, 1), "d/c.jpg": ("X2", "exif", 2002, 2002, 1), "d/e.jpg": ("X3", "geometry", 2010, 2012, 3),
        "d/n0.jpg": ("X3", "exif", 2011, 2012, 2), "d/n1.jpg": ("X3", "exif", 2010, 2012, 2), "d/n2.jpg": ("X3", "exif", 2010, 2011, 2),
    }


def wall(y, m=6, d=1, h=12):
    return (y, m, d, h, 0, 0)


def claims_df(spark, rows):
    made = [(p, 0, i, k, evidence.V.RANK[k], evidence.V.CONFIDENCE[k], w, None, date_only, None, None, False) for i, (p, k, w, date_only) in enumerate(rows)]
    return spark.createDataFrame(made, schemas.struct(schemas.EVIDENCE))


def test_resolution(spark):
    rows = [
        ("a", "exif-original", wall(1979), False), ("b", "exif-original", (2000, 1, 1, 0, 25, 13), False), ("c", "exif-original", (2016, 1, 1, 0, 40, 12), False), ("d", "exif-original", wall(2013), False),
        ("d", "dirname", (2013, 1, 1, 0, 0, 0), True), ("d", "filename-year", (2011, 1, 1, 0, 0, 0), True), ("e", "editor-save", wall(2014), False), *[(f"n{i}", "exif-original", wall(2010), False) for i in range(5)],
    ]
    claims = claims_df(spark, rows)
    floor = corpus.floor_year(claims, NOW)
    assert floor.first().floor_year == 2010
    found = {r.path: r for r in verdict.resolve(claims, NOW, floor).collect()}
    assert [(found[p].status, [d.reason for d in found[p].disputed]) for p in "abe"] == [("unknown", ["implausible-year"]), ("unknown", ["reset-camera-clock"]), ("unknown", ["editor-save-date"])]
    assert (found["c"].status, found["c"].date) == ("dated", "2016-01-01 00:40:12")
    assert found["d"].corroborated == ["dirname"] and [d.reason for d in found["d"].disputed] == ["conflicts-with-winner"]


def test_sidecars(spark):
    rows = [("d/a.jpg", "photo"), ("d/a.jpg.xmp", "other"), ("d/b.avi", "video"), ("d/B.thm", "junk"), ("d/c.avi", "video"), ("d/c.jpg", "photo"), ("d/c.thm", "junk"), ("e/a.thm", "junk")]
    found = pairing.pair_sidecars(spark.createDataFrame(rows, "path string, kind string")).collect()
    assert {r.sidecar: r.path for r in found} == {"d/a.jpg.xmp": "d/a.jpg", "d/B.thm": "d/b.avi"}


def jpeg(date=None, software=None, size=(4, 3)):
    """A head with an EXIF directory and a frame header."""
    strings = [(0x0131, software), (0x0132, date if software else None), (0x9003, None if software else date)]
    entries, data, at = b"", b"", 8 + 2 + 12 * 3 + 4
    for tag, text in strings:
        raw = (text or "").encode() + b"\0"
        entries += struct.pack("<HHII", tag if text else 0xFFFF, 2, max(len(raw), 5), at + len(data))
        data += raw + b"\0" * 5
    body = b"Exif\0\0II*\0" + struct.pack("<IH", 8, 3) + entries + b"\0" * 4 + data
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", size[1], size[0]) + b"\0" * 12


def mp4(seconds):
    header = b"\0\0\0\0" + struct.pack(">II", seconds + 2_082_844_800, 0) + b"\0" * 12
    box = lambda kind, body: struct.pack(">I", len(body) + 8) + kind + body
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"free", b"") + box(b"moov", box(b"mvhd", header))


@pytest.fixture
def tree(tmp_path):
    for path, content in {
        "cam/p1.jpg": jpeg("2013:07:04 10:00:00"), "cam/p2.jpg": jpeg("2014:02:09 11:09:09", "Adobe Photoshop CS3"), "vid/clip.mp4": mp4(1_527_953_400), "cam/IMG_20140121_183801.jpg": jpeg(), "copy/IMG_20140121_183801 (1).jpg": jpeg(), "docs/a.txt": b"text", "empty/.keep/x.tmp": b"x",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    return tmp_path


def contents(root):
    import hashlib

    return sorted((str(p.relative_to(root)), hashlib.sha256(p.read_bytes()).hexdigest()) for p in root.rglob("*") if p.is_file() and executor.RUNS_DIR not in p.parts)


def test_scan_apply_and_roll_back(spark, tree):
    found = engine.scan(spark, str(tree))
    raw = metadata.read_raw(found.assets, str(tree))
    annotated = engine.annotate(found.assets, NOW, raw)
    verdicts = {r.path: r for r in annotated.collect()}
    assert (verdicts["cam/p1.jpg"].winner, verdicts["cam/p1.jpg"].date) == ("exif-original", "2013-07-04 10:00:00")
    assert verdicts["cam/p2.jpg"].status == "unknown" and verdicts["cam/p2.jpg"].disputed[0].reason == "editor-save-date"
    assert verdicts["vid/clip.mp4"].winner == "container-created" and verdicts["vid/clip.mp4"].year == 2018
    made = engine.make_plan(found, annotated)
    made.operations, made.emptied = made.operations.cache(), made.emptied.cache()
    made.operations.count(), made.emptied.count()
    before = contents(tree)
    dry = engine.apply(str(tree), made, dry_run=True)
    assert contents(tree) == before
    done = engine.apply(str(tree), made)
    assert done["failed"] == 0 and done["moved"] == made.operations.count()
    records = lambda run: [(r["kind"], r.get("from"), r.get("to"), r.get("dir")) for r in executor.read_records(tree / executor.RUNS_DIR / run / "journal.jsonl")]
    assert records(dry["run_id"]) == records(done["run_id"])
    assert sorted(h for _, h in contents(tree)) == sorted(h for _, h in before) and contents(tree) != before
    second = engine.scan(spark, str(tree))
    again = engine.make_plan(second, engine.annotate(second.assets, NOW, metadata.read_raw(second.assets, str(tree))))
    assert again.operations.count() == 0
    engine.roll_back(str(tree), done["run_id"])
    assert contents(tree) == before and (tree / "empty/.keep").is_dir()


def test_late_tags_and_xmp_sidecars(spark, tree):
    """A TIFF whose directory lies behind its picture, and an XMP sidecar with a capture date."""
    import struct

    entry = struct.pack("<HHII", 0x9003, 2, 20, 400_030)
    (tree / "cam/late.tif").write_bytes(b"II*\0" + struct.pack("<I", 400_000) + b"\1" * 399_992 + struct.pack("<H", 1) + entry + b"\0" * 16 + b"2014:05:06 07:08:09\0")
    (tree / "cam/odd.jpg").write_bytes(b"\xff\xd8\xff\xd9odd")
    (tree / "cam/odd.jpg.xmp").write_text('<x:xmpmeta><rdf:RDF><a xmp:ModifyDate="2020-01-01T00:00:00"/>' + " " * 70_000 + '<a photoshop:DateCreated="2016-03-04"/></rdf:RDF></x:xmpmeta>')
    found = engine.scan(spark, str(tree))
    raw = {r.path: r for r in metadata.read_raw(found.assets, str(tree)).collect()}
    assert raw["cam/late.tif"].original == "2014:05:06 07:08:09" and raw["cam/odd.jpg.xmp"].xmp_original == "2016-03-04"
    verdicts = {r.path: r for r in engine.annotate(found.assets, NOW, metadata.read_raw(found.assets, str(tree))).collect()}
    assert (verdicts["cam/odd.jpg"].winner, verdicts["cam/odd.jpg"].date[:10], verdicts["cam/odd.jpg"].date_only) == ("sidecar", "2016-03-04", True)


def test_one_scan_reads_each_file_once(spark, tree):
    """What the scan found is a table: later changes of the files don't reach it."""
    found = engine.scan(spark, str(tree))
    before = sorted(map(tuple, found.assets.collect()))
    for path in tree.rglob("*.jpg"):
        path.write_bytes(b"other")
    assert sorted(map(tuple, found.assets.collect())) == before and found.errors.count() == 0


def test_refused_and_torn_resumes(spark, tree):
    found = engine.scan(spark, str(tree))
    made = engine.make_plan(found, engine.annotate(found.assets, NOW))
    ops, before = made.operations.cache(), contents(tree)
    assert ops.count() > 2
    part = executor.apply_plan(str(tree), ops.limit(2), made.emptied.limit(0))
    folder = tree / executor.RUNS_DIR / part["run_id"]
    log = folder / "journal.jsonl"
    log.write_text("\n".join(log.read_text().split("\n")[:-2]) + '\n{"torn')
    executor.apply_plan(str(tree), ops, made.emptied, run_id=part["run_id"])  # the torn line stays no part of the next one
    moved = {r["to"] for r in executor.read_records(log) if r["kind"] == "moved"}
    assert len(moved) == ops.count()
    manifest = (folder / "manifest.jsonl").read_text()
    (folder / "manifest.jsonl").write_text("")
    with pytest.raises(ValueError, match="backup"):
        executor.apply_plan(str(tree), ops, made.emptied, run_id=part["run_id"])
    with pytest.raises(ValueError, match="journal"):
        executor.apply_plan(str(tree), ops, made.emptied, run_id="run-20200101-000000-abcdef")
    (folder / "manifest.jsonl").write_text(manifest)
    import shutil

    for name in {r["from"].split("/")[0] for r in executor.read_records(log) if r["kind"] == "moved" and "/" in r["from"]}:
        if (tree / name).is_dir() and not any(p.is_file() for p in (tree / name).rglob("*")):
            shutil.rmtree(tree / name)  # a missing parent doesn't stop the undo
    assert executor.roll_back(str(tree), part["run_id"])["failed"] == 0
    assert contents(tree) == before


def test_cached_scan_is_a_fresh_scan(spark, tree, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("cache") / "scan")
    assets = engine.scan(spark, str(tree)).assets
    cache.save(assets, store)
    (tree / "docs/a.txt").write_bytes(b"longer text")
    both = [sorted(map(tuple, engine.scan(spark, str(tree), c).assets.collect())) for c in (None, cache.load(spark, store))]
    assert both[0] == both[1]
    assert cache.load(spark, store + "-missing").count() == 0


def test_resume(spark, tree):
    found = engine.scan(spark, str(tree))
    made = engine.make_plan(found, engine.annotate(found.assets, NOW))
    ops = made.operations.cache()
    assert ops.count() > 2
    before = contents(tree)
    part = executor.apply_plan(str(tree), ops.limit(2), made.emptied.limit(0))
    log = tree / executor.RUNS_DIR / part["run_id"] / "journal.jsonl"
    log.write_text("\n".join(log.read_text().split("\n")[:-2]) + '\n{"torn')
    assert len(executor.read_records(log)) > 1
    log.write_text(log.read_text()[: -len('{"torn')])
    rest = executor.apply_plan(str(tree), ops, made.emptied, run_id=part["run_id"])
    assert rest["failed"] == 0 and rest["moved"] == ops.count() - 2
    executor.roll_back(str(tree), part["run_id"])
    assert contents(tree) == before


def test_listing_errors_and_texts(spark, tree, tmp_path_factory):
    other = tmp_path_factory.mktemp("texts")
    (other / "answers.txt").write_text("# c\nmisc = сортировать\r\ntmp =\nfoo = maybe\n = да\nbar=KEEP # x\nnothing\n")
    found = texts.read_decisions(spark, str(other / "answers.txt")).collect()
    assert [(r.line, r.dir, r.decision, r.readable) for r in found] == [(2, "misc", "sort", True), (3, "tmp", None, True), (4, None, None, False), (5, None, None, False), (6, "bar", "as-is", True), (7, None, None, False)]
    (other / "receipt.txt").write_text("title\n\n01.02.2024, 10:00 — moved: 12\n    undo run-20240201-100000-ab12cd\n")
    assert [(r.run_id, r.moved) for r in texts.read_receipt(spark, str(other / "receipt.txt")).collect()] == [("run-20240201-100000-ab12cd", 12)]
    (other / "j.jsonl").write_text('{"run_id":"r","seq":1,"kind":"moved"}\nbad\n{"run_id":"r","seq":2,"kind":"done"}\n{"torn')
    assert [r.state for r in texts.read_journals(spark, str(other / "j.jsonl")).orderBy("line").collect()] == ["ok", "broken", "ok", "truncated"]
    assets = inventory.typed(inventory.binary_inventory(spark, str(tree)))
    assert assets.filter("kind = 'photo'").count() == 4
