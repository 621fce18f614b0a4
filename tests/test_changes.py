"""Scans again: what changed, what has to be dated anew, the cache in the normal path, backups of everything, conserved contents."""

import json
import os
import random

import pytest

from tidemark import cli, engine, schemas
from tidemark.operators import tree
from tidemark.plans import conservation, executor
from tidemark.sources import cache, changes, inventory, library
from tidemark.sources.metadata import RAW

DAY = 86_400_000.0
RAW_NAMES = [x.split()[0] for x in RAW.split(", ")]


def some_files(rng, n):
    """path -> (mtime, sha, raw facts): directories with and without years, cameras, editors, documents and what derives from them."""
    files = {}
    for i in range(n):
        folder = rng.choice(["a", "a/b", "2013 x", "2013 x/осень", "c", "d", "e"])
        kind = rng.choice(["IMG_20140121_183801", "plain", "plain", "plain", "2001", "shot"])
        raw = {"model": rng.choice([None, "X1", "X2"]), "width": rng.choice([100, 200]), "height": 60}
        if rng.random() < 0.4:
            raw["original"] = f"201{rng.randrange(3)}:05:0{1 + rng.randrange(9)} 10:00:00"
        elif rng.random() < 0.4:
            raw |= {"software": "Adobe Photoshop CS3", "modified": "2016:02:09 11:09:09"}
        if rng.random() < 0.3:
            raw["document_id"] = f"doc{rng.randrange(6)}"
        if rng.random() < 0.3:
            raw["derived_from"] = f"doc{rng.randrange(6)}"
        files[f"{folder}/{kind}_{i}.jpg"] = (DAY * (16_000 + rng.choice([0, 0, 0, rng.randrange(400)])), f"sha{i} {rng.randrange(10**9)}", raw)
    return files


def frames(spark, files):
    assets = spark.createDataFrame([(p, 10, m, "photo", "jpeg", s) for p, (m, s, _) in files.items()], schemas.struct(schemas.ASSET))
    return assets, spark.createDataFrame([(p, *[raw.get(n) for n in RAW_NAMES]) for p, (_, _, raw) in files.items()], f"path string, {RAW}")


def edited(rng, files, n):
    files = dict(files)
    for _ in range(n):
        path = rng.choice(sorted(files))
        m, s, raw = files[path]
        what = rng.randrange(4)
        if what == 0:
            del files[path]
        elif what == 1:
            del files[path]
            files[f"{rng.choice(['a', 'new', 'd'])}/moved_{rng.randrange(10**6)}.jpg"] = (m, s, raw)
        elif what == 2:
            files[path] = (m + 1, s + "'", raw | {"original": "2011:01:01 01:01:01"})
        else:
            files |= some_files(random.Random(rng.random()), 2)
    return files


@pytest.mark.parametrize("seed", [0, 2])
def test_an_update_is_a_full_run(spark, seed):
    rng = random.Random(seed)
    files = some_files(rng, 60)
    state = engine.first_state(*frames(spark, files), 2026)
    for edits in (2, 9):
        known = {x[:2] for x in files.values()}
        files = edited(rng, files, edits)
        assets, raw = frames(spark, files)
        asked = []

        def read(fresh, raw=raw, asked=asked):
            asked.append({r.path for r in fresh.select("path").collect()})
            return raw.join(fresh.select("path"), "path", "left_semi")

        before = {r.path: r for r in state.verdicts.collect()}
        state, dirs = engine.update(state, assets, read)
        want = engine.first_state(assets, raw, 2026)
        got = {r.path: r for r in state.verdicts.collect()}
        assert got == {r.path: r for r in want.verdicts.collect()}
        assert state.world.floor == want.world.floor and sorted(map(str, state.world.claims.collect())) == sorted(map(str, want.world.claims.collect()))
        assert {p for p, x in files.items() if x[:2] not in known} <= asked[0]
        assert not any("moved_" in p and p in asked[0] and files[p][:2] in known and p not in before for p in files)  # what moved isn't read again
        touched = {r.dir for r in dirs.collect()}
        assert all(before.get(p) == r for p, r in got.items() if p.rsplit("/", 1)[0] not in touched)


def test_one_change_touches_one_directory(spark):
    files = {f"d{i}/IMG_2014012{j}_183801.jpg": (DAY * (16_000 + 10 * i + j), f"{i}{j}", {}) for i in range(20) for j in range(5)}
    state = engine.first_state(*frames(spark, files), 2026)
    files["d3/plain.jpg"] = (DAY * 99, "new", {})
    _, dirs = engine.update(state, frames(spark, files)[0], lambda fresh: frames(spark, {"d3/plain.jpg": files["d3/plain.jpg"]})[1].filter(f"{fresh.count()} = 1"))
    assert [r.dir for r in dirs.collect()] == ["d3"]


def test_changes(spark):
    def scan(rows):
        return spark.createDataFrame([(p, 1, 5.0, "photo", "jpeg", s) for p, s in rows], schemas.struct(schemas.ASSET))

    found = changes.changes(scan([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3"), ("e", None)]), scan([("a", "1"), ("b", "x"), ("n1", "3"), ("n2", "3"), ("n3", "3"), ("f", None)]))
    assert sorted((r.path, r.change, r.was) for r in found.collect()) == sorted([("b", "changed", None), ("n1", "moved", "c"), ("n2", "moved", "d"), ("n3", "added", None), ("e", "gone", None), ("f", "added", None)], key=str)


def make_tree(top, n=6):
    for i in range(n):
        folder = top / f"a{i % 3}" / "deep" / "er"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"IMG_2014012{i}_183801.mp3").write_bytes(b"ID3 " + bytes([i]))
    (top / "stays.txt").write_text("stays")
    (top / inventory.RECEIPT).write_text("ours")
    (top / inventory.RUNS_DIR).mkdir(exist_ok=True)
    (top / inventory.RUNS_DIR / "x").write_text("ours")
    os.symlink(top / "stays.txt", top / "link")


@pytest.mark.parametrize("entries", [1, 3, 10_000])
def test_listing_by_frontier(spark, tmp_path, entries):
    make_tree(tmp_path)
    files, dirs, errors = inventory.list_tree(spark, str(tmp_path), entries)
    want = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.is_symlink() and inventory.RUNS_DIR not in p.parts and p.name != inventory.RECEIPT)
    assert [r.path for r in files.collect()] == want and errors.count() == 0
    assert {r.path: r["size"] for r in files.collect()} == {p: (tmp_path / p).stat().st_size for p in want}
    assert [r.dir for r in dirs.collect()] == sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_dir() and p.name != inventory.RUNS_DIR)
    assert [r.path for r in inventory.list_tree(spark, str(tmp_path / "none"), entries)[2].collect()] == ["."]


def test_names_that_are_no_text(spark, tmp_path):
    (tmp_path / "ok").write_text("x")
    try:
        open(os.path.join(os.fsencode(tmp_path), b"bad\xff"), "w").close()
    except OSError:
        pytest.skip("this file system has no such names")
    files, _, errors = inventory.list_tree(spark, str(tmp_path))
    assert [r.path for r in files.collect()] == ["ok"] and errors.count() == 1


def test_command_line_caches_and_backs_up_everything(spark, tmp_path, capsys, monkeypatch):
    """A second scan reads nothing, not after a run either; the backup holds what stays as well, and directories."""
    monkeypatch.setattr(spark.__class__, "stop", lambda self: None)
    make_tree(tmp_path)
    os.remove(tmp_path / inventory.RECEIPT)
    assert cli.main(["plan", str(tmp_path), "--json"]) == 0
    scan = lambda: engine.scan(spark, str(tmp_path), cache.load(spark, cache.path_of(str(tmp_path)))).assets
    hits = lambda: cache.probe(inventory.list_tree(spark, str(tmp_path))[0], cache.load(spark, cache.path_of(str(tmp_path)))).filter("NOT hit").count()
    before = {r.path: r.sha256 for r in scan().collect()}
    assert hits() == 0 and len(before) == 7
    assert cli.main(["apply", str(tmp_path), "--json"]) == 0
    done = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    folder = tmp_path / inventory.RUNS_DIR / done["run_id"]
    rows = executor.read_records(folder / "manifest.jsonl")
    assert {r["path"]: r["sha256"] for r in rows if not r["dir"]} == before and {r["path"] for r in rows if r["dir"]} >= {"a0", "a0/deep", "a0/deep/er"}
    assert all((folder / "snapshot" / p).exists() for p in before) and executor.verify_backup(spark, folder)
    assert done["moved"] and hits() == 0  # moved files are known at their new places
    after = scan()
    assert sorted(r.sha256 for r in after.collect()) == sorted(before.values())
    moves = spark.read.schema("kind string, `from` string, `to` string").json(str(folder / "journal.jsonl")).filter("kind = 'moved'")
    expected = conservation.moved(spark.createDataFrame([(r["path"], r["size"], r["sha256"]) for r in rows if not r["dir"]], "path string, size long, sha256 string"), moves)
    assert conservation.not_conserved(expected, after).count() == 0
    (folder / "snapshot" / "stays.txt").unlink()
    assert not executor.verify_backup(spark, folder)


def test_manifest_alone_where_no_links_are_wanted(spark, tmp_path):
    make_tree(tmp_path)
    found = engine.scan(spark, str(tmp_path))
    plan = engine.make_plan(found, engine.annotate(found.assets, 2026))
    done = engine.apply(str(tmp_path), plan, backup=False, found=found)
    folder = tmp_path / inventory.RUNS_DIR / done["run_id"]
    assert done["moved"] and not (folder / "snapshot").exists() and len(executor.read_records(folder / "manifest.jsonl")) > 7


def test_no_links_no_run(spark, tmp_path, monkeypatch):
    make_tree(tmp_path)
    found = engine.scan(spark, str(tmp_path))
    plan = engine.make_plan(found, engine.annotate(found.assets, 2026))
    before = sorted(p for p in tmp_path.rglob("*.mp3"))
    monkeypatch.setattr(executor, "probe_links", lambda folder: "exFAT has none")
    with pytest.raises(OSError, match="exFAT"):
        engine.apply(str(tmp_path), plan, found=found)
    assert sorted(p for p in tmp_path.rglob("*.mp3")) == before
    assert library.read_runs(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("what", ["changed", "lost", "new"])
def test_one_file_is_located(spark, what):
    rows = [(f"d{i % 4}/e{i % 3}/f{i}", 10, f"s{i % 20}") for i in range(60)]
    after = {"changed": [*rows[:7], (rows[7][0], 10, "other"), *rows[8:]], "lost": rows[:-1], "new": [*rows, ("d1/twice", 10, "s1")]}[what]
    old, new = (spark.createDataFrame(x, "path string, size long, sha256 string") for x in (rows, after))
    path = {"changed": rows[7][0], "lost": rows[-1][0], "new": "d1/twice"}[what]
    assert [(r.path, r.what) for r in conservation.not_conserved(old, new).collect()] == [(path, what)]
    parts = path.split("/")[:-1]
    assert {r.dir for r in conservation.differing_dirs(old, new).collect()} == {"/".join(parts[:i]) for i in range(len(parts) + 1)}
    assert conservation.contents(old, new).count() == {"changed": 2, "lost": 1, "new": 1}[what]
    assert conservation.not_conserved(old, old).count() == 0


def test_roll_up(spark):
    own = spark.createDataFrame([("a/b/c", 1), ("a/b/c", 2), ("a", 4), ("x/y", 8), ("", 16)], "dir string, n long")
    assert {r.dir: r.n for r in tree.roll_up(own, root=True).collect()} == {"a/b/c": 3, "a/b": 3, "a": 7, "x/y": 8, "x": 8, "": 31}
    assert tree.roll_up(own.filter("false"), root=True).count() == 0
