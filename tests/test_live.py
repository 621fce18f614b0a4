"""Numbered lines cut anywhere, and runs as a stream that is stopped and goes on."""

import json
import os
import time

import pytest

from tidemark.sources import lines, texts
from tidemark.streaming import journal, live


def record(run, seq, kind, **more):
    return json.dumps({"run_id": run, "seq": seq, "kind": kind, "ts": f"2024-02-01T10:00:{seq % 60:02}Z", "dry_run": False} | more)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_lines_of_many_ranges(spark, tmp_path, split):
    said = {"a.txt": "one\r\ntwo\n\nfour é\nfive", "b.txt": "\n\n", "c.txt": "", "d.txt": "x" * 200 + "\ny\n"}
    for name, text in said.items():
        (tmp_path / name).write_bytes(text.encode())
    found = {}
    for r in lines.read_lines(spark, f"{tmp_path}/*.txt", split).collect():
        found.setdefault(os.path.basename(r.file), []).append((r.line, r.text))
    want = {n: [x.removesuffix("\r") for x in t.split("\n")] for n, t in said.items()}
    want = {n: x[:-1] if x[-1] == "" else x for n, x in want.items()}
    assert {n: sorted(x) for n, x in found.items()} == {n: list(enumerate(x, 1)) for n, x in want.items() if x}
    assert lines.read_lines(spark, f"{tmp_path}/none/*", split).count() == 0


def test_journal_of_many_ranges(spark, tmp_path):
    """The records, numbers and states of a journal with a broken and a torn line, however it is cut."""
    rows = [record("r1", i, "planned-move" if i % 2 else "moved", **{"from": f"a{i}", "to": f"b{i}"}) for i in range(300)]
    (tmp_path / "j.jsonl").write_text("\n".join([*rows[:100], "{broken", "", *rows[100:], '{"run_id": "r1", "se']))
    want = sorted(texts.read_journals(spark, f"{tmp_path}/j.jsonl").drop("file").collect(), key=lambda r: r.line)
    found = sorted(texts.read_journals(spark, f"{tmp_path}/j.jsonl", split=500).drop("file").collect(), key=lambda r: r.line)
    assert found == want and [r.line for r in found if r.state != "ok"] == [101, 303] and [r.state for r in found if r.state != "ok"] == ["broken", "truncated"]
    plain = spark.read.text(f"{tmp_path}/j.jsonl", wholetext=True).first()[0].split("\n")
    assert [r.line for r in found] == [i for i, x in enumerate(plain, 1) if x.strip()]


def test_stream_equals_history_after_a_stop(spark, tmp_path):
    folder = tmp_path / "runs"
    logs = {run: folder / run / "journal.jsonl" for run in ("r1", "r2", "r3")}
    for log in logs.values():
        log.parent.mkdir(parents=True)
    told = []

    def go_on():
        stream = live.progress(live.records(spark, f"{folder}/*/journal.jsonl", split=150), patience=1)
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).foreachBatch(lambda df, n: told.extend(df.collect())).start()
        query.awaitTermination(300)
        assert query.exception() is None

    logs["r1"].write_text("\n".join([record("r1", 1, "planned-move"), record("r1", 2, "moved"), record("r1", 3, "planned-move")]) + "\n" + record("r1", 4, "moved")[:20])
    logs["r2"].write_text(record("r2", 1, "planned-move", dry_run=True) + "\n")
    go_on()
    first = {r.run_id: r for r in told}
    assert (first["r1"].moved, first["r1"].last_seq, first["r1"].finished) == (1, 3, False)  # the torn line waits
    told.clear()
    time.sleep(0.1)
    with open(logs["r1"], "a") as log:
        log.write(record("r1", 4, "moved")[20:] + "\n" + record("r1", 5, "error") + "\n" + record("r1", 6, "done") + "\n")
    logs["r3"].write_text("not json\n" + record("r3", 9, "planned-move") + "\n")
    go_on()
    assert {r.run_id for r in told if not r.stalled} == {"r1", "r3"}
    assert {r.run_id for r in told if r.stalled} <= {"r2", "r3"}  # r1 has ended
    last = first | {r.run_id: r for r in told}
    history = journal.run_history(texts.read_journals(spark, f"{folder}/*/journal.jsonl").filter("state = 'ok'")).collect()
    for r in history:
        mine = last[r.run_id]
        assert (mine.started_at, mine.finished, mine.dry_run, mine.planned, mine.moved, mine.last_seq) == (r.started_at, r.finished, r.dry_run, r.planned, r.moved, r.last_seq)
    assert len(history) == 3 and last["r1"].failed == 1
    told.clear()
    time.sleep(0.1)
    logs["r2"].write_text(logs["r2"].read_text() + record("r2", 2, "done", dry_run=True) + "\n")
    go_on()
    assert ("r3", True) in {(r.run_id, r.stalled) for r in told} and ("r2", False) in {(r.run_id, r.stalled) for r in told}
