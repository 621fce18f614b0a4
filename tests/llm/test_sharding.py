"""Proportional interleaving: equal counts, the mixture in every shard, whatever the sources, ids and buckets are."""

import zlib
from collections import Counter

import pytest

from tidemark.llm import sharding


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", f"text {i}" * (i % 7), 1, "x") for i in range(2000)]
    rows += [(None, None, None, 1, "x")] * 40 + [(5, "", "é" * 40_000, 1, "x")] * 3 + [(5, None, "", 1, "x"), (None, "hot", "same", 1, "x")]
    rows += [(10_000 + i, f"single {i}", "t", 1, "x") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, shard int, `a.b` string").repartition(5)


def test_law_and_mixture(docs):
    rows = sharding.interleave(docs).collect()
    n, want = len(rows), docs.count()
    counts = Counter(r.shard for r in rows)
    assert n == want and sorted(counts) == list(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, count in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(count))
    by_source = Counter(r.source for r in rows)
    held = Counter((r.shard, r.source) for r in rows)
    for source, of in by_source.items():  # 340 sources of few rows shift the cuts by some rows
        assert all(abs(held[shard, source] - of / 24) <= 2 + 20 * of / n for shard in range(24)), source
    singles = Counter(r.shard for r in rows if str(r.source).startswith("single"))
    assert max(singles.values()) <= 30  # sources of one row don't meet at one place
    texts = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts)


def test_few_sources(docs):
    rows = sharding.interleave(docs.filter("doc_id < 2000 AND doc_id > 5")).filter("source = 'hot' OR source LIKE 's%'").collect()
    of, held = Counter(r.source for r in rows), Counter((r.shard, r.source) for r in rows)
    assert all(abs(held[shard, source] - n / 24) <= 2 + len(of) ** 0.5 * n / len(rows) for source, n in of.items() for shard in range(24))


def test_buckets_change_nothing(docs, monkeypatch):
    unique = docs.filter("doc_id >= 6")
    seats = lambda: {r.doc_id: (r.shard, r.slot, r.fraction) for r in sharding.interleave(unique, 7, "other").collect()}
    wide = seats()
    monkeypatch.setattr(sharding, "PER_BUCKET", 3)
    monkeypatch.setattr(sharding, "STRETCHES", 8)
    assert seats() == wide
    ranked = sorted(wide.values(), key=lambda x: x[:2])
    assert [f for *_, f in ranked] == sorted(f for *_, f in ranked)


def test_few_rows_and_none(docs):
    assert sharding.interleave(docs.filter("false")).count() == 0
    rows = sharding.interleave(docs.filter("doc_id between 100 and 102")).collect()
    assert sorted(r.slot for r in rows) == [0, 0, 0] and len({r.shard for r in rows}) == 3


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), shards=5, per_file=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    rows = back.selectExpr("shard AS at", "slot", "row.doc_id", "row.text", "row.source", "row.`a.b` AS ab")
    assert sorted((r.doc_id or -1, r.text or "", r.source or "", r.ab) for r in rows.collect()) == sorted((r.doc_id or -1, r.text or "", r.source or "", r["a.b"]) for r in docs.collect())
    assert back.groupBy("shard").count().count() == 5
