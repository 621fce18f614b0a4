"""Substring dedup: Rabin-Karp hashes of every 13-word window, counted in Spark, merged into removal intervals.

Documents are cut into groups by ranges of their id, so that the order of two
groups is the order of their documents. Then

1. each group sends every distinct window hash once to the hash's bucket, as
   packed arrays (8 bytes a window; windows are told apart by 64 bits, and the
   bucket number comes from a second hash);
2. each bucket finds the hashes that an earlier group holds as well and
   returns them to the later groups;
3. each group meets its own answers: a window goes if an earlier group or an
   earlier document of its own group has it. Overlapping windows merge into
   maximal intervals of words.

A passage that a third of all documents share is sent once a group, not once
a document, so no bucket grows with the number of copies. Both steps use the same
shuffle of the texts.

Null and empty texts have no words. A null id counts as the smallest one. Rows
with one id don't remove each other's words. Texts of fewer than 13 words
stay whole. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import jobs
from tidemark.llm import textkernel as K

WINDOW = 13
#: Parquet bytes of a group, and windows of a bucket, that are aimed at.
GROUP_BYTES, BUCKET_WINDOWS = 2 << 20, 2 << 20
MIN_GROUPS, MAX_GROUPS, MIN_BUCKETS = 64, 1 << 20, 1024
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_LOWEST = -(1 << 63)


def _windows(words: np.ndarray, bounds: np.ndarray, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and bucket of each window that lies within one row."""
    keys = next(K.rolling(words, (window,)))[1]
    other = next(K.rolling(K.mix(words ^ _SECOND), (window,)))[1]
    last = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(len(keys)) + window <= last[: len(keys)])
    return at, keys[at], (other[at] >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def _sent(window: int, buckets: int):
    """(bucket, grp, hashes): a group's distinct windows by bucket, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "text"):
            data, offsets = K.text_bytes(piece.column(2))
            starts, ends, bounds = K.word_spans(data, offsets, K.NOT_WHITE)
            at, keys, bucket = _windows(K.span_hashes(data, starts, ends), bounds, window, buckets)
            group = piece.column(0).to_numpy(zero_copy_only=False)[np.searchsorted(bounds, at, "right") - 1]
            for g in np.unique(group):
                mine = group == g
                k, b = keys[mine], bucket[mine]
                order = np.argsort((b.astype(np.uint64) << np.uint64(44)) | (k >> np.uint64(20)))
                k, b = k[order], b[order]
                new = np.r_[True, (k[1:] != k[:-1]) | (b[1:] != b[:-1])]
                k, b = k[new], b[new]
                head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                cuts = (np.r_[head, len(k)] * 8).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(k))])
                yield pa.RecordBatch.from_arrays([pa.array(b[head]), pa.array(np.full(len(head), g, np.int32)), blobs], ["bucket", "grp", "hashes"])

    return run


def _flat(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all blobs and the number in each."""
    sizes = np.array([len(x.as_buffer()) // 8 for x in blobs], np.int64)
    return np.frombuffer(b"".join(x.as_buffer() for x in blobs), np.uint64), sizes


def _answers(bucket: pa.Table) -> pa.Table:
    """(grp, hashes): what an earlier group has as well, for each group of a bucket."""
    keys, sizes = _flat(bucket["hashes"])
    group = np.repeat(bucket["grp"].to_numpy(), sizes)
    order = np.lexsort((group, keys))
    keys, group = keys[order], group[order]
    same = np.r_[False, keys[1:] == keys[:-1]]
    head = np.flatnonzero(~same)
    lowest = np.repeat(group[head], np.diff(np.r_[head, len(keys)]))
    late = group > lowest
    keys, group = keys[late], group[late]
    order = np.argsort(group, kind="stable")
    keys, group = keys[order], group[order]
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    blobs = [keys[a:b].tobytes() for a, b in zip(head, np.r_[head[1:], len(keys)], strict=False)]
    return pa.table({"grp": pa.array(group[head], pa.int32()), "hashes": pa.array(blobs, pa.binary())})


def _member(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def _removed(ids: np.ndarray, words: np.ndarray, bounds: np.ndarray, known: np.ndarray, window: int) -> np.ndarray:
    """Which words of a group go."""
    at, keys, _ = _windows(words, bounds, window, 2)
    gone = _member(keys, np.sort(known))
    doc = ids[np.searchsorted(bounds, at, "right") - 1]
    order = np.lexsort((doc, keys))
    k, d = keys[order], doc[order]
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    gone[order[d > np.repeat(d[head], np.diff(np.r_[head, len(k)]))]] = True
    return K.covered(len(words), at[gone], window)


_OUT = "id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:bigint,words:bigint>>, kept string"


def _cut(window: int, with_text: bool):
    interval = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if docs.num_rows:
            data, offsets = K.text_bytes(docs["text"])
            starts, ends, bounds = K.word_spans(data, offsets, K.NOT_WHITE)
            gone = _removed(docs["id"].fill_null(_LOWEST).to_numpy(), K.span_hashes(data, starts, ends), bounds, _flat(answers["hashes"])[0], window)
            text, ids = data.tobytes(), docs["id"].to_pylist()
            del data
            for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                low, high = bounds[row], bounds[row + 1]
                mine, found = gone[low:high], []
                kept = text[a:b].split()
                if mine.any():
                    kept = list(compress(kept, ~mine))
                    edge = np.diff(np.r_[0, mine, 0].astype(np.int8))
                    on, off = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    found = [{"start": int(s), "words": int(e - s)} for s, e in zip(on, off, strict=True)]
                joined = b" ".join(kept)
                out.append((ids[row], int(high - low), int(mine.sum()), hashlib.sha256(joined).hexdigest(), found, joined.decode("utf-8", "replace") if with_text else None))
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), interval, pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "n_words", "n_removed", "kept_sha256", "removed", "kept"])

    return run


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256, removed (maximal word intervals) and, if asked for, the kept text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = jobs.table_bytes(rows)
    groups = min(max(MIN_GROUPS, math.ceil(size / GROUP_BYTES)), MAX_GROUPS)
    buckets = 1 << max(MIN_BUCKETS.bit_length() - 1, math.ceil(math.log2(max(1, 0.3 * size / BUCKET_WINDOWS))))
    shares = [i / groups for i in range(1, groups)]
    cuts = rows.agg(F.percentile_approx("id", shares, max(10_000, 10 * groups)).alias("cuts")).first()["cuts"] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.arrow_udf("int")
    def group_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, ids.fill_null(_LOWEST).to_numpy(zero_copy_only=False), "right").astype(np.int32))

    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / (64 << 20)))
    grouped = rows.select(group_of("id").alias("grp"), "id", "text").repartition(width, "grp")
    sent = grouped.sortWithinPartitions("grp").mapInArrow(_sent(window, buckets), "bucket long, grp int, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(_answers, "grp int, hashes binary")
    out = grouped.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_cut(window, with_text), _OUT)
    return (out if with_text else out.drop("kept")).withColumnRenamed("id", id_col)
