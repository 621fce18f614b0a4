"""Line dedup: range-partitioned line hashes give a compressed keep bitmap for each document.

1. Every document sends its distinct long line keys once (128-bit hashes, no text).
2. The hashes are range-partitioned by (hash, document) and sorted by (hash,
   document descending, first position). One key's rows may span several
   partitions, so a line that a third of all documents share loads no single task.
3. A pass over each sorted partition decides every key that lies wholly inside
   it. The first and last key of a partition may go on elsewhere; for these it
   also emits a summary, at most two a partition, and the sums are broadcast.
4. The dropped hashes meet their documents by id; the keep bitmap of each
   document is made there. No text is ever grouped by line.

Null and empty texts are one empty line. A null id counts as the smallest id.
Rows with one id count as one document in the document counts, and each such
row loses the same lines. Extra columns are left alone. An empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import jobs
from tidemark.llm import textkernel as K

MIN_CHARS, MIN_DOCS = 40, 5
#: Hash rows of one sorted partition; a task holds them as 28 bytes each.
ROWS_PER_TASK = 500_000
_KEY = "h1 long, h2 long, id long, first long"


def line_key(line: bytes) -> bytes:
    """White space off both ends, A-Z to lower case (on UTF-8 bytes, so other letters stay)."""
    return line.strip(K.WHITE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode("utf-8", "replace")) >= least)


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, id, first): one row per document and distinct long key, first = its first line number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "text"):
            data, offsets = K.text_bytes(piece.column(1))
            data, hashes, rows, at = data.tobytes(), [], [], []
            for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                seen: dict[bytes, int] = {}
                for i, line in enumerate(data[a:b].split(b"\n")):
                    if len(line) >= min_chars and _long_enough(key := line_key(line), min_chars):
                        seen.setdefault(_hash(key), i)
                hashes += seen
                at += seen.values()
                rows += [row] * len(seen)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), piece.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int64())], ["h1", "h2", "id", "first"])

    return docs.mapInArrow(run, _KEY)


def _judge(min_docs: int):
    """Over a sorted partition: state 0 rows are dropped, 1 rows wait for a sum, 2 rows are the sums' parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        h1, h2 = (table[c].to_numpy() for c in ("h1", "h2"))
        doc, null = table["id"].fill_null(0).to_numpy(), table["id"].is_null().to_numpy()
        key_edge = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        doc_edge = key_edge | np.r_[True, (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])]
        first = np.flatnonzero(key_edge)
        run_of = np.cumsum(key_edge) - 1
        n_docs = np.add.reduceat(doc_edge.astype(np.int64), first)
        largest = (np.cumsum(doc_edge) == np.cumsum(doc_edge)[first][run_of])  # the run's first document comes first
        open_run = np.zeros(len(first), bool)
        open_run[[0, -1]] = True
        dropped = doc_edge & ~largest & (n_docs >= min_docs)[run_of] & ~open_run[run_of]
        waiting = doc_edge & open_run[run_of]
        ends = first[np.flatnonzero(open_run)]
        at = np.r_[np.flatnonzero(dropped), np.flatnonzero(waiting), ends]
        state = np.repeat([0, 1, 2], [dropped.sum(), waiting.sum(), len(ends)]).astype(np.int32)
        n = np.where(state == 2, n_docs[run_of[at]], 0)
        out = table.take(pa.array(at)).select(["h1", "h2", "id"])
        yield from out.append_column("state", pa.array(state)).append_column("n", pa.array(n)).combine_chunks().to_batches()

    return run


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, keys): for each document that loses lines, the 128-bit hashes of the keys that it loses."""
    spark = docs.sparkSession
    keys = jobs.materialize(_keys(docs, min_chars), "line-keys")
    width = jobs.shuffle_width(spark, keys.count(), ROWS_PER_TASK)
    order = [F.col("h1"), F.col("h2"), F.col("id").desc_nulls_last()]
    ranged = keys.repartitionByRange(width, *order).sortWithinPartitions(*order, "first")
    judged = jobs.materialize(ranged.mapInArrow(_judge(min_docs), "h1 long, h2 long, id long, state int, n long"), "line-states")
    sums = judged.filter("state = 2").groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("id").alias("keeper")).filter(F.col("docs") >= min_docs)
    # at most two keys a partition have open ends: the broadcast is bounded by the number of partitions
    late = judged.filter("state = 1").join(F.broadcast(sums), ["h1", "h2"]).filter("NOT (id <=> keeper)")
    lost = judged.filter("state = 0").select("id", "h1", "h2").unionByName(late.select("id", "h1", "h2"))
    return lost.groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("keys"))


def _applied(batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The lines of each row and which of them stay."""
    data, offsets = K.text_bytes(batch.column(batch.schema.get_field_index("text")))
    data, lost = data.tobytes(), batch.column(batch.schema.get_field_index("keys"))
    flat = lost.flatten()
    both = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1).astype("<i8").tobytes() if len(flat) else b""
    sizes = np.r_[0, np.cumsum(lost.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        lines = data[a:b].split(b"\n")
        gone = {both[16 * i : 16 * i + 16] for i in range(sizes[row], sizes[row + 1])}
        yield lines, np.array([not (gone and len(x) >= min_chars and _long_enough(k := line_key(x), min_chars) and _hash(k) in gone) for x in lines])


def bitmap(keep: np.ndarray) -> bytes:
    """A compressed keep bitmap: one bit a line, the first line first."""
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def kept_text(lines: list[bytes], keep_bitmap: bytes) -> bytes:
    """What a keep bitmap leaves of a text."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep_bitmap), np.uint8), count=len(lines))
    return b"\n".join(x for x, k in zip(lines, bits, strict=True) if k)


def _with_lost(docs: DataFrame, lost: DataFrame) -> DataFrame:
    return docs.join(lost.withColumnRenamed("id", "lost_id"), docs["id"].eqNullSafe(F.col("lost_id")), "left").drop("lost_id")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: id, n_lines, n_dropped, keep_bitmap (zlib of the bits, first line first), kept_sha256 of the kept text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "text"):
            made = [(lines, keep, bitmap(keep)) for lines, keep in _applied(piece, min_chars)]
            out = [(len(lines), int((~keep).sum()), bits, hashlib.sha256(kept_text(lines, bits)).hexdigest()) for lines, keep, bits in made]
            n, d, bits, sha = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(bits, pa.binary()), pa.array(sha, pa.string())], ["id", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256"])

    out = _with_lost(rows, dropped_keys(rows, min_chars, min_docs)).mapInArrow(run, "id long, n_lines long, n_dropped long, keep_bitmap binary, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The table with its repeated lines gone from the text column; all rows and columns stay, null texts stay null."""
    lost = dropped_keys(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), min_chars, min_docs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "text"):
            texts = [kept_text(lines, bitmap(keep)).decode("utf-8", "replace") for lines, keep in _applied(piece, min_chars)]
            at = piece.schema.get_field_index("text")
            kept = pa.array(texts, pa.string(), mask=piece.column(at).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([piece.column(0), kept], ["row", "text"])

    done = _with_lost(packed, lost).mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("text", T.StringType())]))
    return done.select(*[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
