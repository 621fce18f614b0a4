"""Token files: static range asymmetric numeral systems (rANS) over id-ordered token streams.

The documents are range-partitioned by id and sorted, encoded with the tokenizers
library, and cut into sections of bounded size. A section has one static
frequency table, shared by all its blocks; a block is a run of whole documents with
LANES interleaved coder states. Every CHECK steps the states and the place in the
payload are kept as a checkpoint, so a block can be decoded from any of them, and all
segments of a section are decoded at once as numpy vectors. Sections are rows of a
Parquet table, so Spark's committers see to lost and repeated tasks.

A null text is empty and still has its end id. Null ids come first. Rows with one id
are written one after the other in the order of their texts' hashes, and of the texts where
these are equal, so a repeated task writes them alike. Extra columns are not read. An empty table gives
empty files. A wrong checksum raises ValueError.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import jobs, tokens
from tidemark.llm import textkernel as K

END_ID = 0
LANES, CHECK, BITS = 64, 128, 20
BLOCK_TOKENS, SECTION_TOKENS, GROUP_BLOCKS = 1 << 16, 1 << 22, 32
#: Parquet bytes of documents that one task sorts and encodes.
PART_BYTES = 16 << 20
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)
#: A section's row; before: ids of its part's earlier sections.
SECTION = "part int, section int, before bigint, doc_ids array<bigint>, doc_tokens array<int>, block_tokens array<int>, symbols binary, frequencies binary, states binary, places array<int>, payload binary, payload_words array<int>, payload_crc32 array<bigint>, ids_crc32 array<bigint>"


def frequency_table(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positive frequencies that sum to 2**bits, near the shares of the counts (all positive)."""
    total = 1 << bits
    if len(counts) > total // 2:
        raise ValueError("more symbols than the table has room for")
    table = np.maximum(1, (counts * (total / counts.sum())).astype(np.int64))
    order, over = np.argsort(-table, kind="stable"), int(table.sum()) - total
    if over < 0:
        table[order[0]] -= over
    for i in order:
        if over <= 0:
            break
        cut = min(over, int(table[i]) // 2)
        table[i] -= cut
        over -= cut
    return table


def encode(blocks: list[np.ndarray], table: np.ndarray) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """For each block of symbol numbers: payload, states and payload places at its checkpoints."""
    size = np.array([len(x) for x in blocks])
    steps = int(-(-size.max() // LANES))
    symbol = np.zeros((len(blocks), steps * LANES), np.int64)
    for row, x in zip(symbol, blocks, strict=True):
        row[: len(x)] = x
    symbol = np.ascontiguousarray(symbol.reshape(len(blocks), steps, LANES).transpose(1, 0, 2))
    freq, start = table.astype(np.uint64), (np.cumsum(table) - table).astype(np.uint64)
    limit = freq << np.uint64(63 - BITS)
    state = np.full((len(blocks), LANES), _LOW, np.uint64)
    words, sent = np.zeros((steps, len(blocks), LANES), np.uint32), np.zeros((steps, len(blocks), LANES), bool)
    saved = {}
    lane = np.arange(LANES)
    for t in reversed(range(steps)):
        live = t * LANES + lane < size[:, None]
        s = symbol[t]
        f = freq[s]
        full = live & (state >= limit[s])
        words[t], sent[t] = state.astype(np.uint32), full
        moved = np.where(full, state >> _WORD, state)
        whole = moved // f
        state = np.where(live, (whole << np.uint64(BITS)) + (moved - whole * f) + start[s], state)
        if t % CHECK == 0:
            saved[t] = state
    place = np.cumsum(sent.sum(2), 0)
    out = []
    for b, n in enumerate(size):
        at = range(0, max(1, -(-int(n) // LANES)), CHECK)
        out.append((words[:, b][sent[:, b]].tobytes(), np.stack([saved[t][b] for t in at]), np.array([place[t - 1, b] if t else 0 for t in at], np.int32)))
    return out


def decode(payload: np.ndarray, table: np.ndarray, states: np.ndarray, places: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Symbol numbers of all segments at once: (segments, CHECK * LANES); left[i] of row i count."""
    freq, start = table.astype(np.uint64), (np.cumsum(table) - table).astype(np.uint64)
    slots = np.repeat(np.arange(len(table), dtype=np.uint32), table)
    out = np.zeros((len(states), CHECK, LANES), np.uint32)
    state, place, lane, mask = states.copy(), places.astype(np.int64), np.arange(LANES), np.uint64((1 << BITS) - 1)
    padded = np.r_[payload, np.zeros(LANES, np.uint32)].astype(np.uint64)
    for t in range(min(CHECK, -(-int(left.max()) // LANES) if len(left) else 0)):
        live = t * LANES + lane < left[:, None]
        slot = state & mask
        s = slots[slot]
        out[:, t] = s
        new = freq[s] * (state >> np.uint64(BITS)) + slot - start[s]
        need = live & (new < _LOW)
        rank = np.cumsum(need, 1)
        state = np.where(live, np.where(need, new << _WORD | padded[np.minimum(place[:, None] + rank - need, len(padded) - 1)], new), state)
        place = place + rank[:, -1]
    return out.reshape(len(states), -1)


def _section(part: int, number: int, before: int, ids: list, coded: list[np.ndarray]) -> dict:
    """The row of a section of encoded documents."""
    sizes = np.array([len(x) for x in coded], np.int64)
    cut, held = [0], 0
    for i, n in enumerate(sizes):
        if held and held + n > BLOCK_TOKENS:
            cut.append(i)
            held = 0
        held += n
    stream = np.concatenate(coded)
    counts = np.bincount(stream)
    symbols = np.flatnonzero(counts)
    table = frequency_table(counts[symbols])
    number_of = np.zeros(len(counts), np.int64)
    number_of[symbols] = np.arange(len(symbols))
    edges = np.r_[0, np.cumsum(sizes)][[*cut, len(sizes)]]
    blocks = [stream[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    done: list[tuple[bytes, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(blocks):  # blocks coded together are held as arrays of the longest one's size
        to = at + 1 if len(blocks[at]) > BLOCK_TOKENS else at + next((i for i, b in enumerate(blocks[at : at + GROUP_BLOCKS]) if len(b) > BLOCK_TOKENS), min(GROUP_BLOCKS, len(blocks) - at))
        done += encode([number_of[b] for b in blocks[at:to]], table)
        at = to
    return {
        "part": part, "section": number, "before": before, "doc_ids": ids, "doc_tokens": sizes, "block_tokens": np.diff(edges),
        "symbols": symbols.astype("<u4").tobytes(), "frequencies": table.astype("<u4").tobytes(), "states": b"".join(x[1].astype("<u8").tobytes() for x in done), "places": np.concatenate([x[2] for x in done]),
        "payload": b"".join(x[0] for x in done), "payload_words": [len(x[0]) // 4 for x in done], "payload_crc32": [zlib.crc32(x[0]) for x in done], "ids_crc32": [zlib.crc32(b.astype("<u4").tobytes()) for b in blocks],
    }


_ARROW = pa.schema([("part", pa.int32()), ("section", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("block_tokens", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("symbols", "frequencies", "states")), ("places", pa.list_(pa.int32())), ("payload", pa.binary()), ("payload_words", pa.list_(pa.int32())), ("payload_crc32", pa.list_(pa.int64())), ("ids_crc32", pa.list_(pa.int64()))])


def write_token_files(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write the documents' ids, in ascending order of the document ids, as sections under path."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-jobs.table_bytes(rows) // PART_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, ids, coded, held = TaskContext.get().partitionId(), 0, 0, [], [], 0
        for piece in K.pieces(batches, "text", 1 << 20):
            encoder = tokens.encoder(vocabulary)
            end = np.array([end_id], encoder.dtype).tobytes()
            new = [np.frombuffer(x + end, encoder.dtype) for x in encoder.ids(piece.column(1).to_pylist())]
            ids += piece.column(0).to_pylist()
            coded += new
            held += sum(map(len, new))
            if held >= SECTION_TOKENS:
                yield pa.RecordBatch.from_pylist([_section(part, number, before, ids, coded)], _ARROW)
                number, before, ids, coded, held = number + 1, before + held, [], [], 0
        if coded:
            yield pa.RecordBatch.from_pylist([_section(part, number, before, ids, coded)], _ARROW)

    ordered = rows.repartitionByRange(width, "id").sortWithinPartitions("id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, SECTION).write.parquet(path)


def section_ids(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The section's ids, checked, and the edges of its documents."""
    symbols, table = np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["frequencies"], "<u4").astype(np.int64)
    payload, states = np.frombuffer(row["payload"], "<u4"), np.frombuffer(row["states"], "<u8").reshape(-1, LANES)
    blocks, words = np.array(row["block_tokens"], np.int64), np.array(row["payload_words"], np.int64)
    first = np.cumsum(words) - words
    for a, n, crc in zip(first, words, row["payload_crc32"], strict=True):
        if zlib.crc32(payload[a : a + n].tobytes()) != crc:
            raise ValueError("a block's payload is damaged")
    step = CHECK * LANES
    segments = np.maximum(1, -(-blocks // step))
    block = np.repeat(np.arange(len(blocks)), segments)
    inner = np.arange(len(block)) - np.repeat(np.cumsum(segments) - segments, segments)
    left = np.minimum(step, blocks[block] - inner * step)
    found = np.concatenate([decode(payload, table, states[a : a + 256], first[block[a : a + 256]] + np.array(row["places"][a : a + 256]), left[a : a + 256])[np.arange(step) < left[a : a + 256, None]] for a in range(0, len(block), 256)])
    ids = symbols[found]
    edges = np.r_[0, np.cumsum(blocks)]
    for a, b, crc in zip(edges[:-1], edges[1:], row["ids_crc32"], strict=True):
        if zlib.crc32(ids[a:b].astype("<u4").tobytes()) != crc:
            raise ValueError("a block's ids are damaged")
    return ids, np.r_[0, np.cumsum(row["doc_tokens"])]


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    files = spark.read.parquet(path)
    size = F.aggregate("block_tokens", F.lit(0).cast("long"), lambda x, y: x + y)
    parts = files.groupBy("part").agg(F.sum(size).alias("n"))  # one row for each task that wrote
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    placed = files.join(F.broadcast(starts), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, edges = section_ids(row)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["part_start"] + row["before"] + edges[:-1]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
