"""Cost-balanced packing of token streams into fixed-length sequences.

The cost of a sequence is the linear plus quadratic attention work of its pieces.
Documents are tokenised and packed where they are read, in groups of bounded size:
a document of more than one sequence gives whole sequences and a rest; the rests go
in descending length to the cheapest sequence with room, and one that fits nowhere
is cut at the roomiest. A group makes as many sequences as its tokens need, so it is
padded by less than one sequence. No shuffle.

A null text is an empty document, which still has its end id. Rows are packed
one by one, so repeated rows or ids and null ids each have their own pieces;
equal lengths keep their order of reading, equal costs take the first sequence.
Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkernel as K
from tidemark.llm import tokens

LENGTH, END_ID = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens that are packed together.
GROUP_TOKENS = 2_000_000
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(rests: np.ndarray, sequences: int, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(document, start in its rest, tokens, sequence) so that costs are level and room is used up."""
    cost, room, out = np.zeros(sequences), np.full(sequences, length), []
    for doc in np.argsort(-rests, kind="stable"):
        at, left = 0, int(rests[doc])
        while left:
            fits = room >= left
            best = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            n = min(left, int(room[best]))
            out.append((int(doc), at, n, best))
            cost[best] += linear * n + quadratic * n * n
            room[best] -= n
            at, left = at + n, left - n
    return out


def pack(sizes: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, tokens, sequence, offset) for a group of documents of those sizes."""
    whole = sizes // length
    pieces = [(doc, i * length, length) for doc in np.flatnonzero(whole) for i in range(whole[doc])]
    out = [(int(doc), int(start), n, k, 0) for k, (doc, start, n) in enumerate(pieces)]
    rests = sizes - whole * length
    used: dict[int, int] = {}
    for doc, at, n, k in assign(rests, -(-int(rests.sum()) // length), length):
        out.append((doc, int(whole[doc]) * length + at, n, len(pieces) + k, used.get(k, 0)))
        used[k] = used.get(k, 0) + n
    return out


def pack_sequences(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, PIECES and, if asked for, the piece's `ids`; sequence_id is unique over all tasks."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema[0].dataType), *T.StructType.fromDDL(PIECES + ", ids array<int>" * with_ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        ids: list[pa.Array] = []
        coded: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal made
            sizes = np.array([len(x) for x in coded], np.int64)
            found = pack(sizes, length)
            doc, start, n, seq, offset = (np.array(x, np.int64) for x in (zip(*found, strict=True)))
            crc = [zlib.crc32(coded[d][s : s + k].astype("<u4").tobytes()) for d, s, k, _, _ in found]
            columns = [pa.concat_arrays(ids).take(pa.array(doc)), *map(pa.array, (start, n, np.array(crc, np.int64), sizes[doc], task + made + seq, offset))]
            if with_ids:
                columns.append(pa.array([coded[d][s : s + k].astype(np.int32) for d, s, k, _, _ in found], pa.list_(pa.int32())))
            made += int(seq.max()) + 1
            return pa.RecordBatch.from_arrays(columns, [id_col, *(f.name for f in schema.fields[1:])])

        for piece in K.pieces(batches, "text", 1 << 20):
            encoder = tokens.encoder(vocabulary)
            end = np.array([end_id], encoder.dtype).tobytes()
            ids.append(piece.column(0))
            coded += [np.frombuffer(x + end, encoder.dtype) for x in encoder.ids(piece.column(1).to_pylist())]
            held += sum(len(x) for x in coded[len(coded) - piece.num_rows :])
            if held >= group_tokens:
                yield packed()
                ids, coded, held = [], [], 0
        if coded:
            yield packed()

    return rows.mapInArrow(run, schema)
