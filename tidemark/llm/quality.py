"""Repetition coverage: quality rules on the characters inside repeated n-grams and lines.

Rolling hashes of several n-gram lengths (numpy, a batch of documents at a
time) find the n-grams that occur again in the same document; the share of a
document's characters that lies inside duplicated n-grams, and inside
duplicated lines, all occurrences included, decides. The shares hold for texts of any length.
They are set above the 99.9th percentile of documents that pass the base rule (on 10,000 documents of
the test tables 0.235 for 5 words; half of all have none), so what goes is repetition that is out of the ordinary.
One narrow map over the whole texts: no shuffle, no state, bounded memory.

Null and empty texts have no words and fail the base rule. Rows are judged one
by one: repeated rows, repeated or null ids and ties change nothing. An empty
table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkernel as K

#: n-gram length -> largest share of word characters inside n-grams of that length that occur twice or more.
NGRAM_SHARES = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest share of the lines with words that repeat an earlier line, and of their characters inside lines that occur twice or more.
LINE_SHARE, LINE_CHAR_SHARE = 0.40, 0.40
MIN_WORDS, REPEAT_PERCENT, BASE_NGRAM = 50, 50, 3
_SYMBOL = K.byte_table(b"#*$%&|<>")

SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, dup_line_char_share double, dup_ngram_shares array<double>, base_failed boolean, kept boolean"


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _lines(text: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, those that repeat an earlier one, their characters, and those inside lines that occur twice or more."""
    lines = [x for x in text.split(b"\n") if x.strip(K.WHITE)]
    if len(set(lines)) == len(lines):
        return len(lines), 0, 0, 0
    size = lambda x: len(x.decode("utf-8", "replace"))
    return len(lines), len(lines) - len(set(lines)), sum(map(size, lines)), sum(n * size(x) for x, n in Counter(lines).items() if n > 1)


def signals(column: pa.Array) -> dict[str, np.ndarray]:
    """All measures of a batch of texts."""
    data, offsets = K.text_bytes(column)
    starts, ends, bounds = K.word_spans(data, offsets, K.NOT_WHITE)
    words, rows = K.span_hashes(data, starts, ends), K.row_of(bounds)
    chars = K.code_points(data, starts, ends)
    n_words, word_chars = np.diff(bounds), K.per_row(chars, bounds)
    salt, last = K.mix(np.arange(1, len(offsets), dtype=np.uint64))[rows], bounds[1:][rows]
    inside = {}
    for n, keys in K.rolling(words, (BASE_NGRAM, *NGRAM_SHARES)):
        at = np.flatnonzero(np.arange(len(keys)) + n <= last[: len(keys)])
        keys = keys[at] ^ salt[at]
        inside[n] = K.covered(len(words), at[_again(keys)], n)
    text = data.tobytes()
    lines = np.array([_lines(text[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64).reshape(-1, 4)
    at = np.flatnonzero(_SYMBOL[data])
    repeat = K.per_row(inside[BASE_NGRAM], bounds)
    share = lambda x, of: x / np.maximum(of, 1)
    shares = share(np.stack([K.per_row(chars * inside[n], bounds) for n in NGRAM_SHARES], 1), word_chars[:, None])
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": np.diff(np.searchsorted(at, offsets)), "n_dup_lines": lines[:, 1], "n_repeat_words": repeat, "dup_line_share": share(lines[:, 1], lines[:, 0]), "dup_line_char_share": share(lines[:, 3], lines[:, 2]), "dup_ngram_shares": shares}
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
    bad = (shares > np.array([*NGRAM_SHARES.values()])).any(1) | (out["dup_line_share"] > LINE_SHARE) | (out["dup_line_char_share"] > LINE_CHAR_SHARE)
    return out | {"kept": ~bad & ~out["base_failed"]}


def _arrow(name: str, values: np.ndarray) -> pa.Array:
    if values.ndim == 2:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))
    return pa.array(values.astype(np.int64) if values.dtype.kind == "i" else values)


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the measures (SIGNALS) and the verdict `kept`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "text"):
            found = {k: _arrow(k, v) for k, v in signals(piece.column(1)).items()}
            yield pa.RecordBatch.from_arrays([piece.column(0), *found.values()], [id_col, *found])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, rows.schema[0].dataType), *T.StructType.fromDDL(SIGNALS)]))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns whatever their names, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "text"):
            yield piece.select(["row"]).filter(pa.array(signals(piece.column(0))["kept"]))

    # The text goes to Python once, beside the row as one value: names with dots and repeated names stay as they are.
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    rows = plain.select(F.col(names[docs.columns.index(text_col)]).alias("text"), F.struct(*names).alias("row"))
    kept = rows.mapInArrow(run, T.StructType([rows.schema["row"]]))
    return kept.select(*[F.col(f"row.{name}") for name in names]).toDF(*docs.columns)
