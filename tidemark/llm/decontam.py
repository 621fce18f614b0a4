"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each task cuts its documents into shards of bounded size. Of a shard's word
positions only those stay whose first words also begin some test suffix (a bit
table tells), their suffixes are sorted, and every test suffix is searched in
that sorted array by bisection. A run of equal suffixes gives all places of a
match; their union are the hit words. Where asked for, matches that follow each other
along a diagonal make up the longest verbatim matches of each item: that lists every
pair of equal places, which is quadratic in the repeats of a phrase. No shuffle: the
training texts never move.

The test set is read in blocks of at most BLOCK_WORDS words, so what one task
carries is bounded. A test set of one block needs one pass over the documents;
a larger one takes a pass for each block, with the hits so far carried as columns
of a table in the shared folder.

Null texts have no words on either side. Null item ids are matched like others
and left out of the items' list. Rows are judged one by one, so repeated
rows and ids do no harm; the same window in several items counts for each. An
empty table on either side gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import jobs
from tidemark.llm import textkernel as K

WINDOW = 10
#: Test words that one pass carries to the tasks: 8 bytes each, 80 for each sorted suffix.
BLOCK_WORDS = 500_000
_TABLE_BITS = 22
_MATCH = "array<struct<item_id:bigint,item_word:int,doc_word:int,n_words:int>>"
#: Columns that a pass adds; hit_from and hit_to are word intervals, end exclusive, merged.
HITS = f"n_words long, hit_from array<int>, hit_to array<int>, items array<bigint>, matches {_MATCH}"


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.text_bytes(column)
    data = K.LOWER[data]
    starts, ends, bounds = K.word_spans(data, offsets, K.ALNUM)
    return K.span_hashes(data, starts, ends), bounds


def _suffixes(words: np.ndarray, at: np.ndarray, last: np.ndarray, depth: int, fill: int = 0) -> np.ndarray:
    """The first depth words from each position, up to last, as byte strings that sort like word sequences."""
    place = at[:, None] + np.arange(depth)
    inside = place < last[:, None]
    values = np.where(inside, words[np.minimum(place, max(0, len(words) - 1))] if len(words) else np.uint64(0), np.uint64(fill))
    return np.ascontiguousarray(values.astype(">u8")).view(f"S{8 * depth}").ravel()


class TestBlock:
    """The distinct windows of some test items, and the items and places that hold each."""

    def __init__(self, column: pa.Array, ids: list[int | None], window: int = WINDOW):
        words, bounds = _word_hashes(column)
        sizes = np.diff(bounds)
        length = np.minimum(sizes, window)
        count = np.where(sizes > 0, sizes - length + 1, 0)
        item = np.repeat(np.arange(len(sizes)), count)
        place = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        at, n = bounds[:-1][item] + place, length[item]
        low = _suffixes(words, at, at + n, window)
        order = np.lexsort((n, low))
        new = np.r_[True, (low[order][1:] != low[order][:-1]) | (n[order][1:] != n[order][:-1])][: len(order)]
        head = order[new]
        self.window, self.low, self.length = window, low[head], n[head]
        self.high = _suffixes(words, at[head], at[head] + n[head], window, 0xFFFFFFFFFFFFFFFF)
        self.first = np.r_[np.flatnonzero(new), len(order)]
        self.item, self.place = item[order], place[order].astype(np.int32)
        self.ids = np.array([-1 if x is None else x for x in ids], np.int64)
        self.known = np.array([x is not None for x in ids], bool)
        #: words that every window has, and the bit table of those beginnings
        self.least = int(min(3, self.length.min())) if len(head) else 1
        self.bits = np.zeros(1 << _TABLE_BITS, bool)
        if len(head):
            begins = words[at[head][:, None] + np.arange(self.least)]
            self.bits[self._slot([begins[:, i] for i in range(self.least)])] = True

    @staticmethod
    def _slot(columns: list[np.ndarray]) -> np.ndarray:
        value = np.zeros(len(columns[0]), np.uint64)
        for x in columns:
            value = value * np.uint64(0x9E3779B97F4A7C15) + x
        return (K.mix(value) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position, window) pairs of a shard where the window occurs within one document."""
        n = len(words) - self.least + 1
        if n <= 0 or not len(self.low):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = np.repeat(bounds[1:], np.diff(bounds))
        at = np.flatnonzero(self.bits[self._slot([words[i : n + i] for i in range(self.least)])])
        at = at[at + self.least <= last[at]]
        keys = _suffixes(words, at, last[at], self.window)
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]  # the shard's (sparse) suffix array
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        sizes = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(low)), sizes)
        return at[np.repeat(low, sizes) + np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes)], window


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals that are sorted by start."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]


def _ranked(row: np.ndarray, token: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of the sequences of 1, 2, 4, ... tokens from each place, by row first, until `depth` tokens are told apart."""
    def dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        order = np.lexsort((low, high))
        new = np.r_[False, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])]
        out = np.empty(len(order), np.int32)
        out[order] = np.cumsum(new)
        return out

    ranks = [dense(row, token)]
    while 1 << len(ranks) - 1 < depth:
        after = np.minimum(np.arange(len(row)) + (1 << len(ranks) - 1), len(row) - 1)
        ranks.append(dense(ranks[-1], ranks[-1][after]))  # what reaches beyond its run's end is unique already
    return ranks


def _in_common(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many tokens from i on equal those from j on."""
    i, start = i.copy(), i
    j = j.copy()
    for k in reversed(range(len(ranks))):
        same = ranks[k][i] == ranks[k][j]
        i[same] += 1 << k
        j[same] += 1 << k
    return i - start


def longest_matches(block: TestBlock, at: np.ndarray, window: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, item word, doc word, words) of the longest match of every test suffix in every row, sorted.

    at holds word places of the shard, sorted within a row. Of equally long matches the one with
    the nearer, then the former document suffix counts. A match that only goes on with the
    one of the suffix before it is left out.
    """
    span = int(block.first[-1]) + 1
    seen, place = np.unique(row * span + window, return_index=True)  # the first place of each window in each row
    seen_row, seen_window = np.divmod(seen, span)
    sizes = block.first[seen_window + 1] - block.first[seen_window]
    pair = np.repeat(block.first[seen_window], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pair_row, pair_window = np.repeat(seen_row, sizes), np.repeat(seen_window, sizes)
    item, word = block.item[pair], block.place[pair].astype(np.int64)
    short = block.length[pair_window] < block.window  # items of a single, shorter window
    ends = [(pair_row[short], item[short], word[short], at[np.repeat(place, sizes)[short]], block.length[pair_window[short]].astype(np.int64))]
    whole = np.flatnonzero(~short)
    if len(whole):
        whole = whole[np.lexsort((word[whole], item[whole], pair_row[whole]))]
        full = np.flatnonzero(block.length[window] == block.window)
        owner = np.r_[np.zeros(len(full), np.int64), item[whole] + 1]
        rows, spot, token = np.r_[row[full], pair_row[whole]], np.r_[at[full], word[whole]], np.r_[window[full], pair_window[whole]]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (rows[1:] != rows[:-1]) | (spot[1:] != spot[:-1] + 1)]
        new[len(full)] = True
        run = np.cumsum(new) - 1
        mine = np.arange(len(run)) + run  # places in the array, which has an end token of its own after each run
        n = len(run) + int(run[-1]) + 1
        all_rows, all_tokens, is_doc = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(run) - 1]
        all_rows[mine], all_tokens[mine], is_doc[mine[: len(full)]] = rows, token, True
        all_rows[mine[last] + 1], all_tokens[mine[last] + 1] = rows[last], span + np.arange(len(last))
        of_items = last >= len(full)
        ranks = _ranked(all_rows, all_tokens, int(np.diff(np.r_[-1, last])[of_items].max()) + 1)
        order = np.lexsort((np.arange(n), ranks[-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        docs = np.flatnonzero(is_doc[order])
        suffix = mine[len(full) :]
        behind = np.searchsorted(docs, rank[suffix])
        found = []
        for near in (behind - 1, behind):
            there = order[docs[np.clip(near, 0, len(docs) - 1)]]
            found.append((np.where((near >= 0) & (near < len(docs)), _in_common(ranks, suffix, there), 0), there))
        (before, left), (after, right) = found
        common, there = np.maximum(before, after), np.where(before >= after, left, right)
        on = ~new[len(full) :] & np.r_[False, common[1:] == common[:-1] - 1]
        doc = np.searchsorted(mine[: len(full)], there[~on])
        ends.append((pair_row[whole][~on], item[whole][~on], word[whole][~on], at[full][doc], common[~on] + block.window - 1))
    out = [np.concatenate(x) for x in zip(*ends, strict=True)]
    order = np.lexsort((out[2], out[1], out[0]))
    return tuple(x[order] for x in out)


def _one_row(block: TestBlock, at: np.ndarray, window: np.ndarray, old: dict, longest: list[np.ndarray]) -> dict:
    """A document's hits: at is word places, window is window numbers, both for this document alone."""
    start = np.r_[at, np.array(old["hit_from"], np.int64)]
    end = np.r_[at + block.length[window], np.array(old["hit_to"], np.int64)]
    order = np.argsort(start, kind="stable")
    start, end = _merge(start[order], end[order])
    item = np.unique(np.concatenate([block.item[block.first[w] : block.first[w + 1]] for w in np.unique(window)]))
    items = sorted({*old["items"], *block.ids[item[block.known[item]]].tolist()})
    matches = [{"item_id": int(block.ids[i]) if block.known[i] else None, "item_word": q, "doc_word": p, "n_words": n} for i, q, p, n in zip(*(x.tolist() for x in longest), strict=True)]
    return {"hit_from": start.tolist(), "hit_to": end.tolist(), "items": items, "matches": [*old["matches"], *matches]}


_NONE = {"hit_from": [], "hit_to": [], "items": [], "matches": []}


def _pass(block: TestBlock, schema: pa.Schema, with_matches: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "text"):
            words, bounds = _word_hashes(piece.column(1))
            at, window = block.search(words, bounds)
            row = np.searchsorted(bounds, at, "right") - 1
            order = np.lexsort((window, at))
            at, window, row = at[order], window[order], row[order]
            cut = np.searchsorted(row, np.arange(piece.num_rows + 1))
            longest = longest_matches(block, at, window, row) if with_matches and len(at) else (np.zeros(0, np.int64),) * 5
            cut_longest = np.searchsorted(longest[0], np.arange(piece.num_rows + 1))
            carried = piece.num_columns > 2
            out = []
            for i in range(piece.num_rows):
                old = {k: piece.column(piece.schema.get_field_index(k))[i].as_py() for k in _NONE} if carried else _NONE
                a, b, c, d = *cut[i : i + 2], *cut_longest[i : i + 2]
                mine = [longest[1][c:d], longest[2][c:d], longest[3][c:d] - bounds[i], longest[4][c:d]]
                out.append(_one_row(block, at[a:b] - bounds[i], window[a:b], old, mine) if b > a else old)
            n_words = pa.array(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), n_words, *(pa.array([x[k] for x in out], schema.field(k).type) for k in _NONE)], schema=schema)

    return run


def _blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list[str], list[int | None]]]:
    """The test set a bounded part at a time (toLocalIterator holds one partition)."""
    texts, ids, size = [], [], 0
    for row in items.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        if texts and size + len(row[1]) // 2 > limit:
            yield texts, ids
            texts, ids, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1]) // 2  # words are two characters apart at least
    yield texts, ids


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, with_matches: bool = True) -> DataFrame:
    """Per row: the id, the text and HITS (matches: the longest verbatim match of each test suffix and its word places; none if not asked for)."""
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([*out.schema.fields[:2], *T.StructType.fromDDL(HITS)])
    arrow = pa.schema([("id", _arrow_type(out.schema[0].dataType)), ("text", pa.string()), ("n_words", pa.int64()), ("hit_from", pa.list_(pa.int32())), ("hit_to", pa.list_(pa.int32())), ("items", pa.list_(pa.int64())), ("matches", pa.list_(pa.struct([("item_id", pa.int64()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])))])
    for k, (texts, ids) in enumerate(_blocks(items, item_col, item_text_col, block_words)):
        if k:
            out = jobs.materialize(out, f"hits-{k}")
        out = out.mapInArrow(_pass(TestBlock(pa.array(texts, pa.large_string()), ids, window), arrow, with_matches), schema)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows without any test window, with all their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    clean = benchmark_hits(packed, items, "row", "text", item_col, item_text_col).filter(F.size("hit_from") == 0)
    return clean.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
