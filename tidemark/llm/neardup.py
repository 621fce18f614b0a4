"""Near-duplicate classes with Order MinHash, verified by banded alignment.

A document's k-mers are its five-word shingles, each labelled with its occurrence
number. For each of several hash functions the ORDER smallest labelled k-mers are
taken and kept in text order; their ordered hash is the sketch. Two texts share a
sketch with a probability that falls with their edit distance, and reordered
passages don't count as equal. Edits just at the threshold can leave few five-word
shingles, and none if every fifth word is another, so further sketches take
three-word k-mers, two of five of which such edits leave. Short texts, of fewer than LONG words,
have k-mers of two words, and texts from 0.8 LONG to LONG words have all kinds (KINDS),
so that similar texts always have one in common.

1. Equal texts become one node (128-bit hash), so copies cost one row each.
2. Nodes that share a sketch are compared with the bucket's leader only (a star,
   so a bucket of n nodes gives n - 1 pairs).
3. All pairs of a bucket that are in different components after that are tried as
   well, so no leader hides a link. Nodes meet those of their own class of lengths and of
   the next one only, as other lengths rule a pair out; there, folded bags of words (BINS
   counters a text) bound the similarity from above in blocks of BLOCK nodes, and the
   pairs which that bound admits are aligned there, each in one of the buckets that its
   nodes share. Only links between components leave a block. In a bucket of many
   unrelated clusters bounds and rows are quadratic in their number, the rows by blocks.
4. A pair holds if the word edit distance is at most (1 - SIMILARITY) of the longer
   text. Bag-of-words distance bounds it from below; the rest is decided by a
   bit-parallel alignment inside a diagonal band, which grows up to that width.
5. Connected components of the verified pairs before and after step 3: stars are drawn
   together into a graph of their centres, and that one's components come by
   alternating star contractions in Spark; each round is written to the shared folder.

Keys that many rows share (a sketch, a leader, a hub, a class, a text) meet their one
other side by broadcast or salted, see `spread_join` and `_with_words`.

The edit similarity of 0.8 was chosen because the sketch is made for it; pairs
of five-word shingle Jaccard similarity 0.8 or more satisfy it as well.

Texts without words are equal to their exact copies only. Null texts count as empty.
Null ids take part, and a class without any other id has a null class id. Rows with
one id are nodes of their own, by text. Extra columns are not read. Texts may have any
length: the places of up to 2**22 words share a 64-bit word with the k-mer's hash, longer
ones take more of its bits. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import jobs
from tidemark.llm import textkernel as K

ORDER, SIMILARITY = 2, 0.8
#: Texts of fewer words have k-mers of two words.
LONG = 25
_BOTH = int(SIMILARITY * LONG)
#: Kinds of k-mers: their words, the sketches of each text, and the sizes of text that take them (from, to).
KINDS = ((5, 12, _BOTH, None), (3, 48, _BOTH, None), (2, 48, 1, LONG))
#: Rows of one key are too many beyond LEAST_HEAVY and beyond a share of 1 / HEAVY of all rows.
HEAVY, LEAST_HEAVY = 10_000, 1_000
#: Nodes and text of a block, and counters of a folded bag of words.
BLOCK, BLOCK_BYTES, BINS = 4096, 16 << 20, 512
_INDEX_BITS = 22
#: Width of the first band that an alignment tries; it is widened four times until the pair holds or the whole width was tried.
FIRST_BAND = 64
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _labelled(words: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers of a batch in text order, and their bounds by row."""
    n = np.diff(bounds)
    count = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    edges = np.r_[0, np.cumsum(count)]
    row = np.repeat(np.arange(len(n)), count)
    at = bounds[:-1][row] + np.arange(len(row)) - edges[:-1][row]
    keys = np.empty(len(row), np.uint64)
    for length, hashes in K.rolling(words, tuple(range(1, shingle + 1))):
        mine = np.minimum(n[row], shingle) == length
        keys[mine] = hashes[at[mine]]
    salted = keys ^ K.mix(np.arange(1, len(n) + 1, dtype=np.uint64))[row]
    order = np.argsort(salted, kind="stable")
    same = np.r_[False, salted[order][1:] == salted[order][:-1]] if len(order) else np.zeros(0, bool)
    if same.any():
        head = np.flatnonzero(~same)
        rank = np.arange(len(order)) - np.repeat(head, np.diff(np.r_[head, len(order)]))
        keys[order] = np.where(same, K.mix(keys[order] + rank.astype(np.uint64)), keys[order])
    return keys, edges


def sketches(words: np.ndarray, bounds: np.ndarray, count: int, shingle: int = KINDS[0][0], index_bits: int = _INDEX_BITS) -> np.ndarray:
    """Order MinHash of each row: (rows, count) hashes; rows without words have zeros."""
    keys, edges = _labelled(words, bounds, shingle)
    out = np.zeros((len(bounds) - 1, count), np.uint64)
    live = np.flatnonzero(np.diff(edges))
    if not len(live):
        return out
    starts = edges[:-1][live]
    size = np.diff(edges)[live]
    local = (np.arange(len(keys)) - np.repeat(starts, size)).astype(np.uint64)
    low = np.uint64((1 << max(index_bits, int(size.max()).bit_length())) - 1)
    for j in range(count):
        factor, mask = (np.uint64(x) | np.uint64(1) for x in K.mix(np.array([2 * j + 1, 2 * j + 2], np.uint64)))
        value = (((keys ^ mask) * factor) & ~low) | local
        chosen = []
        for _ in range(ORDER):
            least = np.minimum.reduceat(value, starts)
            place = np.where(least == _FULL, 0, (least & low).astype(np.int64))
            chosen.append(place)
            value[starts + place] = _FULL
        places = np.sort(np.stack(chosen), 0)  # back in text order; a single k-mer stands for itself
        value = np.full(len(live), (shingle << 16) + j + 1, np.uint64)
        for place in places:
            value = K.mix(value * np.uint64(0x9E3779B97F4A7C15) + keys[starts + place])
        out[live, j] = np.where(value == 0, 1, value)
    return out


def _nodes(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _of_all_kinds(words: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Each row's sketches, those of one kind of k-mers after those of another."""
    n = np.diff(bounds)
    kinds = []
    for shingle, count, least, below in KINDS:
        rows = np.flatnonzero((n >= least) & (n < below) if below else n >= least)
        part = np.repeat(np.isin(np.arange(len(n)), rows), n)
        kinds.append((np.repeat(rows, count), sketches(words[part], np.r_[0, np.cumsum(n[rows])], count, shingle)))
    row = np.concatenate([rows for rows, _ in kinds])
    order = np.argsort(row, kind="stable")
    offsets = np.searchsorted(row[order], np.arange(len(n) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([x.ravel() for _, x in kinds])[order].view(np.int64)))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, node, sketches)"""
    for piece in K.pieces(batches, "text"):
        data, offsets = K.text_bytes(piece.column(1))
        starts, ends, bounds = K.word_spans(data, offsets, K.NOT_WHITE)
        lists = _of_all_kinds(K.span_hashes(data, starts, ends), bounds)
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(_nodes(data, offsets), pa.binary()), lists], ["id", "node", "sketches"])


def folded_bag(words: np.ndarray) -> np.ndarray:
    """Words counted in BINS counters, which stop at 255; the size of the text tells what is above."""
    return np.minimum(np.bincount(words % BINS, minlength=BINS), 255).astype(np.uint8)


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, words, size, bag): each text as 32-bit word hashes."""
    for piece in K.pieces(batches, "text"):
        data, offsets = K.text_bytes(piece.column(0))
        starts, ends, bounds = K.word_spans(data, offsets, K.NOT_WHITE)
        words = (K.span_hashes(data, starts, ends) >> np.uint64(32)).astype(np.uint32)
        texts = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        columns = [pa.array(_nodes(data, offsets), pa.binary()), pa.array([x.tobytes() for x in texts], pa.binary()), pa.array(np.diff(bounds)), pa.array([folded_bag(x).tobytes() for x in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "words", "size", "bag"])


def within_band(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two sequences is at most `most`.

    Bit-parallel dynamic programming on one diagonal band of 2 * most + 1 cells, in the
    manner of Myers and Hyyrö: in column j, bit d stands for row j + d - most.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most or not most:
        return n == m and bool((a == b).all())
    full = (1 << (2 * most + 1)) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i + most
    up, down, score = full >> most << most, 0, most  # vertical steps of +1 and -1; the band's lowest cell
    for j, x in enumerate(b.tolist()):
        match = where.get(x, 0) >> j & full
        diagonal = ((match & up) + up ^ up | match | down) & full
        plus, minus = (down | ~(diagonal | up)) & full, diagonal & up
        score += not diagonal >> 2 * most
        up, down = (minus | ~(diagonal >> 1 | plus)) & full, diagonal >> 1 & plus
    rows = ((1 << 2 * most) - 1) >> n - m + most << n - m + most  # from the lowest cell up to row n
    return score - (up & rows).bit_count() + (down & rows).bit_count() <= most


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common beginning and end."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    tail = n - 1 - int(differ[-1]) if len(differ) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the word edit distance is at most (1 - similarity) of the longer sequence."""
    longest = max(len(a), len(b))
    most = int((1 - similarity) * longest + 1e-9)
    if longest - min(len(a), len(b)) > most:
        return False
    if len(a) == len(b) and int((a != b).sum()) <= most:
        return True
    values, counts = np.unique(np.r_[a, b], return_counts=True)
    mine = np.zeros(len(values), np.int64)
    ua, ca = np.unique(a, return_counts=True)
    mine[np.searchsorted(values, ua)] = ca
    if longest - int(np.minimum(mine, counts - mine).sum()) > most:
        return False
    a, b = _trimmed(a, b)
    band = min(most, FIRST_BAND)  # near copies are mostly much nearer than they need be
    while not (near := within_band(a, b, band)) and band < most:
        band = min(most, 4 * band)
    return near


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("node_words", "leader_words"))
        good = [similar(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)) for x, y in zip(a, b, strict=True)]
        yield batch.select(["node", "leader"]).filter(pa.array(good, pa.bool_()))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """left with the row of right that has its keys; right's column n says how many of left's rows have them, and goes.

    left's rows of keys that more than `limit` of them share stay where they are, and the
    few rows of right for such keys are broadcast; only the other rows are shuffled.
    """
    few = F.broadcast(right.filter(F.col("n") > limit).drop("n"))
    rest = left.join(few.select(keys), keys, "left_anti").join(right.filter(F.col("n") <= limit).drop("n"), keys)
    return left.join(few, keys).unionByName(rest)


def _limit(rows: int) -> int:
    """Rows of one key that are too many; fewer than HEAVY keys can have more."""
    return max(LEAST_HEAVY, rows // HEAVY)


def _contracted(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, root) of the edges' components, by alternating large-star and small-star contractions."""
    seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    for k in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = jobs.materialize(new, f"edges-{k}")
        before, seen = seen, new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        jobs.discard(edges.sparkSession, edges)
        edges = new
        if seen == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not converge")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the least node of each connected component, for the nodes of edges (a, b).

    Every node first goes to its least smaller neighbour; the edges between those centres,
    without repeats, are the graph that is contracted. A hub's neighbours thus are one
    edge or none, and nothing gathers them: their roots come by `spread_join`.
    """
    edges = jobs.materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nearest = jobs.materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "nearest")
    centres = jobs.materialize(edges.select("b").distinct(), "centres")
    between = edges.join(nearest, "a").select("b", "m").unionByName(nearest.join(centres, nearest["a"] == centres["b"], "left_semi").select(F.col("a").alias("b"), "m"))
    between = jobs.materialize(between.filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).distinct(), "between-centres")
    roots = _contracted(between, rounds).select(F.col("node").alias("m"), "root")
    held = nearest.groupBy("m").agg(F.count("*").alias("n")).join(roots, "m", "left").select("m", F.coalesce("root", "m").alias("root"), "n")
    moved = spread_join(nearest, held, ["m"], _limit(nearest.count())).select(F.col("a").alias("node"), "root")
    alone = centres.join(nearest, centres["b"] == nearest["a"], "left_anti").select(F.col("b").alias("m")).join(roots, "m", "left").select(F.col("m").alias("node"), F.coalesce("root", "m").alias("root"))
    out = jobs.materialize(moved.unionByName(alone), "roots")
    jobs.discard(edges.sparkSession, edges, nearest, centres)
    return out


def _with_words(pairs: DataFrame, words: DataFrame, column: str, rows: int) -> DataFrame:
    """pairs with the words of one side; a text of very many pairs is copied to several salts."""
    side = words.select(F.col("node").alias(column), F.col("words").alias(f"{column}_words"))
    heavy = pairs.groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") > _limit(rows)).select(column, F.ceil(F.col("n") / _limit(rows)).alias("salts"))
    one = F.lit(1).cast("long")
    salted = pairs.join(F.broadcast(heavy), column, "left").withColumn("salt", F.pmod(F.xxhash64("node", "leader"), F.coalesce("salts", one))).drop("salts")
    copied = side.join(F.broadcast(heavy), column, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", one) - 1))).drop("salts")
    return salted.join(copied, [column, "salt"]).drop("salt")


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (node, leader) whose words are similar, as a table."""
    words = words.select("node", "words")
    pairs = jobs.materialize(pairs.select("node", "leader"), "candidates")
    rows = pairs.count()
    both = _with_words(_with_words(pairs, words, "node", rows), words, "leader", rows)
    good = jobs.materialize(both.mapInArrow(_verified, "node binary, leader binary"), "pairs")
    jobs.discard(pairs.sparkSession, pairs)
    return good


def _cell_pairs(left: np.ndarray, right: np.ndarray | None, root: np.ndarray, size: np.ndarray, bags: np.ndarray, own: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of different components (left x right, or all of left) that lengths and folded bags admit.

    At least one of the two is `own`, of the cell's class of lengths.
    """
    above = np.maximum(size - bags.sum(1, dtype=np.int64), 0)  # words beyond full counters
    other, found = left if right is None else right, []
    step = max(1, (1 << 17) // max(1, len(other)))
    for k in range(0, len(left), step):
        some = left[k : k + step]
        i, j = np.divmod(np.arange(len(some) * len(other)), len(other))
        keep = i + k < j if right is None else np.ones(len(i), bool)
        i, j = some[i[keep]], other[j[keep]]
        longest, shortest = np.maximum(size[i], size[j]), np.minimum(size[i], size[j])
        least = longest - ((1 - similarity) * longest + 1e-9).astype(np.int64)  # words in common at least
        keep = (root[i] != root[j]) & (shortest >= least) & (own[i] | own[j])
        i, j, least = i[keep], j[keep], least[keep]
        for a in range(0, len(i), 1 << 14):
            x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            keep = np.minimum(bags[x], bags[y]).sum(1, dtype=np.int64) + np.minimum(above[x], above[y]) >= least[a : a + (1 << 14)]
            found.append((x[keep], y[keep]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *side]) for side in zip(*found, strict=True)) if found else (none, none)


def _chosen_here(i: np.ndarray, j: np.ndarray, sketch: np.ndarray, lists: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether this bucket is the one, of all that a pair shares, in which it is aligned (drawn by the pair's hash)."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 14):
        x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
        shared = (lists[x] == lists[y]) & (lists[x] != 0)
        drawn = (K.mix(names[x] ^ names[y]) % np.maximum(shared.sum(1), 1).astype(np.uint64)).astype(np.int64)
        at = (shared & (np.cumsum(shared, 1) == drawn[:, None] + 1)).argmax(1)
        out[a : a + (1 << 14)] = lists[x, at] == sketch[x]
    return out


def _links(i: np.ndarray, j: np.ndarray, root: np.ndarray, words: list[np.ndarray]) -> list[bool]:
    """Which pairs hold, but for those whose components earlier ones have joined."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(int(root[x])), top(int(root[y]))
        held = a != b and similar(words[x], words[y])
        if held:
            parent[a] = b
        out.append(held)
    return out


_CELL = ["sketch", "lengths", "p", "q"]
_ALL = sum(count for _, count, _, _ in KINDS)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell to the pairs that hold (all pairs, where there are no texts); a cell is about two blocks."""
    held: list[pa.RecordBatch] = []

    def pairs_of(rows: pa.Table) -> pa.RecordBatch:
        key = np.stack([rows[c].to_numpy() for c in _CELL], 1)
        cuts = np.r_[np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]), len(key)]
        node, block, size, own = rows["node"].combine_chunks(), rows["block"].to_numpy(), rows["size"].to_numpy(), rows["own"].to_numpy()
        root = rows["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        bags = np.frombuffer(b"".join(x.as_buffer() for x in rows["bag"]), np.uint8).reshape(-1, BINS)
        left, right = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = np.arange(a, b)
            mine = block[a:b] == key[a, 2]
            i, j = _cell_pairs(here[mine], None if key[a, 2] == key[a, 3] else here[~mine], root, size, bags, own)
            left.append(i)
            right.append(j)
        i, j = np.concatenate(left), np.concatenate(right)
        if "words" in rows.column_names:
            lists = np.zeros((len(key), _ALL), np.int64)  # in the order of KINDS; the shortest texts have the last kind alone
            for at, x in enumerate(rows["sketches"]):
                found = x.values.to_numpy()
                lists[at, 0 if size[at] >= _BOTH else _ALL - KINDS[-1][1] :][: len(found)] = found
            names = np.array([int.from_bytes(x.as_py()[:8], "little") for x in node], np.uint64)
            good = _chosen_here(i, j, key[:, 0], lists, names)
            i, j = i[good], j[good]
            good = np.array(_links(i, j, root, [np.frombuffer(x.as_buffer(), np.uint32) for x in rows["words"]]), bool)
            i, j = i[good], j[good]
        x, y = (node.take(pa.array(side)).to_pylist() for side in (i, j))
        both = [(max(p), min(p)) for p in zip(x, y, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in both], node.type), pa.array([y for _, y in both], node.type)], ["node", "leader"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in (rows[c].to_numpy() for c in _CELL)]))
        if whole := int(last[-1]) + 1 if len(last) else 0:  # the last cell may go on
            yield pairs_of(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
    if held:
        yield pairs_of(pa.Table.from_batches(held))


def _untried(buckets: DataFrame, roots: DataFrame, tried: DataFrame, block: int = BLOCK, texts: DataFrame | None = None) -> DataFrame:
    """(node, leader): links between components in one bucket; without texts, the pairs to align that weren't compared yet.

    texts has (node, words, size, bag, sketches). Lengths that differ by more than the
    threshold rule a pair out, so a node is in two cells: that of its class of lengths and the
    next one. In a cell the nodes outside the largest component meet each other and that
    component's nodes, in cells of about two blocks; the largest component's nodes don't
    meet each other.
    """
    one = F.lit(1).cast("long")
    plain = texts is None
    if plain:
        texts = buckets.select("node").distinct().withColumn("size", F.lit(0).cast("long")).withColumn("bag", F.unhex(F.lit("FF" * BINS)))
    rows = jobs.materialize(buckets.join(roots, "node", "left").select("sketch", "node", F.coalesce("root", "node").alias("root")), "rooted-buckets")
    mixed = rows.groupBy("sketch").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low <> high").select("sketch", "n")
    rows = spread_join(rows, mixed, ["sketch"], _limit(rows.count())).join(texts.select("node", "size"), "node")
    step = math.log(1.01 / SIMILARITY)  # similar texts are at most one class apart
    rows = rows.withColumn("of", F.floor(F.log(F.greatest("size", one)) / step)).withColumn("lengths", F.explode(F.array("of", F.col("of") + 1)))
    rows = jobs.materialize(rows.withColumn("own", F.col("of") == F.col("lengths")).drop("of"), "mixed-buckets")
    sizes = rows.groupBy("sketch", "lengths", "root").agg(F.count("*").alias("n"), F.max("own").alias("own"), F.sum("size").alias("words"))
    cells = sizes.groupBy("sketch", "lengths").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("roots"), F.max("own").alias("own"), F.sum("words").alias("words")).filter("roots > 1 AND own")
    nodes = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(BLOCK_BYTES / 4 * F.col("n") / F.greatest("words", one))))
    small = F.col("n") <= nodes
    rest, main = F.ceil((F.col("n") - F.col("most")) / nodes), F.ceil(F.col("most") / nodes)
    cells = cells.select("sketch", "lengths", "n", F.when(~small, F.col("main")).alias("main"), F.when(small, 1).otherwise(rest).cast("long").alias("rest"), F.when(small, 0).otherwise(main).cast("long").alias("mains"))
    total = rows.count()
    rows = spread_join(rows, cells, ["sketch", "lengths"], _limit(total))
    rows = rows.withColumn("outside", ~F.coalesce(F.col("root") == F.col("main"), F.lit(False)))
    spot = F.xxhash64("node")
    rows = rows.withColumn("block", F.when(F.col("outside"), F.pmod(spot, F.col("rest"))).otherwise(F.col("rest") + F.pmod(spot, F.greatest("mains", one))))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("outside"), F.col("rest") + F.col("mains")).otherwise(F.col("rest")) - 1)))
    rows = rows.select("sketch", "lengths", "node", "root", "block", "own", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q")).join(texts, "node")
    width = jobs.shuffle_width(buckets.sparkSession, 2 * total, 100_000)
    kind = buckets.schema["node"].dataType.simpleString()
    pairs = rows.repartition(width, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(_aligned, f"node {kind}, leader {kind}")
    if not plain:
        return pairs
    tried = tried.select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader")).distinct()
    return pairs.distinct().join(tried, ["node", "leader"], "left_anti")


def _led(buckets: DataFrame) -> DataFrame:
    """(sketch, node, leader) of the buckets with two nodes or more, the leader's own row included, as a table."""
    leaders = jobs.materialize(buckets.groupBy("sketch").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "leaders")
    total = leaders.agg(F.sum("n")).first()[0] or 0
    return jobs.materialize(spread_join(buckets, leaders, ["sketch"], _limit(total)), "buckets")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, class_id (the least id of its class), class_size, exact_copies (rows with the same text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketched = jobs.materialize(rows.mapInArrow(_sketched, T.StructType([rows.schema[0], *T.StructType.fromDDL("node binary, sketches array<bigint>")])), "sketches")
    nodes = jobs.materialize(sketched.groupBy("node").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("sketches").alias("sketches")), "nodes")
    buckets = _led(nodes.select("node", F.explode("sketches").alias("sketch")))
    wanted = jobs.materialize(buckets.select("node").distinct(), "wanted")
    picked = nodes.select("node", "least_id").join(wanted, "node", "left_semi").select(F.col("least_id").alias("picked")).distinct()
    texts = rows.join(picked, rows["id"].eqNullSafe(picked["picked"]), "left_semi")
    words = texts.select("text").mapInArrow(_worded, "node binary, words binary, size long, bag binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    words = jobs.materialize(words, "words")
    pairs = buckets.filter("node <> leader").select("node", "leader").distinct()
    found = verified(pairs, words)
    linked = lambda pairs: components(pairs.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    roots = linked(found)
    texts = words.join(nodes.select("node", "sketches"), "node")
    more = jobs.materialize(_untried(buckets.select("sketch", "node"), roots, pairs, texts=texts), "links-in-buckets")
    if not more.isEmpty():
        roots = linked(roots.select("node", F.col("root").alias("leader")).unionByName(more))
    rooted = nodes.select("node", "least_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = rooted.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n"))
    known = spread_join(rooted, classes, ["root"], _limit(nodes.count()))
    known = jobs.materialize(known.select("node", "class_id", "class_size", F.col("copies").alias("exact_copies")), "known")
    jobs.discard(spark, words, nodes, buckets, wanted)
    out = spread_join(sketched.select("id", "node"), known.withColumn("n", F.col("exact_copies")), ["node"], _limit(sketched.count()))
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", "exact_copies")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the least id of their class, all columns kept.

    Rows that share one id are one document and stay or go together; rows without an id stay.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    plain, key = docs.toDF(*names), names[docs.columns.index(id_col)]
    known = plain.filter(F.col(key).isNotNull())
    classes = near_duplicate_classes(known.select(F.col(key).alias("id"), F.col(names[docs.columns.index(text_col)]).alias("text")), "id", "text")
    chosen = classes.filter(F.col("id") == F.col("class_id")).select(F.col("id").alias(key)).distinct()
    return known.join(chosen, key, "left_semi").select(names).unionByName(plain.filter(F.col(key).isNull())).toDF(*docs.columns)
