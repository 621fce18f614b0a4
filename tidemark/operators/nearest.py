"""Exact nearest bit vectors by multi-index hashing.

A vector's bits are cut into m bands. Two vectors that differ in at most m * (s + 1) - 1 bits differ in at most s bits of
some band, so the candidates that lie within s bits of a query in some band hold all those within that
distance. Bands are an index: equi-joins on (band, bits of the band) with the words at distance 0, 1, 2, ... of
the query's. After each step the queries whose answer lies within the proven distance are done; only the others go on.
The words at a distance grow in number like binomials, so when a step's words, and the candidates that
they are likely to meet, would cost more than all distances,
the queries that are left are compared with every candidate, blocks of one with blocks of the other: this bounds
the cost of far vectors and is as exact.

A pair meets in up to m bands and steps, but counts in one alone: at its least band distance, in the first band that has
it. So nothing has to be made distinct, and how many candidates a query has met is a plain count. When it has met all
of them it is done as well, which is how far vectors end.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.scratch import written

#: Distances that are probed at once.
STEPS = 2
#: Comparisons of whole vectors in blocks that cost no more than making, shuffling and joining one probe.
PAIRS_A_PROBE = 64
#: Probes that cost no more than a candidate that a probe meets: it is compared band by band, written and ranked.
PROBES_A_MATCH = 3
#: Queries, or candidates, of a block, about.
BLOCK = 8192


def bands(words: int, bits: int, candidates: int) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of each band: of about log2(candidates) bits, so that one value of a band has few candidates."""
    parts = max(1, round(bits / max(4.0, math.log2(max(candidates, 2)))))
    edges = [round(i * bits / parts) for i in range(parts + 1)]
    return [(word, a, b - a) for word in range(words) for a, b in zip(edges, edges[1:]) if b > a]


def _cost(cuts: list[tuple[int, int, int]], steps: range, candidates: int) -> float:
    """Comparisons in blocks that cost as much as a query's probes at these distances, if the candidates' words are spread evenly."""
    return PAIRS_A_PROBE * sum(math.comb(width, step) * (1 + PROBES_A_MATCH * candidates / 2**width) for *_, width in cuts for step in steps)


def _cut(words: Column | str, band: tuple[int, int, int]) -> Column:
    word, first, width = band
    return F.shiftrightunsigned(F.get(words, F.lit(word)), first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _matched(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """A join by query that isn't a broadcast: sizes are guessed from packed files, and all of a table would go through the driver."""
    return rows.join(other.hint("merge"), "query", how)


def _best(rows: DataFrame, n: int, rival: bool) -> DataFrame:
    """The n nearest of each query and, if asked for, the nearest of the best one's and of one other day."""
    order = ["distance", "candidate"]
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("place") <= n)
    if not rival:
        return top.select("query", "candidate", "day", "distance", "place", F.lit(None).cast("int").alias("day_place"))
    # per day first (partial sums shrink what is shuffled), then the two nearest days
    days = rows.groupBy("query", "day").agg(F.min(F.struct(*order)).alias("m")).select("query", "day", "m.*")
    days = days.withColumn("day_place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter("day_place <= 2")
    both = top.select("query", "candidate", "day", "distance", "place", F.lit(None).cast("int").alias("day_place")).unionByName(days.select("query", "candidate", "day", "distance", F.lit(None).cast("int").alias("place"), "day_place"))
    return both.groupBy("query", "candidate", "distance").agg(F.first("day").alias("day"), F.max("place").alias("place"), F.max("day_place").alias("day_place"))


def _of_blocks(queries: pa.Table, candidates: pa.Table, n: int, words: int, rival: bool) -> pa.Table:
    """The n nearest candidates of a block to each query of another and, if asked for, the nearest of another day than the best one's."""
    candidates = candidates.sort_by("candidate")
    q, c = (np.asarray(x["bits"].combine_chunks().flatten()).view(np.uint64).reshape(-1, words) for x in (queries, candidates))
    own = np.asarray(pc.fill_null(pc.index_in(queries["query"], candidates["candidate"]), -1))
    day = np.asarray(candidates["day"].combine_chunks().dictionary_encode().indices)
    kind = np.uint32 if (64 * words + 1) * len(c) < 1 << 32 else np.uint64
    none, place, out = np.iinfo(kind).max, np.arange(len(c), dtype=kind), []
    at_once = max(1, (1 << 18) // max(1, len(c)))
    for at in range(0, len(q) if len(c) else 0, at_once):
        distance = reduce(np.add, (np.bitwise_count(q[at : at + at_once, None, w] ^ c[:, w]).astype(kind) for w in range(words)))
        key = distance * kind(len(c)) + place  # orders by distance, then candidate
        mine = own[at : at + at_once]
        key[np.flatnonzero(mine >= 0), mine[mine >= 0]] = none
        best = np.sort(np.partition(key, n - 1, 1)[:, :n] if n < len(c) else key, 1)
        if rival:
            other = np.where(day == day[best[:, :1] % len(c)], none, key).min(1)
            best = np.c_[best, np.where(other > best[:, -1], other, none)]
        row, column = np.nonzero(best != none)
        out.append((at + row, best[row, column]))
    row, key = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, kind))
    found = candidates.select(["candidate", "day"]).take(pa.array(key % max(1, len(c)), pa.int64()))
    return pa.table([queries["query"].take(pa.array(row)), *found.columns, pa.array(key // max(1, len(c)), pa.int32())], ["query", "candidate", "day", "distance"])


def _all_pairs(queries: DataFrame, n_queries: int, candidates: DataFrame, n_candidates: int, n: int, words: int, bits: int, rival: bool) -> DataFrame:
    """(query, candidate, day, distance) from which _best() makes the answer: every query against every candidate, a task having a block of each."""
    q_blocks, c_blocks = -(-n_queries // BLOCK), -(-n_candidates // BLOCK)
    whole = F.array(*[F.get("bits", F.lit(i)).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")) for i in range(words)])

    def dealt(rows: DataFrame, key: str, own: tuple[str, int], other: tuple[str, int]) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(own[1])).cast("int").alias(own[0])
        rows = rows.withColumn("bits", whole).filter(~F.exists("bits", lambda x: x.isNull()))
        return rows.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1))).alias(other[0]))

    left = dealt(queries.select("query", "bits"), "query", ("q_block", q_blocks), ("c_block", c_blocks))
    right = dealt(candidates.select("candidate", "day", "bits"), "candidate", ("c_block", c_blocks), ("q_block", q_blocks))
    fields = [left.schema["query"], right.schema["candidate"], right.schema["day"], T.StructField("distance", T.IntegerType())]
    blocks = left.groupBy("q_block", "c_block").cogroup(right.groupBy("q_block", "c_block"))
    return blocks.applyInArrow(lambda a, b: _of_blocks(a, b, n, words, rival), T.StructType(fields))


def nearest(queries: DataFrame, candidates: DataFrame, n: int, words: int, bits: int, rival: bool = False) -> DataFrame:
    """(query, candidate, day, distance, place, day_place, compared): the n nearest candidates of each query other than itself, ties by candidate.

    queries: query, bits; candidates: candidate, day, bits; bits are arrays of `words` integers of `bits` bits.
    place is 1 to n; with rival the nearest candidates of the nearest two days have day_place 1 and 2, and may have no
    place. compared is the number of candidates that stood for comparison. Candidates are distinct and days aren't null.
    """
    total = candidates.count()
    cuts = bands(words, bits, total)
    m, widest = len(cuts), max(width for *_, width in cuts)
    cut = lambda column: F.array(*[F.struct(F.lit(i).alias("band"), _cut(column, band).alias("word")) for i, band in enumerate(cuts)])
    index = written(candidates.select("candidate", "day", F.col("bits").alias("c_bits"), F.explode(cut("bits")).alias("b")).select("candidate", "day", "c_bits", "b.*"), "bands")
    members = _matched(queries.select("query"), candidates.select(F.col("candidate").alias("query")), "left_semi").withColumn("self", F.lit(1))
    left = written(_matched(queries, members, "left").select("query", "bits", (F.lit(total) - F.coalesce("self", F.lit(0))).alias("compared"), F.lit(0).cast("long").alias("met")), "queries")
    differ = F.zip_with("q_bits", "c_bits", lambda a, b: a.bitwiseXOR(b))
    apart = F.array(*[F.bit_count(_cut("x", band)) for band in cuts])
    widths = F.array(*[F.lit(width) for *_, width in cuts])

    def probes(step: int) -> DataFrame:
        """The open queries' words at distance step in each band: bits are flipped in ascending order, so each is made once."""
        rows = left.select("query", F.col("bits").alias("q_bits"), F.explode(cut("bits")).alias("b")).select("query", "q_bits", "b.*", F.lit(-1).alias("flip"))
        for _ in range(step):
            rows = rows.filter(F.col("flip") + 1 < F.get(widths, F.col("band"))).withColumn("flip", F.explode(F.sequence(F.col("flip") + 1, F.get(widths, F.col("band")) - 1)))
            rows = rows.withColumn("word", F.col("word").bitwiseXOR(F.expr("shiftleft(1L, flip)")))
        return rows.drop("flip").withColumn("step", F.lit(step))

    kept, done, still = None, [], 0
    for first in range(0, widest + 1, STEPS):
        steps = range(first, min(first + STEPS, widest + 1))
        if first and _cost(cuts, steps, total) > total:
            found = _all_pairs(left, still, candidates, total, n, words, bits, rival)
            done.append(_matched(written(_best(written(found, "pairs"), n, rival), "nearest"), left.select("query", "compared")))
            break
        # the probes' size can't be foreseen, so they are not for a broadcast
        pairs = reduce(DataFrame.unionByName, map(probes, steps)).join(index.hint("merge"), ["band", "word"]).filter("query <> candidate").withColumn("x", differ).withColumn("apart", apart)
        new = pairs.filter((F.array_min("apart") == F.col("step")) & (F.array_position("apart", F.col("step")) == F.col("band") + 1))
        new = written(new.select("query", "candidate", "day", F.aggregate("apart", F.lit(0), lambda s, d: s + d).alias("distance")), "pairs")
        kept = written(_best(new if kept is None else kept.select(*new.columns).unionByName(new), n, rival), "nearest")
        proven = m * (steps[-1] + 1) - 1
        reached = kept.groupBy("query").agg(F.max(F.when(F.col("place") == n, F.col("distance"))).alias("last"), F.max(F.when(F.col("day_place") == 2, F.col("distance"))).alias("other"))
        enough = F.coalesce(F.col("last") <= proven, F.lit(False)) & (F.coalesce(F.col("other") <= proven, F.lit(False)) if rival else F.lit(True))
        met = F.col("met") + F.coalesce("more", F.lit(0))
        counted = _matched(_matched(left, new.groupBy("query").agg(F.count("*").alias("more")), "left"), reached, "left")
        left = written(counted.select("query", "bits", "compared", met.alias("met"), (enough | (met == F.col("compared")) | F.lit(steps[-1] == widest)).alias("over")), "queries")
        done.append(_matched(kept, left.filter("over").select("query", "compared")))
        left = left.filter("NOT over")
        still = left.count()
        if not still:
            break
        kept = _matched(kept, left.select("query"), "left_semi")
    return reduce(DataFrame.unionByName, done)
