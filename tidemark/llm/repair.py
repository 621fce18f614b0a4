"""Conversation structure repair: the cheapest edits that make a conversation `(s?(ua)+)?`, by an auction shortest-path algorithm.

Nodes are (rows read, state), the state being what was last put out: nothing, system, user or
assistant. Arcs are edits with integer costs: Delete, Insert, Keep, Rerole. Every node has a price, which
never exceeds an arc's cost plus the price at its end. A path grows from the origin: where its last node's price equals
the cheapest way on, that arc is added; otherwise the price is raised to it and the path
gives up the node. When the path arrives, the origin's price is the least cost, and every cheapest
path uses tight arcs only (price = cost + price at the end). From any node each letter leads to
one place, so walking the tight arcs in the order of letters gives the ASCII-least audit.

A conversation of up to LONG rows is solved in one piece. Longer ones are sorted by ranges and cut into blocks of BLOCK rows, wherever
they lie: a block's table has the cost of each way through (state before, state after) and the
ASCII order of these ways; the same auction over a conversation's tables says how each block is entered and left,
and blocks then find their own edits. Insertions stand before a row or at the conversation's
end, so that no block's edits are the beginning of another choice's. No task holds more than a block, or one small
row for each block of a conversation. Only SHA-256, which can't be split, takes the repaired lines of one conversation through
one task, as a stream; the audit is one cell.

Null roles and texts count as one space (`damaged` does that; `repair` reads nulls so, too). A null turn comes first; a null
conv_id is a conversation like any other. Rows of one turn are ordered by role and text. A role
without a letter fits nowhere and is reroled or deleted. Repeated rows are duplicates. Texts may be
empty or very long. An empty table gives an empty table. Only the named columns are read, so further columns may have any names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import jobs

LONG, BLOCK = 1024, 512
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: What an insertion or a new role puts out after each state.
FOLLOWS = (USER, USER, ASSISTANT, USER)
#: (state, class of the row's role) where the row may stay; the class is the state that it leads to.
FITS = {(NOTHING, SYSTEM), (NOTHING, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Adjacent classes that are legal in the damaged rows.
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
GOOD, TRUNCATED, UNFIT = range(3)
DELETE, INSERT, REROLE, CUT_SHORT = 4, 3, 3, 3
#: What ends a conversation after each state: cost and insertions.
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))

DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Arc = tuple[object, int, int]  # letter or rank, cost, distance to the node it leads to


def _arcs(code: int, state: int) -> tuple[Arc, ...]:
    """The edits of a row in a state, in the order of their letters. code: class of its role + 4 * fault."""
    kind, fault = code & 3, code >> 2
    found: list[Arc] = [("D", DELETE, 4), ("I", INSERT, FOLLOWS[state] - state)]
    if fault != UNFIT:
        more = CUT_SHORT * (fault == TRUNCATED)
        if (state, kind) in FITS:
            found.append(("K", more, 4 + kind - state))
        found.append(("R", REROLE + more, 4 + FOLLOWS[state] - state))
    return tuple(found)


ARCS = tuple(tuple(_arcs(code, state) for state in range(4)) for code in range(12))
#: No row costs less, whatever the state: the prices begin with sums of these.
LEAST = tuple(min(cost for state in range(4) for letter, cost, _ in ARCS[code][state] if letter != "I") for code in range(12))


def auction(arcs: Callable[[int], Iterable[Arc]], origin: int, last: int, prices: list[int]) -> None:
    """Raise prices until the path from origin arrives at a node from `last` on; those nodes' prices are given and stay."""
    path = [origin]
    while (node := path[-1]) < last:
        cheapest, to = None, node
        for _, cost, far in arcs(node):
            if cheapest is None or cost + prices[node + far] < cheapest:
                cheapest, to = cost + prices[node + far], node + far
        if prices[node] < cheapest:
            prices[node] = cheapest
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def trace(arcs: Callable[[int], Iterable[Arc]], origin: int, last: int, prices: list[int]) -> tuple[list, int]:
    """The first letters in order along tight arcs that arrive, and where."""
    dead: set[int] = set()
    path, letters, ways = [origin], [], [iter(arcs(origin) if origin < last else ())]
    while (node := path[-1]) < last:
        for letter, cost, far in ways[-1]:
            if prices[node] == cost + prices[node + far] and node + far not in dead:
                path.append(node + far)
                letters.append(letter)
                ways.append(iter(arcs(node + far) if node + far < last else ()))
                break
        else:
            dead.add(path.pop())
            ways.pop()
            letters.pop()
    return letters, path[-1]


def _priced(codes: bytes, closing: Iterable[int]) -> list[int]:
    """First prices of the nodes of these rows, which no arc undercuts."""
    closing = list(closing)
    prices, ahead = list(reversed(closing)), min(closing)
    for code in reversed(codes):
        ahead += LEAST[code]
        prices += [ahead] * 4
    return prices[::-1]


def _through(codes: bytes, entry: int, closing: Iterable[int]) -> tuple[int, str, int]:
    """Cost, edits and state after these rows."""
    prices, last = _priced(codes, closing), 4 * len(codes)
    arcs = lambda node: ARCS[codes[node >> 2]][node & 3]
    auction(arcs, entry, last, prices)
    letters, end = trace(arcs, entry, last, prices)
    return prices[entry], "".join(letters), end - last


@functools.lru_cache(1 << 16)
def solve(codes: bytes) -> tuple[int, str]:
    """Least cost and ASCII-least audit of a whole conversation; many conversations have the same codes."""
    cost, edits, state = _through(codes, NOTHING, (cost for cost, _ in CLOSING))
    return cost, edits + CLOSING[state][1]


def _way(codes: bytes, entry: int, to: int) -> tuple[int, str] | None:
    """Cheapest edits that lead from one state into another, or None where none do."""
    if to in (NOTHING, SYSTEM):  # these two are never come back to
        if entry == to:
            return DELETE * len(codes), "D" * len(codes)
        if entry != NOTHING or to == NOTHING:
            return None
        kept = [(CUT_SHORT * (code >> 2), -i) for i, code in enumerate(codes) if code & 3 == SYSTEM and code >> 2 != UNFIT]
        if not kept:
            return None
        more, i = min(kept)  # the later one keeps, the earlier deletions come first
        return DELETE * (len(codes) - 1) + more, "D" * -i + "K" + "D" * (len(codes) - 1 + i)
    never = (DELETE + REROLE + CUT_SHORT) * (len(codes) + 1)
    cost, edits, _ = _through(codes, entry, (0 if state == to else never for state in range(4)))
    return (cost, edits) if cost < never else None


def block_ways(codes: bytes) -> tuple[list[int], list[int]]:
    """Cost of each way (4 * state before + state after; -1: none) and its place in the ASCII order among those from the same state."""
    costs, ranks = [-1] * 16, [-1] * 16
    for entry in range(4):
        found = sorted((way[1], way[0], to) for to in range(4) if (way := _way(codes, entry, to)))
        for rank, (_, cost, to) in enumerate(found):
            costs[4 * entry + to], ranks[4 * entry + to] = cost, rank
    return costs, ranks


def choose(blocks: list[tuple[list[int], list[int]]]) -> tuple[int, list[int], str]:
    """Total cost, the state before each block and after the last, and the closing insertions, from the blocks' tables."""
    last = 4 * len(blocks)
    table = [[tuple((ranks[4 * q + to], costs[4 * q + to], 4 + to - q) for to in sorted(range(4), key=lambda to: ranks[4 * q + to]) if costs[4 * q + to] >= 0) for q in range(4)] for costs, ranks in blocks]
    arcs = lambda node: table[node >> 2][node & 3]
    prices = [0] * last + [cost for cost, _ in CLOSING]
    for b in reversed(range(len(blocks))):
        prices[4 * b : 4 * b + 4] = [min(prices[4 * b + 4 : 4 * b + 8]) + min(c for c in blocks[b][0] if c >= 0)] * 4
    auction(arcs, NOTHING, last, prices)
    ranks, _ = trace(arcs, NOTHING, last, prices)
    states = [NOTHING]
    for b, rank in enumerate(ranks):
        states.append(states[-1] + next(far for r, _, far in arcs(4 * b + states[-1]) if r == rank) - 4)
    return prices[NOTHING], states, CLOSING[states[-1]][1]


def replay(edits: str, state: int, codes: bytes) -> list[tuple[list[int], int]]:
    """For each row the states that are inserted before it, and its own: 0 deleted, -1 as it was, else its new role."""
    rows: list[tuple[list[int], int]] = []
    before: list[int] = []
    for edit in edits.rstrip("I"):
        if edit == "I":
            state = FOLLOWS[state]
            before.append(state)
            continue
        state = {"D": state, "K": codes[len(rows)] & 3, "R": FOLLOWS[state]}[edit]
        rows.append((before, {"D": 0, "K": -1, "R": state}[edit]))
        before = []
    return rows


def _closing_lines(state: int) -> list[str]:
    lines = []
    for _ in CLOSING[state][1]:
        state = FOLLOWS[state]
        lines.append(f"{NAMES[state]}:")
    return lines


def _codes(rows: list[tuple[str, str]]) -> bytes:
    """Class and fault of each (role, text) of a conversation."""
    seen: set[tuple[str, str]] = set()
    out = bytearray()
    for role, text in rows:
        said = text.rstrip(WHITE)
        unfit = not said or (role, text) in seen
        out.append(("sua".find(role[:1]) + 1 if role else 0) + 4 * (UNFIT if unfit else GOOD if said[-1] in ".!?" else TRUNCATED))
        seen.add((role, text))
    return bytes(out)


def _illegal(codes: bytes) -> int:
    return sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:]))


def _digest(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple[dict, list[tuple[str, str]]]:
    """The columns of DIGEST of one whole conversation, and its repaired rows."""
    known = {t for t in turns if t is not None}
    codes = _codes(rows)
    blank = sum(not text.strip(WHITE) for _, text in rows)
    faults = [code >> 2 for code in codes]
    cost, audit = solve(codes)
    state, repaired = NOTHING, []
    for (before, how), code, (role, text) in zip(replay(audit, NOTHING, codes), codes, rows, strict=True):
        repaired += [(NAMES[q], "") for q in before]
        state = before[-1] if before else state
        if how:
            state = how if how > 0 else code & 3
            repaired.append((NAMES[how] if how > 0 else role, text))
    repaired += [(line[:-1], "") for line in _closing_lines(state)]
    out = {"gaps": max(known) - min(known) + 1 - len(known) if known else 0, "blank": blank, "duplicate": faults.count(UNFIT) - blank, "truncated": faults.count(TRUNCATED), "illegal": _illegal(codes), "cost": cost, "audit": audit}
    return out | {"repaired_sha256": hashlib.sha256("\n".join(f"{role}:{text}" for role, text in repaired).encode()).hexdigest()}, repaired


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list, list]]:
    """(conv, turns, (role, text) rows) of the conversations of batches sorted by key; one at a time is held."""
    now, conv, turns, rows = None, None, [], []
    for batch in batches:
        for key, c, turn, role, text, present in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if key != now:
                if now is not None:
                    yield conv, turns, rows
                now, conv, turns, rows = key, c, [], []
            if present:
                turns.append(turn)
                rows.append((role, text))
    if now is not None:
        yield conv, turns, rows


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, present of the rows after the damage: crc32(conv_id:turn) % 20 drops (present: false), empties, strips, repeats or renames."""
    c = lambda name: F.col(f"`{name}`")
    said = lambda name: F.coalesce(c(name).cast("string"), F.lit(" "))
    rows = conversations.select(c(conv_col).alias("conv_id"), c(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), (F.crc32(F.encode(F.concat(said(conv_col), F.lit(":"), said(turn_col)), "UTF-8")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 0, F.array(F.lit(False))).when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("present"))


def _read(turns: DataFrame, present_col: str | None) -> DataFrame:
    """key (never null), conv_id, turn, role, text, present."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key")
    present = F.coalesce(F.col(present_col), F.lit(True)) if present_col else F.lit(True)
    return turns.select(key, "conv_id", "turn", said("role"), said("text"), present.alias("present"))


def _apart(rows: DataFrame, long: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the conversations of up to `long` rows, and those of the others if there are any."""
    heavy = jobs.materialize(rows.groupBy("key").agg(F.count_if("present").alias("n")).filter(F.col("n") > long).select("key"), "long-conversations")
    if heavy.isEmpty():
        return rows, None
    return rows.join(heavy, "key", "left_anti"), jobs.materialize(rows.join(heavy, "key", "left_semi"), "long-rows")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")


def repair(turns: DataFrame, present_col: str | None = None, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """conv_id and DIGEST of every conversation of turns (conv_id, turn, role, text); rows whose present_col is false only name theirs."""
    rows = _read(turns, present_col)
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        found = ({"conv_id": c} | _digest(turns, said)[0] for c, turns, said in _conversations(batches))
        while out := list(itertools.islice(found, 1000)):
            yield out

    short, rest = _apart(rows, long)
    found = _sorted(short).mapInArrow(_typed(run, rows, DIGEST), f"{conv}, {DIGEST}")
    return found if rest is None else found.unionByName(_long_digest(*_long(rest, block)))


def _typed(run: Callable, rows: DataFrame, columns: str) -> Callable:
    """run, which yields lists of rows, as batches of the declared types."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType([rows.schema["conv_id"], *StructType.fromDDL(columns)]))

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in run(batches):
            yield pa.RecordBatch.from_pylist(rows, schema)

    return typed


def repaired_turns(turns: DataFrame, present_col: str | None = None, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """conv_id, seat, role, text of the repaired rows; seats ascend in a conversation, with gaps in a long one."""
    rows = _read(turns, present_col)
    columns = "seat long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        for c, turns, said in _conversations(batches):
            yield [{"conv_id": c, "seat": i, "role": role, "text": text} for i, (role, text) in enumerate(_digest(turns, said)[1])]

    short, rest = _apart(rows, long)
    found = _sorted(short).mapInArrow(_typed(run, rows, columns), f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {columns}")
    return found if rest is None else found.unionByName(_long(rest, block)[1].select("conv_id", "seat", "role", "text"))


# Conversations of any length: blocks of rows, wherever they lie.


def _blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal values in the first len(names) columns of sorted batches, the rest of the columns as rows."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if row[: len(names)] != now:
                if now is not None:
                    yield now, rows
                now, rows = row[: len(names)], []
            rows.append(row[len(names) :])
    if now is not None:
        yield now, rows


def _first_letter_class() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(0)


def _long(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(totals of each conversation, its repaired rows) of long conversations."""
    spark = rows.sparkSession
    of_ways, of_choice, of_edits = map(_arrow, (WAYS, CHOICE, EDITS))
    width = jobs.shuffle_width(spark, rows.count(), 100_000)
    placed = rows.filter("present").drop("present").repartitionByRange(width, "key", F.asc_nulls_first("turn"), "role").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")
    # A partition's ids are consecutive from a multiple of 2**33, so no block lies in two.
    placed = jobs.materialize(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.expr(f"at div {block}")), "placed")

    same = [F.col("key"), F.col("role"), F.md5("text").alias("said")]
    slim = placed.select(*same, "block", "at", "turn", F.expr(r"right(trim(BOTH ' \t\n\u000b\f\r' FROM text), 1)").alias("last"), _first_letter_class().alias("kind"))
    first = slim.groupBy("key", "role", "said").agg(F.min("at").alias("first"))
    fault = F.when((F.col("last") == "") | (F.col("at") > F.col("first")), UNFIT).when(F.col("last").isin(".", "!", "?"), GOOD).otherwise(TRUNCATED)
    slim = slim.join(first, ["key", "role", "said"]).select("key", "block", "at", "turn", (F.col("kind") + 4 * fault).alias("code"), (F.col("last") == "").alias("blank"))
    slim = jobs.materialize(slim, "codes")
    by_block = lambda df: df.repartition("key", "block").sortWithinPartitions("key", "block", "at")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, number), rows in _blocks(batches, ("key", "block")):
            codes = bytes(code for _, code in rows)
            costs, ranks = block_ways(codes)
            yield pa.RecordBatch.from_pylist([{"key": key, "block": number, "costs": costs, "ranks": ranks, "first": codes[0] & 3, "last": codes[-1] & 3, "illegal": _illegal(codes)}], of_ways)

    tables = by_block(slim.select("key", "block", "at", "code")).mapInArrow(ways, WAYS)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,), blocks in _blocks(batches, ("key",)):
            cost, states, closing = choose([(costs, ranks) for _, costs, ranks, *_ in blocks])
            illegal = sum(b[-1] for b in blocks) + sum((a[-2], b[-3]) not in LEGAL for a, b in zip(blocks, blocks[1:]))
            yield pa.RecordBatch.from_pylist([{"key": key, "block": b[0], "entry": states[i], "leave": states[i + 1], "cost": cost, "illegal": illegal, "closing": closing if i + 1 == len(blocks) else None} for i, b in enumerate(blocks)], of_choice)

    choice = jobs.materialize(tables.repartition("key").sortWithinPartitions("key", "block").mapInArrow(chosen, CHOICE), "choice")

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, number, entry, leave, closing), rows in _blocks(batches, ("key", "block", "entry", "leave", "closing")):
            codes = bytes(code for _, code in rows)
            _, done = _way(codes, entry, leave)
            out = [{"key": key, "block": number, "at": at, "before": before, "how": how, "edits": done if i == 0 else None} for i, ((at, _), (before, how)) in enumerate(zip(rows, replay(done, entry, codes), strict=True))]
            if closing:
                state, more = leave, []
                for _ in closing:
                    state = FOLLOWS[state]
                    more.append(state)
                out.append({"key": key, "block": number, "at": None, "before": more, "how": 0, "edits": closing})
            yield pa.RecordBatch.from_pylist(out, of_edits)

    own = slim.join(choice.select("key", "block", "entry", "leave", F.coalesce("closing", F.lit("")).alias("closing")), ["key", "block"])
    own = own.select("key", "block", "entry", "leave", "closing", "at", "code").repartition("key", "block").sortWithinPartitions("key", "block", "at")
    made = jobs.materialize(own.mapInArrow(edits, EDITS), "edits")

    where = F.coalesce("at", F.lit((1 << 59) - 1))
    texts = made.filter("how <> 0 OR size(before) > 0").join(placed.select("at", "role", "text"), "at", "left")
    names = F.array(*map(F.lit, NAMES))
    put_in = F.transform("before", lambda q, i: F.struct((where * 16 + i.cast("long")).alias("seat"), names[q].alias("role"), F.lit("").alias("text")))
    stays = F.when(F.col("how") != 0, F.array(F.struct((where * 16 + 15).alias("seat"), F.when(F.col("how") > 0, names[F.col("how")]).otherwise(F.col("role")).alias("role"), F.col("text").alias("text"))))
    lines = texts.select("key", F.explode(F.concat(put_in, F.coalesce(stays, F.array().cast("array<struct<seat:bigint,role:string,text:string>>")))).alias("line")).select("key", "line.*")
    convs = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    counts = slim.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"), F.count_if("blank").alias("blank"),
        F.count_if((F.expr("code div 4") == UNFIT) & ~F.col("blank")).alias("duplicate"), F.count_if(F.expr("code div 4") == TRUNCATED).alias("truncated"),
    )
    pieces = made.filter("edits IS NOT NULL").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(where.alias("at"), "edits"))), lambda x: x["edits"]), "").alias("audit"))
    totals = choice.groupBy("key").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"))
    return convs.join(counts, "key").join(totals, "key").join(pieces, "key"), lines.join(convs, "key")


WAYS = "key string, block long, costs array<long>, ranks array<long>, first long, last long, illegal long"
CHOICE = "key string, block long, entry long, leave long, cost long, illegal long, closing string"
EDITS = "key string, block long, at long, before array<long>, how long, edits string"


def _arrow(columns: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(columns))


def _long_digest(totals: DataFrame, lines: DataFrame) -> DataFrame:
    """DIGEST of long conversations; a conversation's lines pass one task as a stream, as SHA-256 can't be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([{"key": now, "repaired_sha256": state.hexdigest()}])
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"key": now, "repaired_sha256": state.hexdigest()}])

    said = lines.select("key", F.concat("role", F.lit(":"), "text").alias("line"), "seat").repartition("key").sortWithinPartitions("key", "seat")
    hashes = said.mapInArrow(run, "key string, repaired_sha256 string")
    none = hashlib.sha256(b"").hexdigest()
    return totals.join(hashes, "key", "left").select("conv_id", *[F.coalesce(F.col(name), F.lit(none)).alias(name) if name == "repaired_sha256" else F.col(name).cast(kind).alias(name) for name, kind in (x.strip().split(" ") for x in DIGEST.split(","))])
