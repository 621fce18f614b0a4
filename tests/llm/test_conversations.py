"""Conversation repair and the prefix trie against plain Python: every length, block and queue size, nulls, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repair, trie

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
BLANK = re.compile(r"[^\x20\x09-\x0D]")
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}
FITS = ("s", "u", "su", "ua", "au")


def cheapest(rows):
    """(cost, audit, repaired) of (role, text, fault) rows, over all edits with at most three insertions in a row."""

    def inserted(found):
        for state, (cost, audit, out) in list(found.items()):
            for _ in range(3):
                state, cost, audit = FOLLOWS[state], cost + 3, audit + "I"
                out = [*out, f"{FULL[state]}:"]
                if state not in found or (cost, audit) < found[state][:2]:
                    found[state] = (cost, audit, out)
        return found

    found = {"": (0, "", [])}
    for role, text, fault in rows:
        new = {}

        def offer(state, cost, audit, out):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, out)

        # Every way to a state, not only the cheapest: the letters before decide ties, so all insertions are tried.
        for state, (cost, audit, out) in list(found.items()):
            for n in range(3):
                q, more = state, []
                for _ in range(n):
                    q = FOLLOWS[q]
                    more.append(f"{FULL[q]}:")
                at, said, lines = cost + 3 * n, audit + "I" * n, out + more
                offer(q, at + 4, said + "D", lines)
                if fault not in ("blank", "duplicate"):
                    late = 3 * (fault == "truncated")
                    if q + role[:1] in FITS and role[:1]:
                        offer(role[:1], at + late, said + "K", [*lines, f"{role}:{text}"])
                    offer(FOLLOWS[q], at + 3 + late, said + "R", [*lines, f"{FULL[FOLLOWS[q]]}:{text}"])
        found = new
    ends = inserted(dict(found))
    return min(ends[q] for q in ("", "a") if q in ends)


def model(rows):
    """The columns of one conversation from its (turn, role, text) rows."""
    seen, faulty, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for _, role, text in rows:
        last = BLANK.findall(text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated"
        seen.add((role, text))
        count[fault] += 1
        faulty.append((role, text, fault))
    turns = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(faulty)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(out)), out)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text, now = said(role), said(text), out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        now += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: ordered(found) for conv, found in out.items()}


def talk(seed, convs=60, turns=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(turns)):
            role = rng.choice(["user", "assistant", ["user", "assistant"][turn % 2], "system", "tool", "unknown", ""])
            rows.append((conv, rng.choice([turn, turn, 2 * turn, None]), rng.choice([role, role, None]), rng.choice(["Yes.", f"Well {rng.randrange(5)}!", "cut off", " \t\n", "é…", "", None, "So? \x0b"])))
    return [*rows, *rows[:7], (None, None, None, None), (None, 3, "user", "Who?"), (-5, 1, "user", "x" * 50_000 + ".")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([a + 4 * b for a in range(4) for b in range(3)]), max_size=9))
def test_auction_finds_the_least_audit(codes):
    rows = [({0: "tool", 1: "system", 2: "user", 3: "assistant"}[c & 3], "t", ("", "truncated", "blank")[c >> 2]) for c in codes]
    assert repair.solve(bytes(codes)) == cheapest(rows)[:2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([a + 4 * b for a in range(4) for b in range(3)]), min_size=1, max_size=14), st.integers(1, 5))
def test_blocks_find_the_same(codes, size):
    blocks = [bytes(codes[i : i + size]) for i in range(0, len(codes), size)]
    cost, states, closing = repair.choose([repair.block_ways(b) for b in blocks])
    audit = "".join(repair._way(b, states[i], states[i + 1])[1] for i, b in enumerate(blocks)) + closing
    assert (cost, audit) == repair.solve(bytes(codes))


def test_prices_never_exceed_the_way_on():
    codes = bytes(random.Random(4).choices(range(12), k=200))
    prices, last = repair._priced(codes, (c for c, _ in repair.CLOSING)), 800
    arcs = lambda node: repair.ARCS[codes[node >> 2]][node & 3]
    repair.auction(arcs, 0, last, prices)
    assert all(prices[v] <= cost + prices[v + far] for v in range(last) for _, cost, far in arcs(v))
    assert prices[0] == repair.solve(codes)[0]


def digest(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


@pytest.mark.parametrize(("long", "block"), [(1024, 512), (3, 2), (0, 512)])
def test_repair(spark, long, block):
    rows = talk(1)
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, present int, `a.b` string, key string").repartition(3)
    hurt = repair.damaged(df)
    found = {r.conv_id: digest(r) for r in repair.repair(hurt, "present", long, block).collect()}
    want = {conv: model(said) for conv, said in damage(rows).items()}
    assert found == {conv: w[:-1] for conv, w in want.items()}
    lines = {}
    for r in sorted(repair.repaired_turns(hurt, "present", long, block).collect(), key=lambda r: r.seat):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {conv: w[-1] for conv, w in want.items() if w[-1]}
    assert repair.repair(repair.damaged(df.filter("false")), "present", long, block).count() == 0


def test_one_conversation_of_many_turns(spark):
    """Most rows in one conversation, which lies in many blocks of several partitions."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "system"]), f"said {rng.randrange(900)}{rng.choice(['.', '.', ''])}") for t in range(3000)] + [(8, 0, "user", "Hm?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    found = {r.conv_id: digest(r) for r in repair.repair(df, block=64).collect()}
    assert found == {conv: model(ordered(r[1:] for r in rows if r[0] == conv))[:-1] for conv in (7, 8)}


def trie_model(rows):
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said.setdefault(conv, []).append((turn, role or "", text or ""))
    said = {c: [x[1:] for x in ordered(v)] for c, v in said.items()}
    members = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = said.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        whole = (*base[:h], *own[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, len(whole) == d))
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children.get(node, [])]
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        totals[node] = (sum(x for x, _ in below) or 1, saved + sum(y for _, y in below))
    least = {node: min(c for c, _ in m) for node, m in members.items()}
    return sorted((least[n], len(n), -1 if not n else least[n[:-1]], len(m), len(children.get(n, [])), *totals[n], sha(",".join(str(c) for c in sorted(c for c, end in m if end)))) for n, m in members.items())


@pytest.mark.parametrize(("block", "light", "queued"), [(1024, 20_000, 1 << 18), (2, 1, 1), (3, 4, 2)])
def test_trie(spark, block, light, queued):
    """Ties have equal roles and texts here, as their order is a hash's."""
    rng = random.Random(6)
    rows = []
    for conv in [*range(30), *range(100, 140), 200, 250, 305, -7, 10**12]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((conv, turn or None, rng.choice(["user", "user", None, ""]), rng.choice(["Hello", "Hello", "é!", None, f"{rng.randrange(3)}"])))
    rows += [(150, 0, "user", "same"), (150, 0, "user", "same"), (None, 1, "user", "nobody"), (151, 1, "user", "z" * 30_000)]
    rows += [(c, t, "user", "Hello") for c in (10_000, 10_001, 10_002) for t in range(9)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, d int, `a.b` string").repartition(3)
    found = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.trie(df, block, light, queued).collect())
    assert found == trie_model(rows)
    assert trie.trie(df.filter("false"), block, light, queued).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(0, 9), st.integers(0, 9)), max_size=40), st.integers(1, 4))
def test_spilling_queue(items, most):
    queue = trie.SpillingQueue(most)
    for item in items:
        queue.push(*item)
    for level, path in sorted({x[:2] for x in items}, key=lambda x: (-x[0], x[1])):
        assert queue.take(level, path) == (sum(x[2] for x in items if x[:2] == (level, path)), sum(x[3] for x in items if x[:2] == (level, path)))
