"""Secret scans: base patterns, and multipart credentials linked by an interval join within scopes.

Strong spans (assignments of 12+ characters, access identifiers, long hex) are
always reported. Weak parts are collected beside them: identifiers such as
`client_id=...`, short assigned secrets, mixed-class strings, endpoints. A weak
part is reported only when a complementary part lies in the same scope (a block
between blank lines), however long that is. A part is no complement of another
reading of its own value; only a secret inside a URL belongs to that URL. A bare hash
doesn't make a secret of the address beside it, as every page with a checksum has both;
it does complete an identifier. Both sides of that join are intervals of one text, so
it is made by bisection over sorted places inside the row: linear memory, no shuffle, no
group to skew.

`link` numbers the credentials of a text: identifiers, access identifiers and endpoints go to
the nearest secret of their scope (the earlier one of two as near), and all parts of
one credential carry that secret's start. A strong span alone in its scope has none.

One narrow map over the whole texts. A null text is empty and has no spans. Each
row is scanned alone: repeated rows, repeated or null ids change nothing; equal
starts are ordered by kind as listed. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkernel as K

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: What makes up a credential together with each kind.
COMPLEMENTS = {"identifier": ("assign", "hex", "secret"), "secret": ("access", "identifier", "endpoint"), "endpoint": ("assign", "secret")}
SPAN = "kind string, start long, end long, strong boolean, link long"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:client|account|user|tenant|app|access_?key|key)(?:[_-]?id|[_-]?name|name)?["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9._@-]{3,}""", re.ASCII | re.IGNORECASE)
_SHORT = re.compile(r"""(?<![A-Za-z0-9])(?:pass|pwd|password|passwd|(?:secret|private)(?:[_-]?access)?[_-]?key|secret|token|api_?key|auth|credential)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.ASCII | re.IGNORECASE)
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
_ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?<![A-Za-z0-9])(?:host|endpoint|server|base_url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:-]{3,})""", re.ASCII | re.IGNORECASE)
_SCOPE = re.compile(r"\n[\x20\t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all strong spans, in order."""
    found = []
    if ":" in text or "=" in text:
        found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _weak_parts(text: str) -> list[tuple[int, int, int]]:
    found = []
    if ":" in text or "=" in text:
        for kind, pattern in ((4, _SHORT), (3, _IDENTIFIER), (5, _ENDPOINT)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
        named = [(s, e) for s, k, e in found if k == 4]  # in order and apart; 'access_key=' inside 'secret_access_key=' is no identifier
        found = [(s, k, e) for s, k, e in found if k != 3 or not (n := bisect_left(named, (s,))) or named[n - 1][1] <= s]
    for m in _MIXED.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and s.upper() != s and s.lower() != s:
            found.append((m.start(), 4, m.end()))
    return sorted(set(found))


def _meeting(places: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """A test whether one of the places has a code point of start to end."""
    at = np.array(sorted(places), np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(at[:, 1]) if len(at) else at[:, 1]
    return lambda start, end: bool((n := np.searchsorted(at[:, 0], end)) and reach[n - 1] > start)


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The weak parts whose complements co-occur in their scope; those inside a strong span are left out."""
    weak = _weak_parts(text)
    if not weak or not (base or len({k for _, k, _ in weak}) > 1):
        return []
    taken = _meeting([(s, e) for s, _, e in base])
    free = [(s, k, e) for s, k, e in weak if not taken(s, e)]
    cuts = np.array([m.start() for m in _SCOPE.finditer(text)], np.int64)
    places = {k: [(s, e) for s, j, e in (*base, *free) if KINDS[j] == k] for k in KINDS}
    starts = {k: np.array(sorted(s for s, _ in p), np.int64) for k, p in places.items()}
    ends = {k: np.array(sorted(e for _, e in p), np.int64) for k, p in places.items()}
    is_url = lambda s, e: text.find("://", s, e) >= 0
    in_url, holds_secret = _meeting([p for p in places["endpoint"] if is_url(*p)]), _meeting(places["secret"])
    out = []
    for s, k, e in free:
        scope = np.searchsorted(cuts, s, "right")
        low = int(cuts[scope - 1]) if scope else 0
        high = int(cuts[scope]) if scope < len(cuts) else len(text)
        # interval join: some complement ends after low and by s, or starts from e on and before high
        near = any(np.searchsorted(ends[c], low, "right") < np.searchsorted(ends[c], s, "right") or np.searchsorted(starts[c], e) < np.searchsorted(starts[c], high) for c in COMPLEMENTS[KINDS[k]])
        if near or k == 4 and in_url(s, e) or k == 5 and is_url(s, e) and holds_secret(s, e):
            out.append((s, k, e))
    return out


def _nearest(starts: np.ndarray, scopes: np.ndarray, pool: np.ndarray, pool_scopes: np.ndarray) -> np.ndarray:
    """For each start, the number of the nearest member of the pool (in order) in its scope, or -1."""
    after = np.searchsorted(pool, starts)
    best, gap = np.full(len(starts), -1), np.full(len(starts), np.iinfo(np.int64).max)
    for at in (after - 1, after):
        there = np.clip(at, 0, len(pool) - 1)
        near = np.abs(pool[there] - starts)
        better = (at == there) & (pool_scopes[there] == scopes) & (near < gap)
        best, gap = np.where(better, there, best), np.where(better, near, gap)
    return best


def credential_links(text: str, spans: list[tuple[int, int, int]]) -> list[int | None]:
    """For each span (in order), the start of the secret that its credential is numbered by."""
    secret = np.array([KINDS[k] in ("assign", "hex", "secret") for _, k, _ in spans], bool)
    if not secret.any() or secret.all():
        return [None] * len(spans)
    start = np.array([s for s, _, _ in spans], np.int64)
    scope = np.searchsorted(np.array([m.start() for m in _SCOPE.finditer(text)], np.int64), start, "right")
    link = np.full(len(spans), -1, np.int64)
    mine, other = np.flatnonzero(secret), np.flatnonzero(~secret)
    to = _nearest(start[other], scope[other], start[mine], scope[mine])
    link[other] = np.where(to >= 0, start[mine][to], -1)
    link[mine[to[to >= 0]]] = start[mine[to[to >= 0]]]
    left = mine[link[mine] < 0]  # secrets that no part is nearest to belong to their own nearest part's credential
    to = _nearest(start[left], scope[left], start[other], scope[other])
    link[left] = np.where(to >= 0, link[other][to], -1)
    return [int(x) if x >= 0 else None for x in link]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and `spans`, ordered by start and kind: kind, start, end (code points), strong, link (of one credential)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strong", pa.bool_()), ("link", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "text"):
            out = []
            for text in piece.column(1).to_pylist():
                base = base_spans(text or "")
                both = sorted(base + (linked_spans(text, base) if text else []))
                out.append([{"kind": KINDS[k], "start": s, "end": e, "strong": k < 3, "link": n} for (s, k, e), n in zip(both, credential_links(text or "", both), strict=True)])
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out, kind)], ["id", "spans"])

    found = rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("spans", T.ArrayType(T.StructType.fromDDL(SPAN)))]))
    return found.withColumnRenamed("id", id_col)
