"""Main-text extraction: markup says what is no article, host suffix arrays find unmarked boilerplate.

Pages are partitioned and sorted by (host, salt), so that a task meets a host's pages
one after the other. The token streams of a host's pages are concatenated and their
suffixes sorted by prefix doubling up to RUN tokens; a run of that length that stands on
several distinct pages of the host is boilerplate. Its tokens are removed and the
unique runs between them stay.

Only the few hosts that hold more than a shard and than a fair part of a task's bytes
(fewer than four for each task) have salts, so a host with a third of all pages is spread
over many tasks. Their runs are counted over the whole host first: shards, which may be
any pages of the host, give the 64-bit hashes of their runs with up to MIN_PAGES distinct
pages each, those are united by ranges of hashes, and the runs on MIN_PAGES pages go to
every salt of their host. What is repeated thus depends on the host's pages alone.

Runs are counted over every page, in all visible blocks but those that markup names as
the article itself (article, role=article). Such an article is kept whole and is no evidence
against other pages either, as copies of an article, or of a passage of it, are still articles;
the repeated runs are removed from the blocks of every page without one, also from
those of main and of content containers. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments go by tag, role, class or id.

Null and empty pages give an empty text. Each row is its own page in every count but
that of distinct pages, where rows of equal html are one page: repeated rows don't
make boilerplate of each other. A null or odd url belongs to the host ''. A null id is
kept. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import jobs
from tidemark.llm import textkernel as K

RUN, MIN_PAGES = 8, 3
SHARD_BYTES, PART_BYTES, ROW_BYTES = 4 << 20, 4 << 20, 256
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|math|object|canvas|title)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)|[^>]*+)>|<[!?/][^>]*+>""", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
_SPACED = frozenset("br td th wbr".split())
_DROPPED = frozenset("nav aside footer form button dialog menu head label fieldset".split())
_NOT_CONTENT = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar "
    "comment comments disqus replies reply responses respond notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login search share sharing social "
    "related recommended pagination pager widget form".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_CONTENT = frozenset("article content post entry story main".split())
_KEEP = frozenset(("html", "body", "article", "main"))
_CLOSES_P = _BLOCK - {"option", "optgroup"}


class _Page:
    """The visible blocks of a page: text and the number of article, main and content containers around it."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, str]] = []
        self.stack: list[tuple[str, bool, str]] = []
        self.text: list[str] = []
        at = 0
        for m in _TAG.finditer(html):
            if m.start() > at:
                self._say(html[at : m.start()])
            at = m.end()
            if m[3]:
                self._tag(m[3].lower(), bool(m[2]), m[4])
        self._say(html[at:])
        self._end()

    def _say(self, text: str) -> None:
        if not (self.stack and self.stack[-1][1]):
            self.text.append(text)

    def _end(self) -> None:
        """A block ends: white space becomes single spaces."""
        if self.text:
            if said := " ".join(unescape("".join(self.text)).split()):
                self.blocks.append((said, self.stack[-1][2] if self.stack else ""))
            self.text = []

    def _tag(self, name: str, closing: bool, rest: str) -> None:
        if name in _BLOCK:
            self._end()
        elif name in _SPACED:
            self.text.append(" ")
        if name in _VOID:
            return
        if closing:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == name:
                    del self.stack[k:]
                    return
                if name not in _BLOCK and self.stack[k][0] in _BLOCK:
                    return
            return
        if name in _CLOSES_P or name == "li":
            ends = ("p", "li") if name == "li" else ("p",)
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in ends:
                    del self.stack[k:]
                    break
                if self.stack[k][0] in _BLOCK:
                    break
        gone, inside = self.stack[-1][1:] if self.stack else (False, "")
        if not gone:
            gone, inside = self._judge(name, rest, inside)
        if not rest.endswith("/") or name in _BLOCK:
            self.stack.append((name, gone, inside))

    @staticmethod
    def _judge(name: str, rest: str, inside: str) -> tuple[bool, str]:
        values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(rest)} if "=" in rest or "hidden" in rest.lower() else {}
        named = {*_TOKEN.findall(f"{values.get('class', '')} {values.get('id', '')}")}
        if name in _DROPPED or (name == "header" and not inside) or name not in _KEEP and (named & _NOT_CONTENT or ("header" in named and not inside)):
            return True, inside
        if name not in _KEEP and values.get("role") in _ROLES or "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
            return True, inside
        if name == "article" and named & _NOT_CONTENT:
            return True, inside
        mark = "a" if name == "article" or values.get("role") == "article" else "m" if name == "main" or values.get("role") == "main" else "c" if named & _CONTENT else ""
        return False, inside + mark


def _chosen(page: _Page) -> tuple[list[int], bool]:
    """Numbers of the blocks of the named article, else container, else all that markup leaves, and whether an article was named."""
    for mark in "amc":
        if found := [i for i, (_, inside) in enumerate(page.blocks) if mark in inside]:
            return found, mark == "a"
    return [*range(len(page.blocks))], False


def _stream(page: _Page) -> list[str]:
    """The tokens of the visible blocks outside a named article."""
    return [token for text, inside in page.blocks if "a" not in inside for token in text.split(" ")]


def _text(page: _Page, gone: np.ndarray) -> str:
    """A page's main text, given which tokens of its stream are repeated."""
    chosen, whole = _chosen(page)
    if whole:
        return "\n".join(page.blocks[i][0] for i in chosen)
    words = [text.split(" ") for text, _ in page.blocks]
    ends = np.cumsum([len(w) for w in words])
    kept = (" ".join(w for w, g in zip(words[i], gone[ends[i] - len(words[i]) : ends[i]], strict=True) if not g) for i in chosen)
    return "\n".join(x for x in kept if x)


def _flat(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The concatenated streams as token numbers, each token's page, and the tokens by number."""
    codes: dict[str, int] = {}
    flat = np.array([codes.setdefault(t, len(codes)) for s in streams for t in s], np.int64)
    return flat, np.repeat(np.arange(len(streams)), [len(s) for s in streams]), [*codes]


def _runs(flat: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a whole run starts inside one page, and its suffix's rank.

    The suffixes are ranked by prefix doubling; equal ranks at depth `run` are neighbours
    in the suffix array with a common prefix of that length.
    """
    if len(flat) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, depth = flat, 1
    while depth < run:
        step = min(depth, run - depth)
        after = np.r_[rank[step:], np.full(step, -1)]
        rank, depth = np.unique(rank * (rank.max() + 2) + after + 1, return_inverse=True)[1], depth + step
    at = np.arange(len(flat) - run + 1)
    at = at[page[at] == page[at + run - 1]]
    return at, rank[at]


def _covered(first: np.ndarray, streams: list[list[str]], run: int) -> list[np.ndarray]:
    """For each page's tokens, which lie in a run that starts at one of the places `first`."""
    sizes = np.array([len(s) for s in streams])
    hit = np.zeros(int(sizes.sum()) + 1, np.int64)
    hit[first] += 1
    np.subtract.at(hit, first + run, 1)
    return np.split(np.cumsum(hit[:-1]) > 0, np.cumsum(sizes)[:-1]) if len(sizes) else []


def repeated_tokens(streams: list[list[str]], run: int = RUN, min_pages: int = MIN_PAGES) -> list[np.ndarray]:
    """For each page's tokens, which lie in a run that stands on min_pages distinct pages."""
    flat, page, _ = _flat(streams)
    at, same = _runs(flat, page, run)
    order = np.lexsort((page[at], same))
    s, p = same[order], page[at][order]
    count = np.bincount(s[np.r_[True, (s[1:] != s[:-1]) | (p[1:] != p[:-1])]]) if len(s) else np.zeros(0, np.int64)
    return _covered(at[count[same] >= min_pages], streams, run)


def _hashes(flat: np.ndarray, tokens: list[str], at: np.ndarray, host: str, run: int) -> np.ndarray:
    """64-bit hashes of a host's runs at the places `at`."""
    known = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)
    out = np.full(len(at), xxhash.xxh3_64_intdigest(host), np.uint64)
    for k in range(run):
        out = K.mix(out * np.uint64(0x9E3779B97F4A7C15) + known[flat[at + k]])
    return out


def _least(keys: np.ndarray, pages: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order, at most `most` pages of a key."""
    order = np.lexsort((pages, keys))
    keys, pages = keys[order], pages[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (pages[1:] != pages[:-1])][: len(keys)]
    keys, pages = keys[new], pages[new]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    place = np.arange(len(keys)) - np.repeat(head, np.diff(np.r_[head, len(keys)]))
    return keys[place < most], pages[place < most]


def _host_runs(host: str, pages: list[str], run: int = RUN, min_pages: int = MIN_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """(hash, page) of the runs of some pages of a host; min_pages pages of a run are enough for any count."""
    distinct = [*dict.fromkeys(pages)]
    flat, page, tokens = _flat([_stream(_Page(html)) for html in distinct])
    at, same = _runs(flat, page, run)
    names = np.array([xxhash.xxh3_64_intdigest(html) for html in distinct], np.uint64)
    first = np.zeros(int(same.max()) + 1 if len(same) else 0, np.int64)
    first[same] = at
    ranks, of = _least(same, names[page[at]], min_pages)
    return _hashes(flat, tokens, first[ranks], host, run), of


def _emitted(buckets: int, shard_bytes: int):
    """(host, html) to (host, bucket, pairs): a shard's runs, packed by ranges of their hashes."""

    def pack(held: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
        for host, pages in held.items():
            keys, of = _host_runs(host, pages)
            bucket = (keys >> np.uint64(32)).astype(np.int64) * buckets >> 32
            order = np.argsort(bucket, kind="stable")
            pairs, numbers = np.stack([keys, of], 1)[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]][: len(numbers)])
            blobs = [x.tobytes() for x in np.split(pairs, cuts[1:])] if len(cuts) else []
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(blobs), pa.string()), pa.array(numbers[cuts], pa.int64()), pa.array(blobs, pa.binary())], ["host", "bucket", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size = 0
        for batch in batches:
            for host, html in zip(batch.column(0), batch.column(1), strict=True):
                text = html.as_py()
                held.setdefault(host.as_py(), []).append(text)
                size += len(text) + ROW_BYTES
                if size >= shard_bytes:
                    yield from pack(held)
                    held, size = {}, 0
        yield from pack(held)

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, bucket, pairs) of whole buckets to (host, runs): the hashes that stand on MIN_PAGES pages."""
    held: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        for host, pairs in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            held.setdefault(host, []).append(np.frombuffer(pairs.as_buffer(), np.uint64).reshape(-1, 2))
    for host, found in held.items():
        pairs = np.concatenate(found)
        keys, counts = np.unique(_least(pairs[:, 0], pairs[:, 1], MIN_PAGES)[0], return_counts=True)
        if len(keys := keys[counts >= MIN_PAGES]):
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([keys.tobytes()], pa.binary())], ["host", "runs"])


def _shard(pages: list[str], host: str, known: np.ndarray | None) -> list[str]:
    """The main texts of all pages of a host, or of some pages of one whose repeated runs are known (hashes in order)."""
    distinct = {html: i for i, html in enumerate(dict.fromkeys(pages))}
    parsed = [_Page(html) for html in distinct]
    streams = [_stream(page) for page in parsed]
    if known is None:
        covered = repeated_tokens(streams)
    else:
        flat, page, tokens = _flat(streams)
        at = np.arange(max(len(flat) - RUN + 1, 0))
        at = at[page[at] == page[at + RUN - 1]]
        covered = _covered(at[np.isin(_hashes(flat, tokens, at, host, RUN), known)], streams, RUN)
    texts = [_text(page, gone) for page, gone in zip(parsed, covered, strict=True)]
    return [texts[distinct[html]] for html in pages]


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per page: id, url, text and n_chars (code points)."""
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-jobs.table_bytes(rows) // PART_BYTES))
    hosts = jobs.materialize(rows.groupBy("host").agg(F.sum(F.octet_length("html") + F.lit(ROW_BYTES).cast("long")).alias("bytes")), "hosts")
    total = hosts.agg(F.sum("bytes")).first()[0] or 0
    # fewer than 4 * width hosts can be so large, so this side is small enough for any broadcast
    heavy = hosts.filter(F.col("bytes") > max(shard_bytes, total // (4 * width))).select("host", F.ceil(F.col("bytes") / shard_bytes).alias("salts"))
    runs = rows.join(F.broadcast(heavy), "host", "left_semi").select("host", "html").mapInArrow(_emitted(width, 4 * shard_bytes), "host string, bucket bigint, pairs binary")
    runs = runs.repartition(width, "bucket").mapInArrow(_frequent, "host string, runs binary")
    none = lambda column: F.lit(None).cast(rows.schema[column].dataType).alias(column)
    runs = runs.join(F.broadcast(heavy), "host").select(none("id"), none("url"), none("html"), "host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "runs")
    salt = F.coalesce(F.pmod(F.xxhash64("id", "url"), F.col("salts")), F.lit(-1).cast("long"))  # -1: a host that is whole
    rows = rows.join(F.broadcast(heavy), "host", "left").select("id", "url", "html", "host", salt.alias("salt"), F.lit(None).cast("binary").alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        html: list[str] = []
        runs: list[np.ndarray] = []
        at, size = None, 0

        def done() -> pa.RecordBatch:
            texts = _shard(html, at[0], None if at[1] < 0 else np.concatenate([np.zeros(0, np.uint64), *runs]))
            keys = pa.Table.from_batches(held).combine_chunks()
            return pa.RecordBatch.from_arrays([*(keys[c].combine_chunks() for c in ("id", "url")), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])

        for batch in batches:
            groups, texts, found = [*zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)], batch.column(2), batch.column(5)
            for i, group in enumerate(groups):
                if held and (group != at or at[1] >= 0 and size >= shard_bytes):
                    yield done()
                    held, html, size = [], [], 0
                if group != at:
                    at, runs = group, []
                if found[i].is_valid:
                    runs.append(np.frombuffer(found[i].as_py(), np.uint64))
                    continue
                held.append(batch.slice(i, 1).select(["id", "url"]))
                html.append(texts[i].as_py())
                size += len(html[-1]) + ROW_BYTES
        if held:
            yield done()

    # a salt's runs come before its pages
    ordered = runs.unionByName(rows).repartition(width, "host", "salt").sortWithinPartitions("host", "salt", F.col("runs").isNull())
    out = ordered.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
