"""Pixel search: crops find the photo that they were cut from, by block-mean hashes of previews.

Previews and hashes are numpy inside grouped pandas functions; Spark makes the groups
(one query with its nominated candidates), the ranking and the decision.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COARSE_SIDE, FINE_SIDE, COARSE_GRID, FINE_GRID = 128, 256, 16, 32
FINE_STEPS, FINE_SPAN, SCALES, OFFSETS = 5, 0.08, (1.0, 0.8), {1.0: 5, 0.8: 3}
LEAST_SIDE, TOP = 8, 5
SCORES = "query string, candidate string, day string, coarse int, fine int"


def _round(x: float) -> int:
    """Halves go up."""
    return int(np.floor(x + 0.5))


def preview(bgr: np.ndarray, side: int) -> np.ndarray:
    """Box means of the luminance, at most side pixels long."""
    height, width = bgr.shape[:2]
    scale = min(1.0, side / max(width, height))
    w, h = max(1, _round(width * scale)), max(1, _round(height * scale))
    luma = 0.114 * bgr[..., 0] + 0.587 * bgr[..., 1] + 0.299 * bgr[..., 2]
    sums = summed(luma)
    edges = lambda n, m: (np.arange(n) * m // n, np.maximum(np.arange(n) * m // n + 1, (np.arange(n) + 1) * m // n))
    (y0, y1), (x0, x1) = edges(h, height), edges(w, width)
    total = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    return np.floor(total / np.outer(y1 - y0, x1 - x0) + 0.5).astype(np.uint8)


def summed(gray: np.ndarray) -> np.ndarray:
    out = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    np.cumsum(np.cumsum(gray, 0), 1, out=out[1:, 1:])
    return out


def window_bits(sums: np.ndarray, rect: tuple[int, int, int, int], grid: int) -> np.ndarray:
    """Which of grid x grid block means of a window exceed their median."""
    x, y, w, h = rect
    at = lambda start, size: (start + np.arange(grid) * size // grid, start + np.maximum(np.arange(grid) * size // grid + 1, (np.arange(grid) + 1) * size // grid))
    (x0, x1), (y0, y1) = at(x, w), at(y, h)
    x1, y1 = np.minimum(x1, sums.shape[1] - 1), np.minimum(y1, sums.shape[0] - 1)
    x0, y0 = np.minimum(x0, x1 - 1), np.minimum(y0, y1 - 1)
    means = (sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]) / np.outer(y1 - y0, x1 - x0)
    return (means > np.median(means)).ravel()


def crop_windows(width: int, height: int, aspect: float) -> list[tuple[int, int, int, int]]:
    """Windows of the query's aspect at two scales, swept over the slack."""
    found = {}
    for scale in SCALES:
        w = min(width, height * aspect) * scale
        h = w / aspect
        if min(w, h) < LEAST_SIDE:
            continue
        steps = lambda slack, n=OFFSETS[scale]: [0.0] if slack < 1 else [slack * i / (n - 1) for i in range(n)]
        for y in steps(height - h):
            for x in steps(width - w):
                found[_round(x), _round(y), _round(w), _round(h)] = None
    return [*found]


def previews(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return preview(bgr, COARSE_SIDE), preview(bgr, FINE_SIDE)


def fine_score(bits: np.ndarray, rect: tuple[int, int, int, int] | None, small: np.ndarray, large: np.ndarray) -> int:
    """The least fine distance of windows swept about the coarse one by a share of the preview's sides; half a pixel may stand out."""
    score = FINE_GRID**2
    if rect is None:
        return score
    ratio, sums = large.shape[1] / small.shape[1], summed(large)
    x, y, w, h = (v * ratio for v in rect)
    sweep = np.linspace(-FINE_SPAN, FINE_SPAN, FINE_STEPS)
    for top in y + sweep * large.shape[0]:
        for left in x + sweep * large.shape[1]:
            if left >= 0 and top >= 0 and left + w <= large.shape[1] + 0.5 and top + h <= large.shape[0] + 0.5:
                score = min(score, int((window_bits(sums, (_round(left), _round(top), _round(w), _round(h)), FINE_GRID) != bits).sum()))
    return score


def search(query: tuple[np.ndarray, np.ndarray], aspect: float, candidates: list[tuple[np.ndarray, np.ndarray]], days: list[str]) -> list[tuple[int, int | None]]:
    """(coarse, fine) distances of a query's previews to those of each candidate.

    Fine distances are computed for the TOP coarse ones, and for the next one of another day if those are all of the
    winner's day, so that a win has something to be measured against; elsewhere fine is None.
    """
    full = lambda p: (0, 0, p.shape[1], p.shape[0])
    small, large = query
    bits, fine_bits = window_bits(summed(small), full(small), COARSE_GRID), window_bits(summed(large), full(large), FINE_GRID)
    best = []
    for p, _ in candidates:
        sums, scored = summed(p), [(COARSE_GRID**2, None)]
        scored += [(int((window_bits(sums, r, COARSE_GRID) != bits).sum()), r) for r in crop_windows(p.shape[1], p.shape[0], aspect)]
        best.append(min(scored, key=lambda s: s[0]))
    order = sorted(range(len(candidates)), key=lambda i: best[i][0])
    verify = lambda i: fine_score(fine_bits, best[i][1], *candidates[i])
    fine = {i: verify(i) for i in order[:TOP]}
    if fine:
        day = days[min(fine, key=lambda i: (fine[i], i))]
        if all(days[i] == day for i in fine):
            fine |= {i: verify(i) for i in [i for i in order[TOP:] if days[i] != day][:1]}
    return [(best[i][0], fine.get(i)) for i in range(len(candidates))]


def _scored(group: pd.DataFrame, query: tuple[np.ndarray, np.ndarray], aspect: float, made: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    found = search(query, aspect, made, group["day"].tolist())
    fine = pd.array([b for _, b in found], dtype="Int32")
    return pd.DataFrame({"query": group["query"].to_numpy(), "candidate": group["candidate"].to_numpy(), "day": group["day"].to_numpy(), "coarse": [a for a, _ in found], "fine": fine})


def score_pairs(pairs: DataFrame) -> DataFrame:
    """SCORES of nominated pairs: query, candidate, day, and both images as (data, width, height) in BGR.

    A group is one query with its candidates, of which nomination leaves a bounded number. fine is null where
    a candidate was not verified.
    """

    def score(group: pd.DataFrame) -> pd.DataFrame:
        image = lambda data, w, h: np.frombuffer(data, np.uint8).reshape(h, w, -1)[..., :3].astype(np.float64)
        group = group.sort_values("candidate")
        first = group.iloc[0]
        query = previews(image(first.query_data, first.query_width, first.query_height))
        return _scored(group, query, first.query_width / first.query_height, [previews(image(r.data, r.width, r.height)) for r in group.itertuples()])

    return pairs.groupBy("query").applyInPandas(score, SCORES)


PREVIEW = "small binary, small_width int, large binary, large_width int, aspect double"


def previewed(found: DataFrame, key: str = "path") -> DataFrame:
    """(key, PREVIEW) of decoded images: some tens of KB each, so that pixels themselves are never shuffled."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                small, large = previews(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)[..., :3])
                rows.append((getattr(r, key), small.tobytes(), small.shape[1], large.tobytes(), large.shape[1], r.width / r.height))
            yield pd.DataFrame(rows, columns=[key, "small", "small_width", "large", "large_width", "aspect"])

    return found.select(key, "width", "height", "data").mapInPandas(run, f"`{key}` string, {PREVIEW}")


def score_previews(pairs: DataFrame, made: DataFrame, least: int = 3) -> DataFrame:
    """SCORES of pairs (query, candidate, day) by the previews of previewed(); what has none can't compete, and less than `least` aren't compared."""
    columns = [c.split()[0] for c in PREVIEW.split(", ")]
    both = pairs.join(made.select(F.col("path").alias("candidate"), *columns), "candidate")
    both = both.join(made.select(F.col("path").alias("query"), *[F.col(c).alias(f"query_{c}") for c in columns]), "query")

    def score(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) < least:
            return pd.DataFrame({"query": [], "candidate": [], "day": [], "coarse": [], "fine": []})
        plane = lambda data, width: np.frombuffer(data, np.uint8).reshape(-1, width)
        group = group.sort_values("candidate")
        first = group.iloc[0]
        query = plane(first.query_small, first.query_small_width), plane(first.query_large, first.query_large_width)
        return _scored(group, query, first.query_aspect, [(plane(r.small, r.small_width), plane(r.large, r.large_width)) for r in group.itertuples()])

    return both.groupBy("query").applyInPandas(score, SCORES)


def images(spark, path: str) -> DataFrame:
    """Decoded images under path: origin, width, height, data (BGR); files that can't be decoded are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return rows.filter("image.nChannels >= 3").select(F.col("image.origin").alias("origin"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.data").alias("data"))


def below(origin: Column, root: str) -> Column:
    """The path below root of an image's origin, which is an escaped address."""
    top = re.sub(r"^[a-z]+:/+", "/", root).rstrip("/") + "/"
    path = F.url_decode(F.replace(F.regexp_replace(origin, "^[a-z]+:/+", "/"), F.lit("+"), F.lit("%2B")))
    return F.substring(path, len(top) + 1, 1 << 20)
