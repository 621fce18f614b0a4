"""Word-first backoff language identification, trained here from labelled documents.

Words are counted per language in Spark; the VOCABULARY most frequent ones and, for
each length in GRAMS, the most frequent character n-grams of the words (edges marked) make
up the model: log frequencies per language. A known word scores by its own frequencies.
An unseen word falls back to the longest n-grams of it that are known, and their
mean counts as the word's score. The language with the largest sum wins; `score` is its
posterior probability under equal priors.

The model is fitted on at most about DOCS_PER_LANGUAGE labelled documents of each
language, chosen by a hash of the id and used whole; its size is bounded by
VOCABULARY and the number of languages. Prediction covers whole texts.

Null texts and texts without letters are `und` with score 0. Rows without a language
or id don't train. Repeated rows each count. Ties go to the language that sorts first.
With no labelled rows every prediction is `und`. Extra columns are not read. An
empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import jobs
from tidemark.llm import textkernel as K

DOCS_PER_LANGUAGE, VOCABULARY, GRAMS = 10_000, 50_000, (5, 4, 3, 2, 1)
SMOOTHING, CACHED = 0.5, 300_000
_WORD = re.compile(r"[^\W\d_]+")
_BUCKETS = 1_000_000


def words_of(text: str | None) -> list[str]:
    """Lower-case words, empty if the text has no letter."""
    found = _WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word) counts of each piece."""
    for piece in K.pieces(batches, "text"):
        counts: dict[str, Counter] = {}
        for text, lang in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
        for lang, found in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, gram) counts of a batch of counted words."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for size in GRAMS:
                for gram in grams_of(word, size):
                    counts[lang, size, gram] += n
        if counts:
            lang, size, gram = zip(*counts, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(size, pa.int32()), pa.array(gram), pa.array(list(counts.values()), pa.int64())], ["lang", "size", "word", "n"])


class Model:
    """Log frequencies: level 0 has words, level n the n-grams; a bounded number of rows each."""

    def __init__(self, langs: list[str], levels: dict[int, list[tuple[str, dict[str, int]]]], totals: dict[int, dict[str, int]]):
        self.langs = langs
        self.index: dict[int, dict[str, int]] = {}
        self.logs: dict[int, np.ndarray] = {}
        column = {lang: j for j, lang in enumerate(langs)}
        for level, rows in levels.items():
            counts = np.full((len(rows), len(langs)), SMOOTHING)
            for i, (_, by) in enumerate(rows):
                for lang, n in by.items():
                    counts[i, column[lang]] += n
            sums = np.array([totals[level].get(lang, 0) + SMOOTHING * (len(rows) + 1) for lang in langs])
            self.index[level] = {word: i for i, (word, _) in enumerate(rows)}
            self.logs[level] = np.log(counts / sums)

    def unseen(self, word: str) -> np.ndarray:
        """The score of a word that isn't in the vocabulary."""
        for n in GRAMS:
            if n in self.index:
                known = self.index[n]
                if rows := [known[g] for g in grams_of(word, n) if g in known]:
                    return self.logs[n][rows].mean(0)
        return np.zeros(len(self.langs))

    def predict(self, texts: list[str | None], cache: dict) -> tuple[list[str], np.ndarray]:
        """Languages and scores; cache holds the rows of words met before in this task."""
        out, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return out, score
        said = [words_of(t) for t in texts]
        if "rows" not in cache or len(cache["row"]) > CACHED:
            cache |= {"row": {}, "rows": np.zeros((0, len(self.langs)))}
        row = cache["row"]
        if new := [*set().union(*said).difference(row)]:
            known, logs = self.index[0], self.logs[0]
            made = np.array([logs[known[w]] if w in known else self.unseen(w) for w in new])
            row.update(zip(new, range(len(row), len(row) + len(new)), strict=True))
            cache["rows"] = np.concatenate([cache["rows"], made])
        for i, words in enumerate(said):
            if words:
                sums = cache["rows"][[*map(row.__getitem__, words)]].sum(0)
                best = int(np.argmax(sums))
                out[i], score[i] = self.langs[best], 1 / np.exp(sums - sums[best]).sum()
        return out, score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, vocabulary: int = VOCABULARY) -> Model:
    """Fit a model on the labelled rows of docs (see the module's text for the bounds)."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(_BUCKETS)).alias("deal")).filter(F.col("lang").isNotNull() & F.col(id_col).isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("docs"))
    share = F.least(F.lit(1.0), F.lit(docs_per_language) / F.col("docs"))
    langs = {r["lang"]: r["share"] for r in sizes.select("lang", share.alias("share")).collect()}
    if not langs:
        return Model([], {}, {})
    limit = F.lit(0.0)
    for lang, part in langs.items():
        limit = F.when(F.col("lang") == lang, part).otherwise(limit)
    taken = rows.filter(F.col("deal") < limit * _BUCKETS).select("text", "lang")
    words = jobs.materialize(taken.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    grams = words.mapInArrow(_grams, "lang string, size int, word string, n long").groupBy("lang", "size", "word").agg(F.sum("n").alias("n"))
    counts = jobs.materialize(grams.unionByName(words.withColumn("size", F.lit(0))), "gram-counts")
    totals: dict[int, dict[str, int]] = {}
    for r in counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect():
        totals.setdefault(r["size"], {})[r["lang"]] = r["n"]
    levels = {}
    for level in (0, *GRAMS):
        top = counts.filter(F.col("size") == level).groupBy("word").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).orderBy(F.desc("total"), "word").limit(vocabulary)
        levels[level] = [(r["word"], r["by"]) for r in top.collect()]
    return Model(sorted(langs), levels, totals)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY rows for each of six levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for piece in K.pieces(batches, "text", 1 << 20):
            lang, score = shared.value.predict(piece.column(1).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return out.withColumnRenamed("id", id_col)
