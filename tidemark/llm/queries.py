"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, html, jobs, langid, lines, neardup, oracles, packing, quality, repair, secrets, sharding, substrings, tokenfiles, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public tokenizer's file; it is on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents; a null text has none."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    strong = F.filter("spans", lambda s: s["strong"])
    count = lambda kind: F.size(F.filter(strong, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]], F.sha2(written(strong), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size(F.array_distinct(F.filter(F.col("spans")["link"], F.isnotnull))).cast("long").alias("n_credentials"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in at least 5 documents stay in the largest doc_id alone."""
    return lines.keep_bitmaps(_table(spark, sf_dir, "documents")).drop("keep_bitmap")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside 13-word windows that a smaller doc_id holds as well are removed."""
    return substrings.drop_repeated_windows(_table(spark, sf_dir, "documents"), with_text=False).drop("removed")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens."""
    return packing.pack_sequences(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, equal texts included."""
    return neardup.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32(doc_id) mod 3 isn't 1."""
    docs = _table(spark, sf_dir, "documents")
    held_out = lambda doc_id: F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html.main_texts(_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside windows of 10 benchmark words, and the words of the longest verbatim match."""
    hits = decontam.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    covered = F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("hit_from") > 0).alias("contaminated"), F.coalesce(F.array_max(F.col("matches")["n_words"]), F.lit(0)).cast("long").alias("longest_match"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents in id order and read the files back."""
    path = jobs.scratch_path(spark, "token-files")
    tokenfiles.write_token_files(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return tokenfiles.read_token_files(spark, path)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition coverage of every whole text of documents."""
    found = quality.repetition_quality(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after the stated damage."""
    return repair.repair(repair.damaged(_table(spark, sf_dir, "conversations")), "present")


def op12_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts that hold the mixture of sources."""
    rows = sharding.interleave(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return trie.trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_secret_scan, op2_line_dedup, op3_substring_dedup, op4_packing, op5_near_duplicates, op6_language_id, op7_html_text, op8_decontamination, op9_token_files, op10_quality_rules, op11_conversation_repair, op12_interleaved_shards, op13_prefix_trie)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
