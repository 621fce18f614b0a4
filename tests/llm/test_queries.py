"""The registered corpus queries on the driver's smallest tables, and the pipeline against its parts."""

import os

import pytest

from tests.compare import SF, duck, spark_rows
from tidemark.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    columns, rows = duck(queries.oracle_sql()[name])
    assert spark_rows(queries.queries()[name](spark, SF).select(columns)) == (columns, rows)


OF_OTHER_TABLES = {"op7_html_text", "op11_conversation_repair", "op13_prefix_trie"}


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - OF_OTHER_TABLES))
def test_one_result_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.queries()[name](spark, SF)
    assert found.select("doc_id").distinct().count() == docs.count()


def test_base_columns_of_secrets(spark):
    """n_*, base_sha256 and the base part of spans against the patterns as they are stated."""
    import hashlib
    import re

    assign = re.compile("""(?P<n>[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\\x20*[:=]\\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.queries()["op1_secret_scan"](spark, SF).collect():
        text = docs[r.doc_id]
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m["v"]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        written = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in found) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")] == written


def test_page_texts(spark):
    """The registered query against a plain count of the runs of every host."""
    import re

    from tidemark.llm import html

    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    hosts = {}
    for r in rows:
        hosts.setdefault(re.sub(r"^\w+://([^/]*).*", r"\1", r.url).lower(), {}).setdefault(r.html, html._Page(r.html))
    want = {}
    for r in rows:
        pages = hosts[re.sub(r"^\w+://([^/]*).*", r"\1", r.url).lower()]
        blocks = pages[r.html].blocks
        if any("a" in inside for _, inside in blocks):
            want[r.page_id] = "\n".join(text for text, inside in blocks if "a" in inside)
            continue
        said = " ".join(text for text, _ in blocks).split()
        runs = [{tuple(w[i : i + html.RUN]) for i in range(len(w) - html.RUN + 1)} for w in (" ".join(t for t, inside in p.blocks if "a" not in inside).split() for p in pages.values())]
        gone = {i + d for i in range(len(said) - html.RUN + 1) if sum(tuple(said[i : i + html.RUN]) in x for x in runs) >= html.MIN_PAGES for d in range(html.RUN)}
        at, kept = 0, []
        chosen = next((m for m in "mc" if any(m in inside for _, inside in blocks)), "")
        for text, inside in blocks:
            words = text.split()
            if chosen in inside and (left := [w for i, w in enumerate(words, at) if i not in gone]):
                kept.append(" ".join(left))
            at += len(words)
        want[r.page_id] = "\n".join(kept)
    found = queries.queries()["op7_html_text"](spark, SF).collect()
    assert {r.page_id: r.text for r in found} == want and all(r.n_chars == len(r.text) for r in found)


def test_recall_of_near_duplicates(spark):
    """Links between different texts of the whole table, by brute force: at least 0.95 of them lie in one class."""
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import neardup
    from tidemark.llm import textkernel as K

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    data, offsets = K.text_bytes(pa.array([r.text for r in docs], pa.string()))
    starts, ends, bounds = K.word_spans(data, offsets, K.NOT_WHITE)
    words = (K.span_hashes(data, starts, ends) >> np.uint64(32)).astype(np.uint32)
    said = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    known = {r.doc_id: r.class_id for r in queries.queries()["op5_near_duplicates"](spark, SF).collect()}
    linked = [(i, j) for i in range(len(docs)) for j in range(i) if min(len(said[i]), len(said[j])) >= 5 and neardup.similar(said[i], said[j])]
    assert linked and sum(known[docs[i].doc_id] == known[docs[j].doc_id] for i, j in linked) >= 0.95 * len(linked)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.queries()["op6_language_id"](spark, SF).join(docs, "doc_id").filter("held_out")
    assert found.filter("lang_pred = lang").count() >= 0.97 * found.count()


def test_pipeline(spark):
    import corpus_pipeline
    from tidemark.llm import decontam, lines, neardup, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.repetition_quality(docs).filter("kept").collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in at.select("doc_id").collect()}
        new = spark.createDataFrame(stage(spark, at, SF).collect(), docs.schema)
        after = {r.doc_id for r in new.select("doc_id").collect()}
        assert new.columns == docs.columns
        if name == "quality_rules":
            assert after == good
        elif name == "line_dedup":
            assert after == before and {r.doc_id: r.kept_sha256 for r in lines.keep_bitmaps(at).collect()} == {r.doc_id: r.h for r in new.selectExpr("doc_id", "sha2(coalesce(text, ''), 256) AS h").collect()}
        elif name == "near_dedup":
            assert after == {r.class_id for r in neardup.near_duplicate_classes(at).collect()}
        else:
            hit = decontam.benchmark_hits(at, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert after == {r.doc_id for r in hit.filter("size(hit_from) = 0").collect()}
        at = new
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in at.select("doc_id").collect()}


def test_pipeline_stages_take_any_table(spark):
    """Null, empty and repeated texts and ids, an empty table, further columns of clashing and dotted names."""
    import corpus_pipeline

    said = lambda seed: " ".join(f"w{(seed * 7919 + i * i * 31 + i * 17) % 4001}" for i in range(80))
    rows = [(1, said(1)), (2, said(1)), (2, said(1)), (3, None), (4, ""), (None, said(5)), (None, None), (6, "same word " * 200), (7, said(7)), (9, said(9) + " " + said(1))]
    docs = spark.createDataFrame([(i, t, "en", "s", 5, "x", i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, node long")
    kept = {"quality_rules": {None, 1, 2, 7, 9}, "line_dedup": {None, 1, 2, 7, 9}, "near_dedup": {None, 1, 7, 9}, "decontamination": {None, 1, 7, 9}}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.filter("false"), SF).count() == 0
        at = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.doc_id for r in at.collect()} == kept[name]
    assert {r.doc_id for r in corpus_pipeline.packed(spark, at, SF).collect()} == kept["decontamination"]
