"""The registered queries: against DuckDB where SQL expresses them, else run over the smallest tables; and the pipeline."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")

ALL = ["op1_token_files", "op2_language_id", "op3_packing", "op4_substring_dedup", "op5_neighbours", "op6_quality", "op7_html_text", "op8_simhash", "op9_pieces", "op10_exact_dedup", "op11_token_counts", "op12_spelling", "op13_prefix_trie"]


def test_names():
    from corpusloom.llm.queries import ORACLE, QUERIES

    assert list(QUERIES) == ALL and set(ORACLE) <= set(ALL)


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op10_exact_dedup", "op12_spelling", "op13_prefix_trie"])
def test_against_sql(spark, sf, name):
    from corpusloom.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_pieces_query(spark, sf):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    from corpusloom.llm.queries import op9_pieces

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op9_pieces(spark, sf).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pages_query(spark, sf):
    """The test pages have one article each, and nothing else of theirs is text."""
    from html import unescape

    from corpusloom.llm.queries import op7_html_text

    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op7_html_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", html[r.page_id], re.S)[1]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))
        assert r.text == " ".join(unescape(plain).split())


def test_pipeline(spark, sf):
    import corpus_pipeline
    from corpusloom.llm.queries import tokenizer_path

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0.5 * sizes[0]
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, sf)
    count = lambda df: Counter({r.doc_id: r.n for r in df.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()})
    assert count(whole) == count(pieces) and tokenizer_path("word_bpe_49k.json")
