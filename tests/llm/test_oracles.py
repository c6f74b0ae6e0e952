import pytest

from oracle import compare
from tideline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    n, differences = compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.01")
    assert n == 1000 and not differences


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_row_for_each_document(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


def test_token_digests(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, texts, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), documents(spark), 0
    for r in queries.op7_token_files(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect():
        ids = np.array([*whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_licence_digests(spark):
    from test_text_operators import brute_licences, brute_templates

    texts = documents(spark)
    for r in queries.op10_license_scan(spark, "/root/testdata/sf0.001").collect():
        base, templates = brute_licences(texts[r.doc_id]), brute_templates(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base
        assert r.labels == ",".join(sorted({*filter(None, base[4].split(",")), *templates})) and r.score == pytest.approx(1.0 if base[1] else max(templates.values(), default=0.0))
