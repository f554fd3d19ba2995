import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lanewright.llm import token_count

ODD = [
    "a<|endoftext|>b", "  two  spaces \n\n\nx", "it's we'll 'tis ''s don't I'VE", "日本語 テスト ①②", "tab\there\x1cx\x85y\xa0z", "½²³ªº ñ—“q”…", "x" * 5000, "", None, "é" * 300 + " ",
    "\r\n\r\n a  \t b   ", "123456 7.89,0", "​　wide", "👩‍👩‍👧 ok", "tail   ", "ᲀ ꟲ new letters",
]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        t = Tokenizer.from_file(path)
        return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda x: len(s.encode(x or "", num_threads=1))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(spark, edge, edge_rows, name):
    count = library(name)
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r.doc_id: r for r in token_count.token_counts(docs, public_tokenizers.path(name)).collect()}
    assert [got[k].n_tokens for k in range(len(ODD))] == [count(x) for x in ODD]
    assert [got[k].n_bytes for k in range(len(ODD))] == [len((x or "").encode()) for x in ODD]
    rows = sorted((r.doc_id or -1, r.n_tokens, r.over_limit) for r in token_count.token_counts(edge, public_tokenizers.path(name)).collect())
    assert rows == sorted((i or -1, count(t), count(t) > 1024) for i, t in edge_rows)


def test_documents(documents):
    count = library("byte_bpe_50k.json")
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(documents, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == {r.doc_id: count(r.text) for r in documents.collect()}


def test_cache_may_start_afresh(spark, monkeypatch):
    monkeypatch.setattr(token_count, "CACHE", 3)
    model = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
    table, count = token_count.Counts("json", model, {" the": 1}), library("byte_bpe_50k.json")
    for text in ("some quite ordinary words", "and the other words again", "some quite ordinary words"):
        assert table.count(text) == count(text)


def test_nothing(empty):
    assert token_count.token_counts(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
