import tempfile

import pytest
import tiktoken

from splitlift.llm import token_counts as T
from splitlift.llm._vocab import default_vocabulary, splitting_pattern

from llm_fixtures import make  # noqa: F401

CHANGE = "op string, id long, source string, lang string, tokenizer string, n_tokens long"


@pytest.fixture()
def store(spark):
    return T.TokenRollup(spark, tempfile.mkdtemp(prefix="rollup-"))


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_deltas_equal_a_recount_and_batches_are_idempotent(spark, store):
    def batch(*rows):
        return spark.createDataFrame(list(rows), CHANGE)
    first = batch(("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", "en", "v1", 5), ("insert", 3, None, None, "v1", 7),
                  ("insert", 3, None, None, "v1", 7), ("insert", None, "b", "de", "v1", 4), ("insert", 4, "b", "de", "v1", None))
    assert store.commit("1", first) and not store.commit("1", first)
    assert totals(store) == {("a", "en", "v1"): (2, 15), (None, None, "v1"): (2, 14), ("b", "de", "v1"): (2, 4)}
    second = batch(("delete", 1, None, None, None, None), ("delete", 99, None, None, None, None),
                   ("revise", 2, "a", "en", "v2", 6), ("delete", None, None, None, None, None))
    assert store.commit("2", second) and not store.commit("2", second)
    assert totals(store) == {("a", "en", "v2"): (1, 6), (None, None, "v1"): (2, 14), ("b", "de", "v1"): (2, 4)}
    assert store.commit("3", batch(("delete", 3, None, None, None, None), ("revise", 2, "a", "fr", "v2", 8)))
    assert totals(store) == {("a", "fr", "v2"): (1, 8), ("b", "de", "v1"): (2, 4)}
    assert store.commit("4", batch()) and store.batches() == ["1", "2", "3", "4"]
    assert totals(store) == {("a", "fr", "v2"): (1, 8), ("b", "de", "v1"): (2, 4)}


def test_half_written_batch_is_written_over(spark, store):
    rows = spark.createDataFrame([("insert", 1, "a", "en", "v1", 3)], CHANGE)
    rows.drop("op").selectExpr("id", "source", "lang", "tokenizer", "1L n_docs", "999L n_tokens").write.parquet(
        f"{store.path}/ledger/b")  # the rollup was never written
    assert store.batches() == [] and totals(store) == {}
    assert store.commit("b", rows) and totals(store) == {("a", "en", "v1"): (1, 3)}
    with pytest.raises(ValueError):
        store.commit("../x", rows)


def test_counts_equal_the_library(make):
    path = default_vocabulary("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("t", pat_str=splitting_pattern(), mergeable_ranks=T.read_ranks(path), special_tokens={})
    rows = [(1, "Hello world's 123  \n"), (2, None), (3, ""), (None, "é中😀"), (4, "x" * 100_000), (1, "again")]
    got = T.count_tokens(make(rows), path, splitting_pattern(), ["doc_id", "lang"]).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(
        ((i, len(e.encode_ordinary(t or ""))) for i, t in rows), key=str)


def test_empty_table(make, spark):
    paths = [default_vocabulary(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.corpus_rollup(make([]), labels, *paths, splitting_pattern()).collect() == []


def test_recount_leaves_other_rows_of_the_id(spark):
    paths = [default_vocabulary(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]
    one, two = (tiktoken.Encoding(n, pat_str=splitting_pattern(), mergeable_ranks=T.read_ranks(n), special_tokens={})
                for n in paths)
    rows = [(1, "in English", "en"), (1, "en français", "fr"), (2, "no language", None), (3, "gone", "de"), (4, "x y", "en")]
    docs = spark.createDataFrame([(i, t, k, "s") for i, t, k in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(3, 1)], "doc_id long, toxic int")
    got = {(r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in T.corpus_rollup(
        docs, labels, *paths, splitting_pattern()).collect()}
    count = lambda e, *texts: sum(len(e.encode_ordinary(t)) for t in texts)
    assert got == {("en", "byte_bpe_50k"): (2, count(one, "in English", "x y")),
                   ("fr", "byte_bpe_multi_50k"): (1, count(two, "en français")),
                   (None, "byte_bpe_multi_50k"): (1, count(two, "no language"))}
