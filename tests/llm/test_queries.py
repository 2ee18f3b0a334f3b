"""The registered queries against their SQL, and the pipeline against its parts done plainly."""
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from splitlift.llm import quality
from splitlift.llm.catalog import QUERIES
from splitlift.llm.oracle import ORACLE_SQL

from llm_fixtures import make  # noqa: F401

from test_ngram_jaccard import brute as brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_catalog_has_all():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    cols = sorted(d[0] for d in cur.description)
    assert sorted(df.columns) == cols
    order = [[d[0] for d in cur.description].index(c) for c in cols]
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(
        tuple(r[i] for i in order) for r in cur.fetchall())


def plain_contaminated(text, items):
    import re
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    have = words(text)
    grams = {tuple(have[i:i + 5]) for i in range(len(have) - 4)}
    for item in items:
        w = words(item)
        hit = set()
        for i in range(len(w) - 4):
            if tuple(w[i:i + 5]) in grams:
                hit |= set(range(i, i + 5))
        if w and len(hit) >= 0.5 * len(w):
            return True
    return False


def test_pipeline_against_a_plain_version(spark):
    from tokenizers import Tokenizer
    import hashlib
    from splitlift.llm._vocab import default_vocabulary
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    bad = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 0").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad]
    last = {}
    for i, t in rows:
        last[t or ""] = max(last.get(t or "", i), i)
    rows = [(i, t) for i, t in rows if last[t or ""] == i]
    stay = {i for i, _, c in brute_components(rows) if i == c}
    items = [r.text for r in bench.collect()]
    rows = [(i, t) for i, t in rows if i in stay and not plain_contaminated(t or "", items)]
    tk = Tokenizer.from_file(default_vocabulary())
    want = set()
    for i, t in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256((t or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_stages_leave_other_columns_as_they_are(spark, make):
    rows = [(i, f"some plain text number {i} that is long enough to have shingles of its own {i * 7}") for i in range(6)]
    table = make(rows + [(9, rows[0][1])])
    others = [c for c in table.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert len(others) > 20
    for stage in (corpus_pipeline.exact_dedup_stage, corpus_pipeline.near_dedup_stage,
                  corpus_pipeline.decontamination_stage):
        out = stage(spark, table, SF)
        assert out.columns == table.columns
        got = out.collect()
        assert got and all(r[c] == "x" for r in got for c in others)


def test_stages_keep_columns_and_handle_nulls_and_empty_tables(spark, make):
    rows = [(1, "some text"), (1, "some text"), (None, None), (2, ""), (3, None)]
    for table in (make(rows, extra=False), make([], extra=False)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
