import hashlib
import random

import pytest
from pyspark.sql import functions as F

from splitlift.llm import substring_dedup as S

from llm_fixtures import make  # noqa: F401


def brute(rows, window=20):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] != (i, s):
                gone |= set(range(s, s + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(make, rows, **kw):
    got = S.removal_digest(S.remove_repeats(make(rows), **kw)).collect()
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "c", "dé", "E", "x1"])
    passage = [word() for _ in range(rnd.choice([19, 20, 25, 60]))]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(w))
            w[at:at] = passage[rnd.randint(0, 3):]
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(w)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, "same " * 200), (n + 3, None), (n + 4, "")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(make, seed):
    rows = corpus(seed)
    assert run(make, rows) == brute(rows)


def test_long_prefixes_give_the_same(make):
    rows = corpus(7)
    assert run(make, rows, budget=3) == brute(rows)


def test_small_batches_and_slices_give_the_same(make, spark, monkeypatch):
    rows = corpus(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run(make, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_text_null_ids_repeated_rows_and_empty(make):
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    got = {r.doc_id: r for r in S.remove_repeats(make([(1, long), (2, "w1 w2")])).collect()}
    assert (got[1].n_removed, got[1].n_words) == (25_000, 30_000)
    assert [tuple(s) for s in got[1].spans] == [(5000, 25_000)] and got[2].spans == []
    text = " ".join(map(str, range(30)))
    rows = S.remove_repeats(make([(3, text), (3, text), (None, text)])).select("doc_id", "n_removed").collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 30), (3, 0), (3, 0)]
    assert S.remove_repeats(make([])).agg(F.count("*")).first()[0] == 0


def test_rows_of_one_id_on_both_sides_of_a_batch_border(make, spark):
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    text = " ".join(passage)
    same_id = [(9, " ".join([f"w{rnd.random()}" for _ in range(rnd.randint(0, 30))] + passage[rnd.randint(0, 9):]))
               for _ in range(12)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert run(make, [(3, text)] * 5) == brute([(3, text)] * 5)
        assert run(make, same_id) == brute(same_id)
        null_ids = S.remove_repeats(make([(None, text + f" t{i}") for i in range(5)])).select("n_removed").collect()
        assert [r.n_removed for r in null_ids] == [0] * 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_copies_of_a_row_are_handled_once(make):
    text = " ".join(map(str, range(60)))
    rows = [(1, text)] + [(2, text)] * 30 + [(None, text)] * 30
    docs = S._documents(make(rows), "doc_id", "text")
    marks = S.repeated(S.anchor_rows(docs)).cache()
    assert all(len(r.marks) == len({m.pos for m in r.marks}) for r in marks.collect())
    windows = S.window_rows(S.pack_texts(docs, ["ord", "dk"]), marks)
    assert windows.groupBy("dk", "at").count().agg(F.max("count")).first()[0] == 1
    assert run(make, rows[:31]) == brute(rows[:31])
    got = S.remove_repeats(make(rows)).groupBy("doc_id", "n_removed").count().collect()
    assert {(r.doc_id, r.n_removed, r["count"]) for r in got} == {(1, 0, 1), (2, 60, 30), (None, 60, 30)}
