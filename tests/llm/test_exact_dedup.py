import hashlib
from collections import defaultdict

from splitlift.llm import exact_dedup as E

from llm_fixtures import make  # noqa: F401

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 100_000), (5, "b" * 100_000), (None, "a"), (7, "A"),
        (None, "c"), (8, "d"), (8, "e")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def check(make, rows, **kw):
    got = E.exact_dedup(make(rows), **kw).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(n == 1 for n in kept.values())


def test_edge_cases(make):
    check(make, ROWS)


def test_heavy_digests_are_decided_map_side(make):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 400}") for i in range(1500)]
    check(make, rows, items=64, top=4)
    found = E.verified_winners(make(rows).selectExpr("doc_id as id", "sha2(text, 256) as digest", "doc_id as uid"), 64, 4)
    assert hashlib.sha256(b"hot").hexdigest() in {r.digest for r in found.collect()}
    assert found.count() <= 4


def test_drop_copies_keeps_columns_and_one_row_of_each(make):
    df = make(ROWS)
    out = E.drop_copies(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert [t or "" for _, t in got].count("a") == 1 and (2, "a") in got
    assert len(got) == len({t or "" for _, t in ROWS})
    assert (4, "") in got


def test_empty_table(make):
    assert E.exact_dedup(make([])).collect() == []
    assert E.drop_copies(make([])).collect() == []


def test_main_path_is_native(make):
    plan = E.exact_dedup(make(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
