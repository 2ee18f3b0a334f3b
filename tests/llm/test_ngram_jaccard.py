import random
import re

import numpy as np
import pytest

from splitlift.llm import _graph
from splitlift.llm import ngram_jaccard as J

from llm_fixtures import make  # noqa: F401


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed, n=80):
    rnd = random.Random(seed)
    fresh = lambda k: [rnd.choice("abcdefgh") + str(rnd.randint(0, 60)) for _ in range(k)]
    rows, bases = [], [fresh(rnd.choice([4, 5, 6, 9, 12, 31, 36, 40, 80, 200])) for _ in range(12)]
    quote = fresh(30)
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            w[rnd.randrange(len(w))] = rnd.choice(["q", "r"]) + str(rnd.randint(0, 99))
        if rnd.random() < 0.2:
            w += quote
        t = " ".join(w)
        rows.append((i, t.upper() if rnd.random() < 0.1 else t))
    rows += [(n, None), (n + 1, " \n"), (n + 2, "one two"), (n + 3, "One  TWO"), (n + 4, "one"), (None, rows[0][1])]
    rnd.shuffle(rows)
    return rows


def run(make, rows):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(make(rows)).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_matches_brute_force(make, seed):
    rows = corpus(seed)
    assert run(make, rows) == brute(rows)


def test_small_pages_give_the_same(make, monkeypatch):
    monkeypatch.setattr(J, "LEAF", 4)
    monkeypatch.setattr(J, "PAGE_SHINGLES", 2048)
    rows = corpus(5)
    assert run(make, rows) == brute(rows)


def test_every_linked_pair_shares_an_entry():
    rng = np.random.default_rng(1)
    seen = 0
    for n in (1, 4, 5, 8, 20, 30, 31, 32, 33, 39, 40, 64, 150, 700):
        for _ in range(200):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            cut, add = rng.integers(0, n // 5 + 1), rng.integers(0, n // 4 + 1)
            b = np.concatenate([a[cut:], rng.integers(0, 2**63, add, dtype=np.uint64)])
            both = n - cut
            if both and 100 * both >= 80 * (n + add):
                seen += 1
                common = set(J.entries(np.unique(a))) & set(J.entries(np.unique(b)))
                assert len(common) >= (J.SHARED if n >= J.SHARED_FROM and n - cut + add >= J.SHARED_FROM else 1)
    assert seen > 500


def test_bound_never_drops_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(5, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - n // 12], rng.integers(0, 2**63, n // 12, dtype=np.uint64)]))

        def point(s, comp):
            size = 1 << max(4, int(len(s) // 4).bit_length())
            return {"cls": comp, "comp": comp, "n": len(s), "hashes": s.tobytes(), "counts": np.bincount(
                (s & np.uint64(size - 1)).astype(int), minlength=size).astype(np.uint16).tobytes()}
        x, y = [point(a, 1)], [point(b, 2)]
        if J._links(x, y, False, 80):
            assert J._may_link(x, y, False, 80)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.comp for r in _graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_one_row_per_group_stays(make):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g H"), (2, "a b c d e f g H"), (3, "x"), (3, "x"), (4, None), (5, "")]
    df = make(rows)
    out = J.keep_one_per_component(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.select("doc_id", "text").fillna("-").collect()) == [
        (1, "a b c d e f g h"), (3, "x"), (4, "-"), (5, "")]


def test_empty_table_and_long_text(make):
    assert J.jaccard_components(make([])).collect() == []
    long = " ".join(str(i) for i in range(20_000))
    assert run(make, [(9, long), (4, long + " end")]) == [(4, 19_997, 4), (9, 19_996, 4)]


def test_copies_of_a_row_are_one_point(make):
    text = " ".join(map(str, range(60)))
    rows = [(1, text + " x")] + [(2, text)] * 20 + [(None, text)] * 20
    docs = make(rows, extra=False).selectExpr("doc_id as id", "xxhash64(doc_id, text) as dk", "text")
    sets = J.set_rows(docs).cache()
    placed = J.leaves(sets, J.directory(J.entry_rows(docs)))
    points = [p["cls"] for r in J.page_points(docs, sets, placed).collect() for p in r.p]
    assert len(points) == len(set(points)) == 2
    assert run(make, rows) == brute(rows)


def test_small_sets_share_no_entry_without_a_shingle_in_common():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 8, 12, 20, 31, 32, 45, 56, 63):
        seen = set()
        for _ in range(100):
            own = J.entries(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))).tolist()
            assert own and not seen & set(own)
            seen |= set(own)


def test_linked_sets_in_few_groups_share_an_entry():
    rng = np.random.default_rng(4)
    for _ in range(3000):
        n = int(rng.integers(4, 100))
        few = np.uint64(int(rng.integers(1, 8)))  # hashes in few groups: most are empty
        a, more = (x - x % np.uint64(256) + x % few for x in (
            rng.integers(0, 2**62, n, dtype=np.uint64), rng.integers(0, 2**62, n, dtype=np.uint64)))
        cut, add = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 4 + 1))
        b = np.concatenate([a[cut:], more[:add]])
        if 100 * (n - cut) >= 80 * (n + add):
            common = set(J.entries(np.unique(a)).tolist()) & set(J.entries(np.unique(b)).tolist())
            assert len(common) >= (J.SHARED if n >= J.SHARED_FROM and n - cut + add >= J.SHARED_FROM else 1)


def test_long_lists_are_dealt_out_and_whole(make):
    rows = [(i, "same words on every page here " + f"w{i}") for i in range(40)]
    listed = J.entry_rows(make(rows).coalesce(1)).cache()
    assert listed.groupBy("grp").count().agg({"count": "max"}).first()[0] <= 2
    want = {}
    for r in listed.collect():
        want.setdefault(r.coord, set()).add(r.cls)
    want = {(c, k, len(v)) for c, v in want.items() if len(v) > 1 for k in v}
    assert want and {tuple(r) for r in J.directory(listed).collect()} == want
