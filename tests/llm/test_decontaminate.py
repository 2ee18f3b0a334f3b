import random

import numpy as np

from splitlift.llm import decontaminate as D

from llm_fixtures import make  # noqa: F401


def naive_tiling(a, b, need):
    """Greedy string tiling by its definition."""
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = (need - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while (i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < need:
            return tiles
        tiles.append((i, j, n))
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False


def test_tiling_matches_its_definition():
    rnd = random.Random(4)
    for _ in range(400):
        a = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 14))]
        b = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 20))]
        need = rnd.choice([1, 2, 3])
        to = np.array([11400714819323198485, 7046029254386353131, 1609587929392839161, 9650029242287828579], np.uint64)
        got = D.tile(to[a] if a else np.zeros(0, np.uint64), to[b] if b else np.zeros(0, np.uint64), need)
        want = naive_tiling(a, b, need)
        assert sum(n for *_, n in got) == sum(n for *_, n in want)
        assert [n for *_, n in got] == [n for *_, n in want]


def test_parts_of_seed_pairs_do_not_change_the_tiling(monkeypatch):
    rnd = random.Random(7)
    to = np.array([3, 5, 7], np.uint64) << np.uint64(40)
    cases = [(to[[rnd.randint(0, 2) for _ in range(40)]], to[[rnd.randint(0, 2) for _ in range(90)]]) for _ in range(40)]
    whole = [D.tile(a, b, 3) for a, b in cases]
    monkeypatch.setattr(D, "SEED_PAIRS", 5)
    assert [D.tile(a, b, 3) for a, b in cases] == whole


def test_one_line_repeated_takes_little_memory():
    import tracemalloc
    item, doc = np.full(1000, 9, np.uint64), np.full(20_000, 9, np.uint64)
    tracemalloc.start()
    assert D.tile(item, doc, 5) == [(0, 0, 1000)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # 2e7 pairs of common seeds


def test_filter_holds_all_seeds_and_few_others(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    seeds = rnd.integers(0, 2 ** 64, 200_000, dtype=np.uint64)
    rows = [(5, part.view(np.int64).tolist()) for part in np.array_split(seeds, 40)] + [(3, [1]), (1, [])]
    items = spark.createDataFrame(rows, "need int, seeds array<long>").repartition(4)
    table, probes, lengths = D.seed_filter(items)
    power = (len(table) * 8).bit_length() - 1
    assert lengths == [3, 5] and len(table) * 8 == 2 ** power >= 32 * len(seeds)
    assert len(D._in_filter(seeds, table, power, probes)) == len(seeds)
    others = rnd.integers(0, 2 ** 64, 1_000_000, dtype=np.uint64)
    assert len(D._in_filter(others, table, power, probes)) < 20
    monkeypatch.setattr(D, "MAX_POWER", 19)  # fuller than meant: nothing is lost
    table, probes, _ = D.seed_filter(items)
    assert len(table) * 8 == 2 ** 19
    assert len(D._in_filter(seeds, table, 19, probes)) == len(seeds)


def test_filter_size_follows_the_seeds():
    assert D.filter_size(0) == (19, 8) and D.filter_size(1_000_000) == (25, 8)
    assert D.filter_size(10 ** 9) == (30, 1)


ITEM = "The quick brown fox jumps over the lazy dog. Then it sleeps in the warm sun until noon comes again"


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def found(make, spark, rows, items):
    return sorted(((r.doc_id, r.item_id, r.n_tiles, r.in_order) for r in
                   D.contaminated_pairs(make(rows), bench(spark, items)).collect()), key=str)


def test_exact_reordered_partial_and_clean(make, spark):
    first, second = ITEM.split(". ")
    rows = [(1, f"words before {ITEM.upper()}! and after"), (2, f"{second}; other words here, {first}"),
            (3, "the quick brown fox jumps away from a different story about something else"),
            (4, "nothing to see"), (5, None), (6, ""), (None, ITEM), (7, ITEM), (7, ITEM)]
    got = found(make, spark, rows, [(10, ITEM), (11, None), (12, "  ")])
    assert got == sorted([(1, 10, 1, True), (2, 10, 2, False), (None, 10, 1, True), (7, 10, 1, True), (7, 10, 1, True)],
                         key=str)


def test_short_items_need_their_whole_run(make, spark):
    rows = [(1, "say red green blue now"), (2, "red blue green"), (3, "reds green blue")]
    assert found(make, spark, rows, [(1, "Red green BLUE"), (2, "zzz")]) == [(1, 1, 1, True)]


def test_passage_inside_a_very_long_text(make, spark):
    rows = [(1, " ".join(f"w{i}" for i in range(40_000)) + " " + ITEM + " tail" * 1000)]
    assert found(make, spark, rows, [(9, ITEM)]) == [(1, 9, 1, True)]


def test_filter_keeps_clean_rows_and_columns(make, spark):
    df = make([(1, ITEM), (2, "clean"), (2, "clean"), (None, None)])
    out = D.drop_contaminated(df, bench(spark, [(1, ITEM)]))
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (2, "clean"), (2, "clean")]


def test_empty_tables(make, spark):
    assert found(make, spark, [], [(1, ITEM)]) == []
    assert found(make, spark, [(1, ITEM)], []) == []
