import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from splitlift.llm import periodic_runs as P

from llm_fixtures import make  # noqa: F401


def brute(w):
    """Runs by the definition: every period, every stretch."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            e = i + q
            smaller = any(w[s:e - d] == w[s + d:e] for d in range(1, q))
            if e - s >= max(6, 4 * q) and not smaller:
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng, most=150):
    n, k = rng.randint(0, most), rng.choice([1, 2, 2, 3, 5, 40])
    w = [b"%d" % rng.randrange(k) for _ in range(n)]
    if n and rng.random() < .6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        w = w[:a] + [w[a + i % p] for i in range(n - a)] + [b"%d" % rng.randrange(k) for _ in range(rng.randint(0, 9))]
    return w * (4 if rng.random() < .3 else 1)


def test_transform_and_back():
    rng = np.random.default_rng(1)
    for n in (2, 8, 64):
        a = rng.integers(0, P.PRIME, (3, n))
        assert (P.inverse_ntt(P.ntt(a)) == a).all()


def test_zero_mismatches_are_all_occurrences():
    rng = np.random.default_rng(2)
    for b in (1, 2, 4, 16):
        blocks, windows = rng.integers(0, 2, (50, b)), rng.integers(0, 2, (50, 2 * b))
        want = [(r, d) for r in range(50) for d in range(b) if (windows[r, d:d + b] == blocks[r]).all()]
        assert list(zip(*map(list, P.zero_mismatches(blocks, windows)))) == want


@pytest.mark.parametrize("block", [2, 8, P.BLOCK])
def test_runs_match_the_definition(monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(40):
        texts = [random_words(rng) for _ in range(rng.randint(1, 5))]
        assert P.text_runs(texts) == [brute(w) for w in texts]


def test_long_and_repetitive_texts():
    assert P.text_runs([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]
    nested = ([b"a"] * 50 + [b"b"]) * 40
    assert P.text_runs([nested]) == [brute(nested)]
    runs = P.text_runs([([b"a"] * 5000 + [b"b"]) * 40])[0]
    assert len(runs) == 41 and (0, 200_040, 5001) in runs


def loops(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k if k < a else a + (k - a) % p] for k in range(n)]


TEXTS = ["", None, "  \t\n", "one", "a b " * 30, "x y x y\x1cz " * 5, "the end " + "again and " * 12 + "done",
         "w " * 5, "w " * 6, "ab cd ef gh " * 3 + "ab cd ef", "ab cd ef gh " * 4, " ".join(map(str, range(2000)))]


def test_queries_digest(make):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(300)]
    got = {r.doc_id: r for r in P.runs_digest(P.periodic_runs(P.with_loops(make(rows)))).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w, r = loops(i, t), got[i]
        runs = brute(w)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        assert (r.n_runs, r.n_words) == (len(runs), len(w))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_repeated_rows_nulls_and_empty_table(make):
    rows = [(None, "a b " * 9)] * 2 + [(None, None), (1, "")]
    out = P.runs_digest(P.periodic_runs(P.with_loops(make(rows)))).collect()
    assert sorted(r.n_runs for r in out) == [0, 0, 1, 1]
    assert all(r.runs_sha256 is not None and r.collapsed_sha256 is not None for r in out)
    assert P.runs_digest(P.periodic_runs(make([]))).collect() == []


def test_chunks_do_not_change_results(monkeypatch):
    monkeypatch.setattr(P, "CHUNK_WORDS", 300)
    texts = [b" ".join(random_words(random.Random(i))) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts, pa.binary())], names=["id", "t"])
    chunks = list(P._chunks(batch))
    assert len(chunks) > 5 and [i.as_py() for ids, _ in chunks for i in ids] == list(range(60))
    assert [r for _, part in chunks for r in P.text_runs(part)] == [brute(t.split()) for t in texts]
