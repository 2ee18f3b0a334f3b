"""Held-out accuracy, and the numeric parts against plain versions."""
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from splitlift.llm._rows import hash_limit
from splitlift.llm import catalog, language_id as L, quality as Q, toxicity as T
from splitlift.llm._vocab import default_vocabulary

from llm_fixtures import make  # noqa: F401

SF = "/root/testdata/sf0.01"


def auc(score, y):
    rank = np.empty(len(y))
    rank[np.argsort(score)] = np.arange(len(y))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5


def scored(spark, name, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = catalog.QUERIES[name](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    return out.join(labels, "doc_id").where(f"{label} is not null").toPandas()


def test_quality_on_held_out_documents(spark):
    d = scored(spark, "op9_quality", "quality")
    assert (d.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in d.doc_id]).all()
    h = d[d.held_out]
    assert d.score.between(0, 1).all() and auc(h.score.values, h.quality.values) > 0.97
    assert ((h.score >= 0.3) == (h.predicted == 1)).all() and (h.predicted == h.quality).mean() > 0.95


def test_toxicity_on_held_out_documents(spark):
    d = scored(spark, "op1_toxicity", "toxic")
    assert (d.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in d.doc_id]).all()
    h = d[d.held_out]
    assert d.score.between(0, 1).all() and auc(h.score.values, h.toxic.values) > 0.95


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    d = catalog.op2_language_id(spark, SF).join(docs, "doc_id").toPandas()
    assert len(d) == 1000 and (d[d.held_out].lang_pred == d[d.held_out].lang).mean() > 0.97


def test_edge_rows_are_scored(make, spark):
    rows = [(i, f"good plain words number {i} here") for i in range(40)] + [(i, "BAD!! BAD!! BAD!!") for i in range(40, 80)]
    rows += [(None, "no id"), (100, None), (101, ""), (102, "9 + 9"), (1, rows[1][1]), (103, "word " * 30_000)]
    labels = spark.createDataFrame([(i, int(i < 40), int(i >= 40)) for i in range(80)] + [(None, 1, 1), (7, None, None)],
                                   "doc_id long, quality int, toxic int")
    q = Q.quality_scores(make(rows), labels).collect()
    t = T.toxicity_scores(make(rows), labels, steps=3).collect()
    l_ = {r.doc_id: r for r in L.identify_languages(make(rows), default_vocabulary("byte_bpe_50k.tiktoken"), turns=1).collect()}
    assert len(q) == len(t) == len(rows)
    assert all(0 <= r.score <= 1 for r in (*q, *t))
    assert {r.doc_id: r.score for r in t}[101] == 0
    assert l_[100].lang_pred == l_[101].lang_pred == l_[102].lang_pred == "und" and l_[103].lang_pred == "en"
    good = Q.keep_good(make(rows), labels)
    assert good.columns == make(rows).columns and 0 < good.count() < len(rows)


def test_without_labels_and_without_rows(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = default_vocabulary("byte_bpe_50k.tiktoken")
    assert [r.score for r in Q.quality_scores(make([(1, "a")]), none).collect()] == [pytest.approx(0.4995, abs=1e-3)]
    assert [r.predicted for r in T.toxicity_scores(make([(1, "a")]), none).collect()] == [0]
    assert Q.quality_scores(make([]), none).collect() == [] == T.toxicity_scores(make([]), none).collect()
    assert L.identify_languages(make([]), path).collect() == []
    unknown = make([(1, "abc"), (2, "")]).withColumn("lang", Q.F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in L.identify_languages(unknown, path).collect()} == {("und", 0.0)}


def test_isotonic_is_the_best_monotone_fit():
    rnd = random.Random(5)
    for _ in range(50):
        bins = [(i, float(rnd.randint(0, n)), float(n)) for i, n in enumerate(rnd.choices(range(1, 9), k=12))]
        _, got = Q.isotonic(bins)
        assert (np.diff(got) >= -1e-12).all()
        # min-max formula of isotonic regression
        pos, weight = np.array([b[1] for b in bins]), np.array([b[2] for b in bins])
        want = [max(min(pos[a:b].sum() / weight[a:b].sum() for b in range(i + 1, 13)) for a in range(i + 1))
                for i in range(12)]
        assert np.allclose(got, want)


def test_normal_equations_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, len(Q.NAMES))), rng.integers(0, 2, 60)
    df = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "x array<double>, y double")
    model = Q.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = model.features(x)
    for parts in (1, 5):
        gram, target = Q.normal_equations(df.repartition(parts), model)
        assert np.allclose(gram, z.T @ z) and np.allclose(target, z.T @ y)


def test_noisy_or_and_sentences():
    text = "One two. Three!  Ünd vier\nfive"
    raw = np.frombuffer((text + "x.y").encode(), np.uint8)
    cut = len(text.encode())
    s = T.Sentences(raw, np.array([0, cut, len(raw)]))
    assert np.bincount(s.doc).tolist() == [4, 2]
    logits = np.array([0.0, 1, -1, 2, 0.5, -3])
    p = 1 / (1 + np.exp(-logits))
    assert np.allclose(T.noisy_or(logits, s.doc, 2), [1 - np.prod(1 - p[:4]), 1 - np.prod(1 - p[4:])])


def test_worst_sentence_is_located(spark, make):
    docs = make([(1, "Alles gut hier. Du bist ein Ïdiot heute! Ende.")]).selectExpr("doc_id as id", "text")
    w = np.zeros(1 << T.BITS, np.float32)
    s = T.Sentences(np.frombuffer("Ïdiot".encode(), np.uint8), np.array([0, 6]))
    w[s.features()[0][:1]] = 20
    r = T.score_documents(docs, w, -5.0, ["id"]).first()
    text = "Alles gut hier. Du bist ein Ïdiot heute! Ende."
    assert text[r.worst_start:r.worst_end] == "Du bist ein Ïdiot heute" and r.score > 0.99


def test_forward_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abc", b"bc", b" ab", b"ca"})
    table = L.Pieces(pieces)
    rng = np.random.default_rng(6)
    prob = rng.random((len(pieces), 2))
    prob /= prob.sum(axis=0)
    at = {p: i for i, p in enumerate(pieces)}

    def total(word, j):
        if not word:
            return 1.0
        return sum(prob[at[word[:k]], j] * total(word[k:], j) for k in range(1, len(word) + 1) if word[:k] in at)
    for word in (b" abcab", b" a", b" zzab\xc3", b" abcabcab"):
        got = L.forward(L.lookups(np.frombuffer(word, np.uint8)[None], table), L.scaled(prob, table.size))[-1][0]
        assert np.allclose(got / L._SCALE ** len(word), [total(word, 0), total(word, 1)])
    # expected counts add up to one segmentation's bytes per word
    counts = np.zeros((table.n + 1, 2))
    L._expected(np.frombuffer(b" abcab", np.uint8)[None], np.array([1]), np.array([3.0]), table,
                L.scaled(prob, table.size), counts)
    assert np.isclose((counts[:-1, 1] * table.size).sum(), 18) and counts[:, 0].sum() == 0


def test_long_pieces_take_part_in_the_sum():
    pieces = L.read_pieces(default_vocabulary("byte_bpe_50k.tiktoken"))
    assert b" government" in pieces and len(pieces) >= 50_256
    table = L.Pieces(pieces)
    size = table.size.astype(float)
    prob = (2.0 ** -size / (2.0 ** -size).sum())[:, None]
    chance = dict(zip(pieces, prob[:, 0]))
    word = b" governments"
    a = [1.0]
    for j in range(1, len(word) + 1):
        a.append(sum(a[i] * chance.get(word[i:j], 0.0) for i in range(j)))
    got = L.forward(L.lookups(np.frombuffer(word, np.uint8)[None], table), L.scaled(prob, table.size))[-1][0, 0]
    assert got / L._SCALE ** len(word) == pytest.approx(a[-1], rel=1e-9)


def test_a_sample_of_any_number_of_rows(spark):
    """The limit is a share of all 64-bit hashes, so it never rounds to nothing."""
    for rows in (10, 3_000, 10 ** 9, 10 ** 13, 10 ** 15):
        limit = hash_limit(3000, rows)
        share = (limit + 2 ** 63 + 1) / 2 ** 64
        assert share == pytest.approx(min(1, 3000 / rows), rel=1e-3)
    drawn = spark.range(200_000).where(F.xxhash64("id") <= hash_limit(3000, 200_000)).count()
    assert 2700 < drawn < 3300


def test_every_language_is_learned_from_a_small_share(make, spark):
    docs = spark.range(40_000).selectExpr(
        "id as doc_id", "if(id % 2 = 0, 'the cat and the dog', 'le chat et le chien') as text",
        "if(id % 2 = 0, 'en', 'fr') as lang")
    out = L.identify_languages(docs, default_vocabulary("byte_bpe_50k.tiktoken"), sample=20, turns=2)
    got = {(r.lang_pred, r.text) for r in out.join(docs, "doc_id").select("lang_pred", "text").distinct().collect()}
    assert got == {("en", "the cat and the dog"), ("fr", "le chat et le chien")}


def _recursion(word, prob, at):
    """log of the sum over segmentations, in whole numbers of many digits."""
    a = [Fraction(1)]
    for j in range(1, len(word) + 1):
        a.append(sum((a[i] * prob[at[word[i:j]]] for i in range(max(0, j - 4), j) if word[i:j] in at), Fraction(0)))
    return math.log(a[-1].numerator) - math.log(a[-1].denominator)


def test_long_runs_are_summed_whole():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" ab", b"ab", b"abc", b"bca", b"abab"})
    table, at = L.Pieces(pieces), {p: i for i, p in enumerate(pieces)}
    prob = np.full((len(pieces), 1), 1e-10)  # unseen bytes: 500 of them are far below any double
    exact = [Fraction(p) for p in prob[:, 0].tolist()]
    for size in (L.PLAIN - 1, L.PLAIN, L.PLAIN + 1, 48, 49, 500):
        word = b" " + (b"abcab" * 100)[:size]
        found = L.lookups(np.frombuffer(word, np.uint8)[None], table)
        want = _recursion(word, exact, at)
        assert L.log_forward(found, L.logarithms(prob))[-1][0, 0] == pytest.approx(want, rel=1e-12)
        if size <= L.PLAIN:
            short = np.log(L.forward(found, L.scaled(prob, table.size))[-1][0, 0]) - len(word) * np.log(L._SCALE)
            assert short == pytest.approx(want, rel=1e-12)


def test_expected_counts_agree_in_both_forms():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" ab", b"ab", b"abc", b"bca"})
    table = L.Pieces(pieces)
    rng = np.random.default_rng(2)
    prob = rng.random((len(pieces), 2))
    prob /= prob.sum(axis=0)
    body = np.frombuffer(b" abcab abbca cabab", np.uint8).reshape(3, 6)
    one, two = np.zeros((2, table.n + 1, 2))
    L._expected(body, np.array([0, 1, 1]), np.array([2.0, 1, 3]), table, L.scaled(prob, table.size), one)
    L._log_expected(body, np.array([0, 1, 1]), np.array([2.0, 1, 3]), table, L.logarithms(prob), two)
    assert np.allclose(one[:-1], two[:-1]) and one.sum() > 0


def test_expectation_maximisation_by_enumeration():
    """One turn against the sum over all segmentations, listed one by one."""
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abc"})
    table, at = L.Pieces(pieces), {}
    at.update({p: i for i, p in enumerate(pieces)})
    prob = np.random.default_rng(4).random((len(pieces), 1))
    prob /= prob.sum()

    def ways(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in at:
                for rest in ways(word[k:]):
                    yield [word[:k], *rest]
    for word in (b" abcab", b" ababc"):
        want = np.zeros(len(pieces))
        weights = [(w, np.prod([prob[at[p], 0] for p in w])) for w in ways(word)]
        for w, chance in weights:
            for p in w:
                want[at[p]] += chance / sum(c for _, c in weights)
        got = np.zeros((table.n + 1, 1))
        L._expected(np.frombuffer(word, np.uint8)[None], np.array([0]), np.array([1.0]), table,
                    L.scaled(prob, table.size), got)
        assert np.allclose(got[:-1, 0], want)


def test_scores_of_long_runs_are_numbers(make):
    rows = [(i, f"plain words number {i}") for i in range(30)] + [(50, "x" * 500), (51, "é" * 3000), (52, "ßq" * 40 + " a")]
    out = L.identify_languages(make(rows), default_vocabulary("byte_bpe_50k.tiktoken"), turns=1).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.lang_pred == "en" for r in out)


class _Shared:
    """Stands for a broadcast value."""

    def __init__(self, value):
        self.value = value

    def unpersist(self):
        pass


def test_gradient_is_that_of_the_noisy_or_likelihood(monkeypatch):
    texts = ["You are bad. All is fine here.", "fine words only. More fine words", "bad bad bad", "all here. bad words."]
    y = np.array([1, 0, 1, 0])
    body = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    s = T.Sentences(np.frombuffer(body, np.uint8), offsets)
    slot, heads = s.features()
    lists = [y, slot, heads, s.form, s.sentence, s.doc]
    bag = pa.RecordBatch.from_arrays([pa.array([np.asarray(v).astype(np.int32).tobytes()], pa.binary()) for v in lists],
                                     names=list(T._ARRAYS))
    tasks, shared = [], _Shared(None)

    def summed(bags, run):
        tasks.append(run)
        return np.zeros(1)  # no evidence, and no documents: training stops after one look

    class Bags:
        def coalesce(self, n):
            return self

        class sparkSession:  # noqa: N801
            class sparkContext:  # noqa: N801
                @staticmethod
                def broadcast(value):
                    return shared
    monkeypatch.setattr(T, "_summed", summed)
    T.train(Bags(), steps=1)
    rng = np.random.default_rng(1)
    state = np.append(rng.normal(0, 0.3, 1 << T.BITS), -1.0)
    shared.value = state
    total = np.frombuffer(next(tasks[-1](iter([bag]))).column("g")[0].as_py())

    def loss(state):
        p = T.noisy_or(s.logits(state[:-1], state[-1]), s.doc, len(texts))
        return -np.log(np.where(y == 1, p, 1 - p)).sum()
    assert total[-1] == len(texts)
    for at in [*np.unique(slot)[:12].tolist(), len(state) - 1]:
        step = np.zeros(len(state))
        step[at] = 1e-5
        assert total[at] == pytest.approx((loss(state + step) - loss(state - step)) / 2e-5, rel=1e-5, abs=1e-8)


def test_cosine_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, len(Q.NAMES)))
    model = Q.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), features=20_000)
    z = model.features(x)[:, :-1]
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    kernel = np.exp(-apart / (2 * Q.WIDTH ** 2 * x.shape[1]))
    assert abs(z @ z.T - kernel).max() < 0.04
