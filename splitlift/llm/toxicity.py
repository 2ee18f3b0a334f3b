"""Toxicity by multiple-instance learning.

Labels are given for documents, toxicity happens in sentences. A sentence's logit
is a bias plus the weights of its words; a word's weight is the sum over its hashed
features (the word, and its byte n-grams with a start mark, so unseen forms of a
word still count). A document is toxic if any sentence is: noisy-or,
    P(document) = 1 - product over sentences of (1 - P(sentence)).
Features with evidence (in ``MIN_DOCS`` toxic training documents or more, and more
often than in others by ``MIN_Z`` standard errors of the log ratio) get weights; the
rest stay zero, or a few thousand bags would be learned by heart. The log-likelihood
of document labels is then climbed by full-batch gradient steps, each one Spark job
over a cut table of the training bags. Trained weights locate the offending sentences.

Bound: the model is fitted on at most about ``SAMPLE`` labelled training documents,
drawn by a hash of the id (all of them if there are fewer). That is 12 bytes a row
to broadcast, and the bags' table has a fixed size. Scoring reads every text whole.

Within a batch each distinct word is weighted once, so the cost is one hash per
word and the n-grams of distinct words.

Sentences end at . ! ? or a line break. Defined cases: NULL or empty text has no
sentence and scores 0; rows with a NULL id are scored and never learned from;
repeated rows are each scored; without training labels every score is that of the
untrained bias; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut
from ._rows import hash_limit
from ._text import U, Words, mix, powers, slices
from .quality import held_out

SAMPLE = 20_000
BITS = 18
STEPS = 40
RATE = 0.05
DECAY = 1e-5
BIAS = -8.0
MIN_DOCS = 5
MIN_Z = 4.0
THRESHOLD = 0.7
BAGS = 8  # partitions of the training table
GRAMS = (3, 4, 5)

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, np.int64)
_STOP[[*b".!?\n"]] = 1


_ARRAYS = ("y", "slot", "heads", "form", "sentence", "doc")


class Sentences:
    """Words of some texts (ASCII lower case), their distinct forms and sentences."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        words = Words(raw, offsets, lower=True, space=_GAP)
        self.words = words
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        place = stops[words.start]
        fresh = np.ones(len(words), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (words.row[1:] != words.row[:-1])
        self.sentence = np.cumsum(fresh) - 1
        self.head = np.flatnonzero(fresh)  # first word of each sentence
        self.doc = words.row[self.head]
        h = words.hashes()
        self.forms, first, self.form = np.unique(h, return_index=True, return_inverse=True)
        self.start, self.end = words.start[first], words.end[first]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(feature indices of all distinct forms one after another, heads)."""
        size = self.end - self.start + 1  # with a start mark
        heads = np.cumsum(size) - size
        total = int(size.sum())
        form = np.repeat(np.arange(len(size)), size)
        at = np.arange(total) - heads[form]
        body = self.words.raw[np.maximum(self.start[form] + at - 1, 0)].astype(U) + U(2)
        body[heads] = U(1)
        index, owner = [self.forms], [np.arange(len(size))]
        p = powers(max(GRAMS))
        for k in GRAMS:
            m = total - k + 1
            if m <= 0:
                continue
            value = body[:m] * p[0]
            for j in range(1, k):
                value = value + body[j:j + m] * p[j]
            inside = at[:m] + k <= size[form[:m]]
            index.append(mix(value[inside] + U(k)))
            owner.append(form[:m][inside])
        index, owner = np.concatenate(index), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        slot = (index[order] >> U(64 - BITS)).astype(np.int32)
        return slot, np.searchsorted(owner[order], np.arange(len(size)))

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        slot, heads = self.features()
        if not len(slot):
            return np.zeros(0)
        form = np.add.reduceat(weights[slot], heads)
        return bias + np.bincount(self.sentence, form[self.form], len(self.head))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def noisy_or(logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """P(document) from the logits of its sentences."""
    return -np.expm1(-np.bincount(doc, softplus(logits), n))


def training_bags(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(y, slot, heads, form, sentence, doc): slices of labelled documents as arrays."""
    known = labels.where("y in (0, 1) and id is not null")
    known = known.where(~held_out(F.col("id"), 3, 1))
    n = known.count()
    known = known.where(F.xxhash64("id") <= hash_limit(sample, n))
    # About `sample` rows at most: a bounded broadcast, so texts are not shuffled.
    bags = docs.join(F.broadcast(known), "id").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in slices(batch, "text"):
                s = Sentences(raw, offsets)
                slot, heads = s.features()
                lists = [rows.column("y").to_numpy(zero_copy_only=False), slot, heads, s.form, s.sentence, s.doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([np.asarray(v).astype(np.int32).tobytes()], pa.binary()) for v in lists],
                    names=list(_ARRAYS))
    packed = bags.repartition(BAGS).mapInArrow(run, ", ".join(f"{c} binary" for c in _ARRAYS))
    return cut(packed, "bags")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for r in batch.to_pylist():
            arrays = [np.frombuffer(r[c], np.int32) for c in _ARRAYS]
            if len(arrays[1]):
                yield arrays


def _one_row(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], names=["g"])


def _summed(bags: DataFrame, run) -> np.ndarray:
    """The sum of one table per task (BAGS tasks, tables of fixed size)."""
    rows = bags.mapInArrow(run, "g binary").collect()
    return np.sum([np.frombuffer(r.g) for r in rows], axis=0) if rows else np.zeros(1)


def evidence(bags: DataFrame) -> np.ndarray:
    """Initial weights: the log ratio of a feature's share of toxic and of other
    training documents, zero for features without evidence."""
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size + 1))
        for y, slot, heads, form, sentence, doc in _bags(batches):
            total[:, -1] += np.bincount(y, minlength=2)
            n = np.diff(np.append(heads, len(slot)))
            pairs = np.unique(doc[sentence].astype(np.int64) * len(heads) + form)
            of, which = pairs // len(heads), pairs % len(heads)
            ends = np.cumsum(n[which])
            at = np.arange(ends[-1]) + np.repeat(heads[which] - ends + n[which], n[which])
            seen = np.unique(np.repeat(of, n[which]) * size + slot[at])
            for label in (0, 1):
                total[label, :-1] += np.bincount(seen % size, y[seen // size] == label, size)
        yield _one_row(total)
    counts = _summed(bags, count)
    if len(counts) < 2:
        return np.zeros(size)
    clean, toxic = counts.reshape(2, size + 1)
    ratio = np.log((toxic[:-1] + 0.5) / (toxic[-1] + 1)) - np.log((clean[:-1] + 0.5) / (clean[-1] + 1))
    sure = ratio / np.sqrt(1 / (toxic[:-1] + 0.5) + 1 / (clean[:-1] + 0.5)) > MIN_Z
    return np.where((toxic[:-1] >= MIN_DOCS) & sure, 0.6 * ratio, 0.0)


def train(bags: DataFrame, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps (Adam) on the noisy-or likelihood."""
    size = (1 << BITS) + 2  # weights, bias, number of documents
    bags = bags.coalesce(BAGS)
    state = np.append(evidence(bags), BIAS)
    active = np.append(state[:-1] != 0, True)
    m, v = np.zeros(size - 1), np.zeros(size - 1)

    def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = shared.value, np.zeros(size)
        for y, slot, heads, form, sentence, doc in _bags(batches):
            total[-1] += len(y)
            word = np.add.reduceat(now[slot], heads)
            logit = now[-1] + np.bincount(sentence, word[form], len(doc))
            p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            clean = np.exp(-np.bincount(doc, softplus(logit), len(y)))  # P(no sentence is toxic)
            pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
            g = pull[doc] * p
            per_form = np.bincount(form, g[sentence], len(heads))
            n = np.diff(np.append(heads, len(slot)))
            total[:-2] += np.bincount(slot, np.repeat(per_form, n), size - 2)
            total[-2] += g.sum()
        yield _one_row(total)

    context = bags.sparkSession.sparkContext
    for step in range(1, steps + 1):
        shared = context.broadcast(state)
        total = _summed(bags, gradient)
        shared.unpersist()
        if not total[-1]:
            break
        g = np.where(active, total[:-1] / total[-1], 0.0)
        g[:-1] += DECAY * state[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        state = state - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return state[:-1].astype(np.float32), float(state[-1])


def _code_points(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def score_documents(docs: DataFrame, weights: np.ndarray, bias: float, keep: list[str]) -> DataFrame:
    """The columns ``keep``, score, n_sentences, and the worst sentence: its place
    (code points) and probability."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            for rows, raw, offsets in slices(batch, "text"):
                s = Sentences(raw, offsets)
                n = rows.num_rows
                z = s.logits(w, b)
                score = noisy_or(z, s.doc, n)
                count = np.bincount(s.doc, minlength=n)
                order = np.lexsort((-z, s.doc))
                some = np.flatnonzero(count)
                worst = order[(np.cumsum(count) - count)[some]]  # the first of the highest logits
                points = _code_points(raw)
                last = np.append(s.head[1:], len(s.words)) - 1
                base = points[offsets[some]]
                begin, end, prob = np.full(n, -1), np.full(n, -1), np.zeros(n)
                begin[some] = points[s.words.start[s.head[worst]]] - base
                end[some] = points[s.words.end[last[worst]]] - base
                prob[some] = 1 / (1 + np.exp(-np.clip(z[worst], -50, 50)))
                none = pa.array(count == 0)
                yield pa.RecordBatch.from_arrays([
                    *(rows.column(c) for c in keep), pa.array(score), pa.array(count.astype(np.int64)),
                    pa.array(begin, mask=np.asarray(none, bool)), pa.array(end, mask=np.asarray(none, bool)),
                    pa.array(prob)], names=[*keep, "score", "n_sentences", "worst_start", "worst_end", "worst_score"])
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(
        run, f"{schema}, score double, n_sentences long, worst_start long, worst_end long, worst_score double")


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE,
                    steps: int = STEPS) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted, n_sentences and
    the worst sentence."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y"))
    weights, bias = train(training_bags(docs, known, sample), steps)
    out = score_documents(docs.withColumn("held_out", held_out(F.col("id"), 3, 1)), weights, bias, ["id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)
