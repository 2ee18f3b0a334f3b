"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary (byte strings; every single byte is one)
have a probability per language. A word's probability is summed over all its
segmentations into pieces, by the forward algorithm:
    a(0) = 1,   a(j) = sum over pieces ending at j of a(j - length) * P(piece).
A text's log-likelihood is the sum over its words, plus the language's log share.

1. A bounded sample of training documents (about ``SAMPLE`` per language, drawn by a
   hash of the id; all of them where there are fewer) is counted into distinct words
   per language.
2. Expectation-maximisation: each turn is one Spark job that runs forward and
   backward over the distinct words and sums expected piece counts per language;
   tables have one number per piece and language.
3. Scoring reads every text whole: per slice of texts each distinct word goes
   through the forward algorithm once, all languages and all words of one length
   at a time.

Words are runs of ASCII letters and non-ASCII characters, ASCII lower-cased, with a
blank in front, of any length, as are the pieces. Sums over the segmentations of words
of more than ``PLAIN`` bytes are kept as logarithms, where a product of small numbers
cannot vanish.

Defined cases: ``und`` and score 0 for NULL or empty text, for text without a letter,
and for all texts if nothing can be learned; NULL ids are scored and never learned
from; ties go to the alphabetically first language; repeated rows are each scored;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut
from ._rows import hash_limit
from ._text import U, Words, mix, powers, slices
from .quality import held_out

SAMPLE = 3000
TURNS = 4
PLAIN = 24  # bytes that products of 1e-13 per byte and more, scaled, stay in range for
SMOOTH = 0.1
PARTS = 8  # partitions of the word table
SLICE = 8 << 20
_SCALE = 256.0  # per byte, so that products of small numbers stay in range

_GAP = np.ones(256, bool)
_GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def read_pieces(path: str) -> list[bytes]:
    """Byte strings of a rank file (base64 and rank on each line)."""
    with open(path, "rb") as f:
        found = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted(found | {bytes([b]) for b in range(256)})


class Pieces:
    """Piece numbers by hash: two tables addressed by different bits of it."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        p = powers(max(map(len, pieces)) + 1)
        self.hash = np.array([_piece_hash(np.frombuffer(x, np.uint8), p) for x in pieces], U)
        self.size = np.array([len(x) for x in pieces])
        self.lengths = frozenset(self.size.tolist())
        self.bits = max(12, (32 * self.n).bit_length())
        self.one = np.full(1 << self.bits, -1, np.int32)
        self.two = np.full(1 << self.bits, -1, np.int32)
        self.one[self._slot(self.hash, 0)] = np.arange(self.n)
        lost = np.flatnonzero(self.one[self._slot(self.hash, 0)] != np.arange(self.n))
        self.two[self._slot(self.hash[lost], 1)] = lost
        if len(np.unique(self._slot(self.hash[lost], 1))) != len(lost):
            raise ValueError("piece table is too small")

    def _slot(self, h: np.ndarray, which: int) -> np.ndarray:
        return ((h >> U(64 - self.bits)) if which == 0 else (h & U((1 << self.bits) - 1))).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of pieces, or n where there is none."""
        out = self.one[self._slot(h, 0)]
        good = (out >= 0) & (self.hash[out] == h)
        other = self.two[self._slot(h[~good], 1)]
        out = out.copy()
        out[~good] = np.where((other >= 0) & (self.hash[other] == h[~good]), other, self.n)
        return out


def _piece_hash(x: np.ndarray, p: np.ndarray) -> np.uint64:
    return mix(np.sum((x.astype(U) + U(1)) * p[:len(x)], dtype=U, keepdims=True) + _salt(len(x)))[0]


def _salt(size: int) -> np.uint64:
    return U(size * 0x9E3779B97F4A7C15 % 2**64)


def lookups(words: np.ndarray, pieces: Pieces) -> list[np.ndarray | None]:
    """words: (count, length) bytes. For each piece length k, the piece numbers of
    words[:, i:i + k] for every i; None where no piece is found."""
    body = words.astype(U) + U(1)
    length = body.shape[1]
    top = max((k for k in pieces.lengths if k <= length), default=0)
    p = powers(top + 1)
    total, out = None, []
    for k in range(1, top + 1):
        last = body[:, k - 1:] * p[k - 1]
        total = last if total is None else total[:, :length - k + 1] + last
        hit = pieces.find(mix((total + _salt(k)).ravel())).reshape(total.shape) if k in pieces.lengths else None
        out.append(hit if hit is not None and (k == 1 or (hit < pieces.n).any()) else None)
    return out


def forward(found: list[np.ndarray | None], prob: np.ndarray) -> list[np.ndarray]:
    """a(0..length), each (count, languages); prob: (pieces + 1, languages), scaled."""
    count, length = found[0].shape
    a = [np.ones((count, prob.shape[1]))]
    ks = [k for k, f in enumerate(found, 1) if f is not None]
    for j in range(1, length + 1):
        now = np.zeros_like(a[0])
        for k in (k for k in ks if k <= j):
            now += a[j - k] * prob[found[k - 1][:, j - k]]
        a.append(now)
    return a


def scaled(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Probabilities times _SCALE per byte, and zero for "no piece"."""
    size = np.minimum(size, PLAIN + 2)  # longer pieces fit in no word of this form
    return np.concatenate([prob * _SCALE ** size[:, None], np.zeros((1, prob.shape[1]))])


def _any_hit(found: list[np.ndarray | None], pieces: int) -> list[list[int]]:
    """For each end of a piece, the piece lengths found there in some word."""
    length = found[0].shape[1]
    out: list[list[int]] = [[] for _ in range(length + 1)]
    for k, hit in enumerate(found, 1):
        if hit is not None:
            for i in np.flatnonzero((hit < pieces).any(axis=0)).tolist():
                out[i + k].append(k)
    return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    top = terms[0]
    for t in terms[1:]:
        top = np.maximum(top, t)
    total = np.exp(terms[0] - top)
    for t in terms[1:]:
        total += np.exp(t - top)
    return top + np.log(total)


def log_forward(found: list[np.ndarray | None], logs: np.ndarray) -> np.ndarray:
    """log a(0..length), (length + 1, count, languages); logs: (pieces + 1, languages),
    of probabilities that are not scaled. Every byte is a piece, so no sum is empty."""
    count, length = found[0].shape
    a = np.zeros((length + 1, count, logs.shape[1]))
    for j, ks in enumerate(_any_hit(found, len(logs) - 1)):
        if j:
            a[j] = _log_sum([a[j - k] + logs[found[k - 1][:, j - k]] for k in ks])
    return a


def logarithms(prob: np.ndarray) -> np.ndarray:
    """Logarithms of probabilities, minus infinity for "no piece"."""
    return np.concatenate([np.log(prob), np.full((1, prob.shape[1]), -np.inf)])


def by_length(start: np.ndarray, end: np.ndarray, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, bytes with a blank in front) of words of each length, in chunks."""
    size = end - start
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        step = max(1, 500_000 // int(size[order[a]]))
        for at in range(a, b, step):
            own = order[at:min(at + step, b)]
            body = raw[start[own][:, None] + np.arange(size[own[0]])]
            yield own, np.concatenate([np.full((len(own), 1), 0x20, np.uint8), body], axis=1)


class Vocabulary:
    """Distinct words of some texts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        words = Words(raw, offsets, lower=True, space=_GAP)
        self.start, self.end, self.row, self.raw = words.start, words.end, words.row, words.raw
        self.forms, self.first, self.form = np.unique(words.hashes(), return_index=True, return_inverse=True)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def language_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n): distinct words of training documents, counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in slices(batch, "text"):
                v = Vocabulary(raw, offsets)
                langs = rows.column("lang").dictionary_encode()
                lang = np.asarray(langs.indices)[v.row].astype(np.int64)
                pair, n = np.unique(lang * len(v.forms) + v.form, return_counts=True)
                of, form = pair // max(1, len(v.forms)), pair % max(1, len(v.forms))
                body = v.raw.tobytes()
                first = v.first[form]
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(of)),
                     pa.array([body[a:b] for a, b in zip(v.start[first].tolist(), v.end[first].tolist())], pa.binary()),
                     pa.array(n)], names=["lang", "word", "n"])
    return (docs.mapInArrow(run, "lang string, word binary, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, pieces: list[bytes], sample: int = SAMPLE, turns: int = TURNS
          ) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log shares, piece probabilities (pieces, languages)); docs: (id,
    text, lang, dk) that may be learned from."""
    per_lang = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(per_lang)
    if not langs:
        return [], np.zeros(0), np.zeros((len(pieces), 0))
    shares = np.array([per_lang[x] for x in langs], float)
    limit = F.create_map(*[F.lit(v) for x in langs for v in (x, hash_limit(sample, per_lang[x]))])
    drawn = docs.where(F.xxhash64("id") <= limit[F.col("lang")])
    words = cut(language_words(drawn.select("lang", "text")).repartition(PARTS), "words")
    context = docs.sparkSession.sparkContext
    table = Pieces(pieces)
    number = {x: i for i, x in enumerate(langs)}
    prob = np.full((len(pieces), len(langs)), 1 / len(pieces))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, prob = shared.value
        p, logs = scaled(prob, table.size), logarithms(prob)
        total = np.zeros((table.n + 1, len(langs)))
        for batch in batches:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            n = batch.column("n").to_numpy(zero_copy_only=False)
            words = batch.column("word").to_pylist()
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size)
            for own, body in by_length(ends - size, ends, np.frombuffer(b"".join(words), np.uint8)):
                if body.shape[1] <= PLAIN + 1:
                    _expected(body, lang[own], n[own], table, p, total)
                else:
                    _log_expected(body, lang[own], n[own], table, logs, total)
        yield pa.RecordBatch.from_arrays([pa.array([total[:-1].tobytes()], pa.binary())], names=["t"])
    for _ in range(turns):
        shared = context.broadcast((table, prob))
        rows = words.mapInArrow(expect, "t binary").collect()  # one table per task, PARTS at most
        shared.unpersist()
        count = np.sum([np.frombuffer(r.t) for r in rows], axis=0).reshape(prob.shape) + SMOOTH
        prob = count / count.sum(axis=0)
    return langs, np.log(shares / shares.sum()), prob


def _expected(body, lang, n, table: Pieces, p: np.ndarray, total: np.ndarray) -> None:
    """Adds expected piece counts of words of one length, each in its own language."""
    found = lookups(body, table)
    count, length = body.shape
    own = [None if f is None else p[f, lang[:, None]] for f in found]
    ks = [k for k, f in enumerate(found, 1) if f is not None]
    a = np.zeros((length + 1, count))
    b = np.zeros((length + 1, count))
    a[0] = b[length] = 1
    for j in range(1, length + 1):
        for k in (k for k in ks if k <= j):
            a[j] += a[j - k] * own[k - 1][:, j - k]
    for i in range(length - 1, -1, -1):
        for k in (k for k in ks if k <= length - i):
            b[i] += own[k - 1][:, i] * b[i + k]
    weight = n / a[length]
    for k in ks:
        m = length - k + 1
        share = a[:m].T * own[k - 1] * b[k:].T * weight[:, None]
        np.add.at(total, (found[k - 1].ravel(), np.repeat(lang, m)), share.ravel())


def _log_expected(body, lang, n, table: Pieces, logs: np.ndarray, total: np.ndarray) -> None:
    """:func:`_expected` by logarithms."""
    found = lookups(body, table)
    count, length = body.shape
    own = [None if f is None else logs[f, lang[:, None]] for f in found]
    ends = _any_hit(found, table.n)
    a, b = np.zeros((length + 1, count)), np.zeros((length + 1, count))
    for j in range(1, length + 1):
        a[j] = _log_sum([a[j - k] + own[k - 1][:, j - k] for k in ends[j]])
    starts: list[list[int]] = [[] for _ in range(length + 1)]
    for j, ks in enumerate(ends):
        for k in ks:
            starts[j - k].append(k)
    for i in range(length - 1, -1, -1):
        b[i] = _log_sum([own[k - 1][:, i] + b[i + k] for k in starts[i]])
        for k in starts[i]:
            share = n * np.exp(a[i] + own[k - 1][:, i] + b[i + k] - a[length])
            np.add.at(total, (found[k - 1][:, i], lang), share)


def score_languages(docs: DataFrame, langs: list[str], shares: np.ndarray, pieces: list[bytes], prob: np.ndarray,
                    keep: list[str]) -> DataFrame:
    """The columns ``keep``, lang_pred and score (the posterior of the prediction)."""
    shared = docs.sparkSession.sparkContext.broadcast((Pieces(pieces), prob))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, prob = shared.value
        p, logs = scaled(prob, table.size), logarithms(prob)
        for batch in batches:
            for rows, raw, offsets in slices(batch, "text", SLICE):
                n = rows.num_rows
                total = np.tile(shares, (n, 1))
                v = Vocabulary(raw, offsets)
                if langs and len(v.form):
                    each = np.zeros((len(v.forms), len(langs)))
                    start, end = v.start[v.first], v.end[v.first]
                    for own, body in by_length(start, end, v.raw):
                        found = lookups(body, table)
                        if body.shape[1] <= PLAIN + 1:
                            each[own] = np.log(forward(found, p)[-1]) - body.shape[1] * np.log(_SCALE)
                        else:
                            each[own] = log_forward(found, logs)[-1]
                    for j in range(len(langs)):
                        total[:, j] += np.bincount(v.row, each[v.form, j], n)
                # ASCII letters show in the bytes; only other texts are looked at again.
                ascii_ = np.concatenate([[0], np.cumsum(~_GAP[raw] & (raw < 128))])
                letters = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
                for i in np.flatnonzero(~letters & (offsets[1:] > offsets[:-1])).tolist():
                    letters[i] = has_letter(rows.column("text")[i].as_py())
                if langs:
                    best = total.argmax(axis=1)
                    sure = 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(axis=1)
                    name = np.where(letters, np.array(langs, dtype=object)[best], "und")
                    sure = np.where(letters, sure, 0.0)
                else:
                    name, sure = np.full(n, "und", dtype=object), np.zeros(n)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(name, pa.string()),
                                                  pa.array(sure)], names=[*keep, "lang_pred", "score"])
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify_languages(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", sample: int = SAMPLE, turns: int = TURNS) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score."""
    pieces = read_pieces(path)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                     F.col(lang_col).alias("lang")).withColumn("held_out", held_out(F.col("id"), 3, 1))
    langs, shares, prob = train(
        docs.where("not held_out and id is not null and lang is not null").select("id", "lang", "text"),
        pieces, sample, turns)
    return score_languages(docs, langs, shares, pieces, prob, ["id", "held_out"]).withColumnRenamed("id", id_col)
