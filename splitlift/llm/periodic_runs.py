"""Runs of periodic words by block convolution at dyadic scales.

A run is a stretch of words with smallest period q, at least ``max(6, 4 q)`` words
long, that no neighbouring word extends with period q. Scale L = 1, 2, 4, ... looks
for periods L <= q < 2 L. The words are cut into blocks of L; a run of such a period
holds at least two whole blocks that occur again q words further on. For each block,

    D(d) = sum (block[i] - following[i + d])^2 = sum block^2 + sum following^2 - 2 block * following

is computed for all d of the scale at once, the product by a number-theoretic
transform modulo 998244353. D is 0 wherever the block occurs, whatever the modulus;
a distance whose D is 0 only by the modulus fails the comparison that follows. Blocks
in a row that agree on a distance seed a run, whose ends are then found by comparing
words.

Two exact rules keep the transforms few: a block can occur again within the scale only
if each of its words does, and a block inside a run of a smaller period (with the
window behind it) can only yield multiples of that period. Blocks are at most ``BLOCK``
words long; scales beyond that look at their windows piece by piece, so memory is
bounded by the text, not by its square.

Short texts are handled many at a time: a word of one text never equals a word of
another, and a mark that equals nothing lies between two texts.

Defined cases: NULL and empty texts have no words, no runs and an empty collapsed
text; repeated rows and NULL ids each give their own row; only the two named columns
are read. A word covered by any run is dropped unless it is among that run's first q
words and in no other run's rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A prime with roots of unity of order 2^23, and a primitive root of it.
PRIME, ROOT = 998_244_353, 3
BLOCK = 1 << 15
CHUNK_WORDS = 1 << 16  # texts handled together; a longer text is handled alone
CELLS = 1 << 18  # numbers in one batch of transforms
LEAST, COPIES = 6, 4

_twiddles: dict[tuple[int, bool], np.ndarray] = {}


def _roots(size: int, inverse: bool) -> np.ndarray:
    """The first size / 2 powers of a root of unity of that order."""
    if (size, inverse) not in _twiddles:
        root = pow(ROOT, (PRIME - 1) // size, PRIME)
        if inverse:
            root = pow(root, PRIME - 2, PRIME)
        out = np.ones(1, np.int64)
        while len(out) < size // 2:
            out = np.concatenate([out, out * pow(root, len(out), PRIME) % PRIME])
        _twiddles[size, inverse] = out
    return _twiddles[size, inverse]


def ntt(rows: np.ndarray) -> np.ndarray:
    """Transforms of the rows (their length a power of two), in bit-reversed order."""
    a, n = rows % PRIME, rows.shape[1]
    half = n // 2
    while half:
        a = a.reshape(len(rows), -1, 2, half)
        u, v = a[:, :, 0], a[:, :, 1]
        a = np.stack([(u + v) % PRIME, (u - v) * _roots(2 * half, False) % PRIME], axis=2)
        half //= 2
    return a.reshape(len(rows), n)


def inverse_ntt(rows: np.ndarray) -> np.ndarray:
    """Undoes :func:`ntt`."""
    a, n, half = rows, rows.shape[1], 1
    while half < n:
        a = a.reshape(len(rows), -1, 2, half)
        u, v = a[:, :, 0], a[:, :, 1] * _roots(2 * half, True) % PRIME
        a = np.stack([(u + v) % PRIME, (u - v) % PRIME], axis=2)
        half *= 2
    return a.reshape(len(rows), n) * pow(n, PRIME - 2, PRIME) % PRIME


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) where a row's block (b words) may equal its window (2 b words) at
    an offset below b: all places where the sum of squared differences is 0."""
    m, b = blocks.shape
    turned = np.zeros_like(windows)
    turned[:, 0] = blocks[:, 0]
    turned[:, b + 1:] = blocks[:, :0:-1]
    product = inverse_ntt(ntt(turned) * ntt(windows) % PRIME)[:, :b]
    square = np.cumsum(windows * windows % PRIME, axis=1)
    inside = square[:, b - 1:2 * b - 1].copy()
    inside[:, 1:] -= square[:, :b - 1]
    own = (blocks * blocks % PRIME).sum(axis=1)
    return np.nonzero((own[:, None] + inside - 2 * product) % PRIME == 0)


def _needed(period: int) -> int:
    """Words of a run of that period that equal the word a period further on."""
    return max(LEAST, COPIES * period) - period


def _smallest(ids: np.ndarray, start: int, stop: int, period: int) -> bool:
    """Whether no divisor of ``period`` is a period of the stretch too."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor:
            factor += 1
            continue
        q = period // factor
        if np.array_equal(ids[start:stop - q], ids[start + q:stop]):
            return False
        while rest % factor == 0:
            rest //= factor
    return True


def next_gaps(ids: np.ndarray) -> np.ndarray:
    """Distance from each word to its next occurrence (a large number without one)."""
    gap = np.full(len(ids), np.iinfo(np.int64).max)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _seeds(ids: np.ndarray, blocks: np.ndarray, b: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of the blocks' occurrences at distances of the scale."""
    found = []
    step = max(1, CELLS // (2 * b))
    for part in (blocks[k:k + step] for k in range(0, len(blocks), step)):
        own = ids[part[:, None] * b + np.arange(b)]
        for far in range(scale, 2 * scale, b):
            at = part[:, None] * b + far + np.arange(2 * b)
            windows = np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], PRIME - 1)
            row, offset = zero_mismatches(own, windows)
            found.append((part[row], offset + far))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def find_runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``ids`` (numbers from 0 that stand for
    words), by start and period. ``longest``: words of the longest text in it."""
    runs: list[tuple[int, int, int]] = []
    gap = next_gaps(ids)
    scale = b = 1
    while COPIES * scale <= longest:
        count = len(ids) // b
        if b == scale and b > 1:  # the largest gap of each block, from those of its halves
            gap = np.maximum(gap[:2 * count:2], gap[1:2 * count:2])
        live = gap[:count] < 2 * scale
        neighbour = np.zeros(count + 2, bool)
        neighbour[1:-1] = live
        live &= neighbour[:-2] | neighbour[2:]
        # Per block, the end and the period of a run of a smaller period that holds it.
        held, period = np.zeros(count, np.int64), np.ones(count, np.int64)
        for start, length, q in runs:
            if q <= b:
                first, last = -(-start // b), (start + length) // b
                longer = held[first:last] < start + length
                held[first:last][longer] = start + length
                period[first:last][longer] = q
        live &= held < np.arange(count) * b + 2 * scale + b
        blocks = np.flatnonzero(live)
        if len(blocks):
            block, distance = _seeds(ids, blocks, b, scale)
            known = (block * b + distance <= held[block]) & (distance % period[block] == 0)
            runs += _extend(ids, block[~known], distance[~known], b)
        scale *= 2
        b = min(scale, BLOCK)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _extend(ids: np.ndarray, block: np.ndarray, distance: np.ndarray, b: int) -> list[tuple[int, int, int]]:
    """Runs around the seeds: blocks in a row with one distance are compared word by
    word, with a block's length on both sides."""
    if not len(block):
        return []
    order = np.lexsort((block, distance))
    block, distance = block[order], distance[order]
    opens = np.flatnonzero(np.r_[True, (np.diff(block) != 1) | (np.diff(distance) != 0)])
    sizes = np.diff(np.r_[opens, len(block)])
    out = set()
    for k, size in zip(opens.tolist(), sizes.tolist()):
        d, first = int(distance[k]), int(block[k]) * b
        if size < max(1, (_needed(d) + 1) // b - 1):
            continue
        low, high = max(0, first - b), min(len(ids) - d, first + (size + 1) * b)
        equal = np.zeros(high - low + 2, bool)
        equal[1:-1] = ids[low:high] == ids[low + d:high + d]
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        for start, stop in zip((edges[::2] + low).tolist(), (edges[1::2] + low).tolist()):
            cut = start == low > 0 or stop == high < len(ids) - d
            if not cut and stop - start >= _needed(d) and _smallest(ids, start, stop + d, d):
                out.add((start, stop + d - start, d))
    return list(out)


def text_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, given as its words."""
    ids, firsts = [], []
    fresh = 0
    for words in texts:
        firsts.append(len(ids))
        known: dict[bytes, int] = {}
        ids += [known.setdefault(w, fresh + len(known)) for w in words]
        fresh += len(known)
        ids.append(fresh)  # the mark behind a text
        fresh += 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not ids:
        return out
    runs = find_runs(np.array(ids, np.int64), max(map(len, texts)))
    owner = np.searchsorted(firsts, [r[0] for r in runs], "right") - 1
    for k, (start, length, q) in zip(owner.tolist(), runs):
        out[k].append((start - firsts[k], length, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what any run repeats after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist()) if k])


RUNS = "array<struct<start: long, length: long, period: long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, ``runs`` (start, length, period in words, by
    start and period) and ``collapsed``, the text without the repetitions."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    id_type = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _chunks(batch):
                runs = text_runs(texts)
                out = [[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(map(len, texts), pa.int64()), pa.array(out, _RUNS),
                     pa.array(map(collapse, texts, runs), pa.binary())],
                    names=["id", "n_words", "runs", "collapsed"])
    return (rows.mapInArrow(run, f"id {id_type}, n_words long, runs {RUNS}, collapsed binary")
            .select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed")))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[list[bytes]]]]:
    """Ids and words (bytes between white space) of rows with about CHUNK_WORDS words."""
    first, texts, size = 0, [], 0
    for k, text in enumerate(batch.column("t")):
        texts.append(text.as_py().split())
        size += len(texts[-1])
        if size >= CHUNK_WORDS or k + 1 == batch.num_rows:
            yield batch.column("id").slice(first, len(texts)), texts
            first, texts, size = k + 1, [], 0


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the texts of one document in ten end in a loop, others are unchanged.

    With h = crc32 of the id as decimal text and g = floor(h / 10): where h % 10 = 0
    and there are n > 0 words, those from a = g % n on become repetitions of the p words
    at a, p = 1 + floor((n - a) / (3 + g % 8)). A NULL id changes nothing."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col), F.col(text_col), F.floor(h / 10).alias("g"),
                       F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("g") % 8))).cast("int")
    rows = rows.select(id_col, text_col, "words", F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    loop = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    looped = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(loop, F.lit(1), n - F.col("a")))
    return rows.select(id_col, F.when(F.col("a").isNotNull(), F.array_join(looped, " "))
                       .otherwise(F.col(text_col)).alias(text_col))


def runs_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and digests."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select(id_col, "n_words", "runs", "collapsed", longest.alias("top"), lines.alias("lines"))
    length = -F.col("top.less")
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"),
        F.col("top.period").alias("period"),
        F.floor(F.lit(1000) * length / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
