"""Quality classifier: random Fourier features, ridge, isotonic calibration.

1. ``document_statistics``: one pass over the texts gives each document a short
   vector of statistics (lengths, character classes, repetition, lines). The
   vectors are cut; texts are not read again.
2. Random Fourier features cos(Wx + b) of the standardised vector approximate a
   Gaussian kernel (fixed seed). Per task the normal equations Z'Z and Z'y are
   summed, then added up by Spark, row block by row block: FEATURES numbers square,
   whatever the number of documents. The ridge system is solved on the driver.
3. Isotonic calibration: scores of training documents left out of the ridge fit are
   counted in ``BINS`` bins by label; pooling adjacent violators over the bins gives
   a monotone map from score to probability.

Every labelled training row is used; nothing is sampled. Defined cases: NULL or
empty text has statistics of zero and is scored as any other; rows with a NULL id
are scored and never learned from; repeated rows are each scored; with no labels,
or labels of one class only, the score is the share of that class (0.5 if there are
none); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import cut
from ._text import Words, gram_hashes, slices

FEATURES = 256
WIDTH = 1.5  # kernel width, in standard deviations times the root of the dimension
RIDGE = 1e-3
BINS = 1000
THRESHOLD = 0.3
SEED = 20240607
CALIBRATION_FOLDS = 4  # one of so many training folds calibrates
_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789",
    "blank": b" \t\n\r\x0b\x0c", "line": b"\n", "stop": b".,;:?", "bang": b"!", "pipe": b"|",
    "symbol": b"#$%&*+/<=>@\\^_`{}~[]()\"'-", "high": bytes(range(0xC0, 0x100)), "cont": bytes(range(0x80, 0xC0))}
_TABLE = np.zeros((256, len(_CLASSES)), np.float32)
for _j, _bytes in enumerate(_CLASSES.values()):
    _TABLE[list(_bytes), _j] = 1
NAMES = [*_CLASSES, "log_chars", "log_words", "word_length", "word_spread", "distinct", "adjacent", "grams",
         "line_length", "same_lines", "end_symbol", "end_stop", "upper_words"]


def _share(marks: np.ndarray, row: np.ndarray, n: int, of: np.ndarray) -> np.ndarray:
    return np.bincount(row, marks, n) / np.maximum(of, 1)


def _distinct(codes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Number of different codes of each row."""
    if not len(codes):
        return np.zeros(n)
    order = np.lexsort((codes, row))
    c, r = codes[order], row[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (r[1:] != r[:-1])])
    return np.bincount(r[new], minlength=n)


def text_statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics (NAMES) per text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    at = offsets.tolist()
    kinds = np.stack([np.bincount(raw[a:b], minlength=256) for a, b in zip(at, at[1:])]) @ _TABLE
    words = Words(raw, offsets, lower=True)
    h = words.hashes()
    length = (words.end - words.start).astype(float)
    mean = _share(length, words.row, n, words.count)
    spread = np.sqrt(_share((length - mean[words.row]) ** 2, words.row, n, words.count))
    grams, at = gram_hashes(h, words.row, 3)
    rows = words.row[at]
    n_grams = np.bincount(rows, minlength=n)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
    last = words.raw[words.end - 1] if len(h) else np.zeros(0, np.uint8)
    symbol = np.isin(last, np.frombuffer(b"!|#$%&*+=@~^", np.uint8))
    stop = np.isin(last, np.frombuffer(b".,;:?", np.uint8))
    initial = raw[words.start] if len(h) else last
    big = (initial >= 65) & (initial <= 90) & (length > 1) & (raw[words.end - 1] >= 65) & (raw[words.end - 1] <= 90) \
        if len(h) else np.zeros(0, bool)
    line_gap = np.zeros(256, bool)
    line_gap[10] = True
    lines = Words(raw, offsets, space=line_gap)
    n_lines = lines.count
    cols = [*(kinds / np.maximum(size, 1)[:, None]).T, np.log1p(size), np.log1p(words.count), mean, spread,
            _distinct(h, words.row, n) / np.maximum(words.count, 1), _share(same, words.row, n, words.count),
            1 - _distinct(grams, rows, n) / np.maximum(n_grams, 1), np.log1p(size / np.maximum(n_lines, 1)),
            1 - _distinct(lines.hashes(), lines.row, n) / np.maximum(n_lines, 1),
            _share(symbol, words.row, n, words.count), _share(stop, words.row, n, words.count),
            _share(big, words.row, n, words.count)]
    out = np.stack(cols, axis=1)
    out[size == 0] = 0
    return out


def document_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``x``, the statistics of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in slices(batch, text_col):
                x = text_statistics(raw, offsets).astype(np.float32)
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in keep), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))],
                    names=[*keep, "x"])
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, text_col).mapInArrow(run, f"{schema}, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(float)


class Model:
    """Standardisation, feature map, ridge weights and calibration steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH,
                 seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / (width * np.sqrt(d)), (d, features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + 1)
        self.edges, self.steps = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([f, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.beta, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # The calibrated value; a thousandth of the raw score orders documents of one step.
        return 0.999 * np.interp(raw, self.edges, self.steps) + 0.001 * raw


def normal_equations(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y: summed per task, then by blocks of rows over all tasks."""
    size = len(model.beta)
    block = 32

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.features(_matrix(batch.column("x")))
            y = batch.column("y").to_numpy(zero_copy_only=False)
            total += z.T @ np.concatenate([z, y[:, None]], axis=1)
        yield _rows(range(0, size, block), [total[i:i + block].tobytes() for i in range(0, size, block)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, value in zip(batch.column("at").to_pylist(), batch.column("value").to_pylist()):
                sums[at] = sums.get(at, 0) + np.frombuffer(value)
        if sums:
            yield _rows(sums, [v.tobytes() for v in sums.values()])

    def _rows(at, values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), pa.array(values, pa.binary())],
                                          names=["at", "value"])
    out = np.zeros((size, size + 1))
    parts = train.select("x", "y").mapInArrow(part, "at int, value binary")
    for row in parts.repartition("at").mapInArrow(add, "at int, value binary").collect():
        rows = np.frombuffer(row.value).reshape(-1, size + 1)
        out[row.at:row.at + len(rows)] = rows
    return out[:, :-1], out[:, -1]


def isotonic(bins: list[tuple[int, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over (bin, positives, weight) in order: bin places
    and their calibrated values."""
    stack: list[list[float]] = []
    for _, pos, weight in bins:
        stack.append([pos, weight, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            pos, weight, n = stack.pop()
            stack[-1][0] += pos
            stack[-1][1] += weight
            stack[-1][2] += n
    values = np.concatenate([np.full(int(n), pos / weight) for pos, weight, n in stack])
    return np.array([(b + 0.5) / BINS for b, _, _ in bins]), values


def fit(stats: DataFrame, labels: DataFrame, ridge: float = RIDGE) -> Model:
    """A model from ``stats`` (id, x, train) and ``labels`` (id, y)."""
    train = cut(stats.where("train and id is not null").join(labels, "id").select(
        "id", "x", F.col("y").cast("double").alias("y")), "train")
    n, mean_y = train.agg(F.count(F.lit(1)), F.avg("y")).first()
    d = len(NAMES)
    if not n or mean_y in (0, 1):
        model = Model(np.zeros(d), np.ones(d))
        model.steps = np.full(2, 0.5 if not n else mean_y)
        return model
    moments = train.select([f(F.get("x", F.lit(j))).alias(f"{name}{j}") for j in range(d)
                            for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scale = np.array([moments[f"s{j}"] for j in range(d)])
    model = Model(np.array([moments[f"m{j}"] for j in range(d)]), np.where(scale > 1e-9, scale, 1.0))
    apart = F.pmod(F.xxhash64("id"), F.lit(CALIBRATION_FOLDS)) == 0
    gram, target = normal_equations(train.where(~apart), model)
    model.beta = np.linalg.solve(gram + ridge * max(1.0, gram[-1, -1]) * np.eye(len(gram)), target)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.minimum(BINS - 1, (model.raw(_matrix(batch.column("x"))) * BINS).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["bin", "y"])
    counted = (train.where(apart).select("x", "y").mapInArrow(place, "bin int, y double")
               .groupBy("bin").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).collect())  # <= BINS rows
    bins = sorted((r.bin, float(r.pos), float(r.n)) for r in counted)
    if bins:
        model.edges, model.steps = isotonic(bins)
    return model


def scored(stats: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``stats`` and ``score``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(model.score(_matrix(batch.column("x"))))],
                names=[*keep, "score"])
    kinds = dict(stats.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return stats.select(*keep, "x").mapInArrow(run, f"{schema}, score double")


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fitted(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str
           ) -> tuple[DataFrame, Model]:
    """(id, held_out, x) of every row, cut, and the model learned from them."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stats = cut(document_statistics(docs, ["id"]), "statistics").withColumn("held_out", held_out(F.col("id")))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where("y in (0, 1)")
    return stats, fit(stats.withColumn("train", ~F.col("held_out")), known)


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1) and predicted (1 if the
    score reaches the threshold)."""
    stats, model = fitted(df, labels, id_col, text_col, label_col)
    out = scored(stats, model, ["id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` predicted to be good, with all their columns: texts are
    scored again where they are read, so that none is shuffled."""
    _, model = fitted(df, labels, id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in slices(batch, text_col):
                good = model.score(text_statistics(raw, offsets).astype(np.float32).astype(float)) >= threshold
                yield rows.filter(pa.array(good))
    return df.mapInArrow(run, df.schema)
