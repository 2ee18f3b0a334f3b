"""Byte-level BPE encoding and decoding through a distinct-word table.

A byte-level BPE file (``tokenizers`` JSON) splits text into words first; merges
never cross a word's end. So each distinct word is encoded once:

1. ``split_rows``: Spark tasks split their texts into words. A block is a run of a
   partition's rows with about ``BLOCK_BYTES`` of text. It gives one row with its
   word numbers by position, and its distinct words in rows by word bucket.
2. ``encoded_rows``: rows are shuffled by word bucket; a word's rows of all blocks
   meet, it is encoded once, and its ids go back to each (block, number). The
   positions travel along, so that texts are read and split a single time.
3. ``bpe_encode``: rows are shuffled by block; word numbers are joined with their
   ids, position by position. What a task holds is bounded by the block, and by
   the words of one bucket; buckets grow with ``spark.sql.shuffle.partitions``.
4. ``bpe_decode``: ids are joined with the vocabulary's id-to-piece table (a fixed
   vocabulary, about 0.5 MB) and the pieces' bytes are put together.

Words of texts whose characters are ASCII or Latin letters are split by their byte
classes, all texts of a slice at once; other texts by the library's own splitter.
Added tokens (such as an end-of-text mark) inside a text are one word, as in the
library. Within a block, words are told apart by 64-bit hashes.

Defined cases: NULL is empty text, without ids; NULL ids and repeated rows are
kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, span_hashes

BLOCK_BYTES = 32 << 20
BUCKETS = 2  # word buckets per shuffle partition

# Byte classes of the public splitting pattern: white space, letters, digits, rest.
_SPACE, _LETTER, _DIGIT, _REST = 0, 1, 2, 3
_CLASS = np.full(256, _REST, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CONTRACTIONS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")
# Texts with any other character are split by the library (tested over all of these).
_OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ʯ]")
_loaded: dict[str, "ByteBpe"] = {}


class ByteBpe:
    """A byte-level BPE vocabulary, from the text of its JSON file."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer
        spec = json.loads(text)
        pre = spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        if (spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or not plain):
            raise ValueError("a byte-level BPE file without normaliser or prefix space is needed")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    @classmethod
    def of(cls, text: str) -> ByteBpe:
        if text not in _loaded:
            _loaded.clear()
            _loaded[text] = cls(text)
        return _loaded[text]

    def unusual(self, text: str) -> bool:
        return bool(_OTHER.search(text) or (self.added is not None and self.added.search(text)))

    def words(self, text: str) -> list[str]:
        """A text's words, by the library."""
        parts = [text] if self.added is None else self.added.split(text)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return [w for i, part in enumerate(parts)
                for w in ([part] if i % 2 else [part[a:b] for _, (a, b) in split(part)])]

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def starts(self, raw: np.ndarray, offsets: np.ndarray, texts: list[str]) -> np.ndarray:
        """First bytes of all words; words tile their texts."""
        begin = word_starts(raw, offsets)
        odd = [i for i, t in enumerate(texts) if t and self.unusual(t)]
        for i in odd:
            a, b = int(offsets[i]), int(offsets[i + 1])
            size = np.array([len(w.encode()) for w in self.words(texts[i])], np.int64)
            begin[a:b] = False
            begin[a + np.cumsum(size) - size] = True
        return np.flatnonzero(begin)


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a word starts at each byte, for texts of ASCII and letters.

    A word is a run of one class with one blank before it, if there is one; of white
    space before a word, the last character stands apart (or is that blank)."""
    n = len(raw)
    kind = _CLASS[raw]
    edge = np.zeros(n, bool)  # a text's first byte
    edge[offsets[:-1][offsets[:-1] < n]] = True
    begin = edge.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # White space right before a word of the same text, and words after a blank.
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~edge[1:]
    after = np.zeros(n, bool)
    after[1:] = before[:-1] & (raw[:-1] == 0x20)
    begin = (begin | before) & ~after
    marks = np.flatnonzero(begin & (raw == ord("'")))
    if len(marks):
        ends = offsets[np.searchsorted(offsets, marks, "right")]
        body = raw.tobytes()
        for at, end in zip(marks.tolist(), ends.tolist()):
            for c in _CONTRACTIONS:
                if body.startswith(c, at) and at + len(c) <= end:
                    begin[at + 1:at + len(c)] = False
                    if at + len(c) < end and kind[at + len(c)] == _LETTER:
                        begin[at + len(c)] = True
                    break
    return begin


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def pieces(vocabulary: str) -> list[bytes]:
    """The bytes of each id (ids without a piece: none)."""
    spec = json.loads(vocabulary)
    # Byte-level files write a byte as a printable character: itself where that is
    # printable Latin-1, else the next free character from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    table = {i: bytes(back[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def _gather(flat: np.ndarray, heads: np.ndarray, sizes: np.ndarray, which: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat`` one after another, and their ends (from 0)."""
    n = sizes[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(ends[-1]) + np.repeat(heads[which] - ends[:-1], n)], ends


def _squeeze(values: np.ndarray, far: bool = False) -> bytes:
    """32-bit numbers as zstd: their low halves, then their high halves, which are
    mostly zero (frequent words have small numbers). ``far``: repetitions are looked
    for over the whole of it (copies of texts in a block)."""
    halves = np.ascontiguousarray(values, np.uint32).view("<u2").reshape(-1, 2).T.tobytes()
    how = zstandard.ZstdCompressionParameters.from_level(6 if far else 3, enable_ldm=far)
    return zstandard.ZstdCompressor(compression_params=how).compress(halves)


def _numbers(packed: bytes) -> np.ndarray:
    halves = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u2")
    return np.ascontiguousarray(halves.reshape(2, -1).T).view(np.uint32).ravel()


# Positions: words (how many distinct ones), ids and sizes of documents, numbers by
# position. A bucket's words: words, their sizes, numbers and bytes.
_SCHEMA = "key long, block long, words long, id array<long>, sizes binary, numbers binary, body binary"
_ARROW = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("words", pa.int64()),
                    ("id", pa.list_(pa.int64())), ("sizes", pa.binary()), ("numbers", pa.binary()),
                    ("body", pa.binary())])


def _row(key, block, words, ids, sizes, numbers, body) -> pa.RecordBatch:
    values = (key, block, words, ids, sizes, numbers, body)
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW)], schema=_ARROW)


class _Block:
    """Texts of a block as they come: their words' hashes by position, and the bytes
    of distinct words."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.codes, self.seen, self.bodies, self.lengths, self.ids, self.sizes = [], [], [], [], [], []

    def add(self, ids: list, raw: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> None:
        end = np.append(start[1:], len(raw))
        found, first, code = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        body, _ = _gather(raw, start, end - start, first)
        self.codes.append(code.astype(np.uint32))
        self.seen.append(found)
        self.bodies.append(body)
        self.lengths.append((end - start)[first])
        self.ids += ids
        self.sizes.append(np.diff(np.searchsorted(start, offsets)))
        self.bytes += len(raw)

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        names, first, number = np.unique(np.concatenate(self.seen), return_index=True, return_inverse=True)
        lengths = np.concatenate(self.lengths)[first]
        heads = (np.cumsum(np.concatenate(self.lengths)) - np.concatenate(self.lengths))[first]
        flat = np.concatenate(self.bodies)
        ends = np.cumsum([len(s) for s in self.seen]).tolist()
        runs = list(zip(self.seen, self.codes, ends))
        # Words are numbered by falling frequency in the block: what most positions
        # hold are small numbers, which compress well.
        times = np.zeros(len(names), np.int64)
        for seen, codes, end in runs:
            times[number[end - len(seen):end]] += np.bincount(codes, minlength=len(seen))
        place = np.empty(len(names), np.uint32)
        place[np.argsort(-times, kind="stable")] = np.arange(len(names), dtype=np.uint32)
        rank = place[number]
        codes = np.concatenate([rank[end - len(seen):end][c] for seen, c, end in runs])
        # Positions have a negative key: any partition will do on their first way.
        yield _row(-1 - self.number, self.number, len(names), self.ids, _squeeze(np.concatenate(self.sizes)),
                   _squeeze(codes, far=True), None)
        # A bucket's words travel in the order of the alphabet, nearly: neighbours compress well.
        bucket = (names % np.uint64(buckets)).astype(np.int64)  # equal words, equal hashes
        padded = np.concatenate([flat, np.zeros(8, np.uint8)])
        at = np.arange(8)
        letters = np.where(at < lengths[:, None], padded[heads[:, None] + at], 0).astype(np.uint8)
        order = np.lexsort((letters.view(">u8").ravel(), bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[b]:cuts[b + 1]]
            body, _ = _gather(flat, heads, lengths, own)
            yield _row(b, self.number, len(own), None, _squeeze(lengths[own]), _squeeze(place[own]),
                       zip_.compress(body.tobytes()))


def split_rows(docs: DataFrame, vocabulary, limit: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """Rows of positions (key < 0) and of distinct words (key: their bucket)."""
    if buckets is None:
        buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(vocabulary.value)
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for rows, raw, offsets in slices(batch, "text"):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                block.add(rows.column("id").to_pylist(), raw, offsets, bpe.starts(raw, offsets, texts))
                if block.bytes >= limit:
                    yield from block.rows(buckets)
                    block = _Block(block.number + 1)
        if block.ids:
            yield from block.rows(buckets)
    return docs.mapInArrow(run, _SCHEMA)


def encoded_rows(rows: DataFrame, vocabulary) -> DataFrame:
    """Words replaced by their ids: each word of a bucket is encoded once."""
    def run(group: pa.Table) -> pa.Table:
        if group.column("key")[0].as_py() < 0:
            return group
        unzip = zstandard.ZstdDecompressor()
        table: dict[bytes, int] = {}
        lists = []
        for row in group.select(["sizes", "body"]).to_pylist():
            ends = np.cumsum(_numbers(row["sizes"]), dtype=np.int64).tolist()
            body = unzip.decompress(row["body"])
            words = [body[a:b] for a, b in zip([0, *ends], ends)]
            lists.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words)))
        ids = ByteBpe.of(vocabulary.value).encode([w.decode() for w in table])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for w in ids for i in w), np.uint32, int(sizes.sum()))
        heads = np.cumsum(sizes) - sizes
        new_sizes = [_squeeze(sizes[which]) for which in lists]
        new_body = [_squeeze(_gather(flat, heads, sizes, which)[0]) for which in lists]
        return (group.set_column(4, "sizes", pa.array(new_sizes, pa.binary()))
                .set_column(6, "body", pa.array(new_body, pa.binary())))
    return rows.groupBy("key").applyInArrow(run, _SCHEMA)


def _place(group: pa.Table, table: tuple[np.ndarray, np.ndarray] | None = None) -> pa.Table:
    """Ids of a block's documents: word numbers replaced by the words' ids. With the
    id-to-piece table, their decoded texts as well."""
    rows = group.to_pylist()
    lists = [r for r in rows if r["key"] >= 0]
    listed = np.concatenate([np.zeros(0, np.uint32), *(_numbers(r["sizes"]) for r in lists)]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *(_numbers(r["body"]) for r in lists)]).astype(np.int32)
    number = np.concatenate([np.zeros(0, np.uint32), *(_numbers(r["numbers"]) for r in lists)])
    size, heads = np.zeros_like(listed), np.zeros_like(listed)
    size[number], heads[number] = listed, np.cumsum(listed) - listed
    out = []
    for row in (r for r in rows if r["key"] < 0):
        if row["words"] != len(size):
            raise RuntimeError("a block's words are not all encoded")
        codes = _numbers(row["numbers"])
        ends = np.concatenate([[0], np.cumsum(_numbers(row["sizes"]), dtype=np.int64)])
        for at in range(0, len(row["id"]), 500):  # documents put together at a time
            to = min(at + 500, len(row["id"]))
            ids, stops = _gather(flat, heads, size, codes[ends[at]:ends[to]])
            cuts = stops[ends[at:to + 1] - ends[at]].astype(np.int32)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(row["id"][at:to], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))], names=["id", "ids"])
            out.append(batch if table is None else _decoded(batch, *table))
    fields = [("id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("text", pa.string())] * (table is not None)
    return pa.Table.from_batches(out, schema=pa.schema(fields))


def _decoded(batch: pa.RecordBatch, flat: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """The batch with ``text``: its ids joined with the pieces (bytes, sizes)."""
    ids = batch.column("ids")
    ends = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()), dtype=np.int64)])
    raw, stops = _gather(flat, np.cumsum(sizes) - sizes, sizes, np.asarray(ids.flatten()).astype(np.int64))
    body, cuts = raw.tobytes(), stops[ends].tolist()
    texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
    return batch.append_column("text", pa.array(texts, pa.string()))


def _piece_table(df: DataFrame, path: str):
    table = pieces(read_vocabulary(path))
    sizes = np.array([len(p) for p in table], np.int64)
    return df.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(table), np.uint8), sizes))


def _encoded(df: DataFrame, path: str, id_col: str, text_col: str, limit: int, buckets: int | None) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    return encoded_rows(split_rows(docs, vocabulary, limit, buckets), vocabulary)


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
               limit: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """One row per input row: id and ``ids``, its tokens' ids in order."""
    rows = _encoded(df, path, id_col, text_col, limit, buckets)

    def place(group: pa.Table) -> pa.Table:
        return _place(group)
    return rows.groupBy("block").applyInArrow(place, "id long, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``encoded`` (id, ids) with the decoded text."""
    shared = _piece_table(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                yield _decoded(whole.slice(at, 1000), *shared.value)
    out = encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, "id long, ids array<int>, text string")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   limit: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """``bpe_decode(bpe_encode(df))`` with both joins in one task per block, so that an
    executor runs one Python worker per core and ids pass through it once."""
    rows, shared = _encoded(df, path, id_col, text_col, limit, buckets), _piece_table(df, path)

    def place(group: pa.Table) -> pa.Table:
        return _place(group, shared.value)
    out = rows.groupBy("block").applyInArrow(place, "id long, ids array<int>, text string")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def bpe_digest(decoded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns, from ``bpe_decode``."""
    return decoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(text_col), 256).alias("decoded_sha256"))
