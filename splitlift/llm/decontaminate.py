"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and non-ASCII characters, lower-cased. A
benchmark item and a document are compared by greedy string tiling: of all common
token runs of ``MIN_MATCH`` tokens or more, the longest that overlaps no tile yet
becomes a tile, again and again. Tiles may lie in any order, so a passage whose
sentences were shuffled is still covered. A document is contaminated by an item
when tiles cover ``COVERAGE`` of the item's tokens.

1. The benchmark's seeds - Karp-Rabin hashes of its runs of MIN_MATCH tokens - are
   counted, and a Bloom filter of BITS_PER_SEED bits or more for each is built by Spark,
   segment by segment. It is the one thing broadcast, 128 MB at most: with 33 million
   seeds or fewer under one seed in 100,000 passes by chance. More seeds give the same
   results with more documents let through to the join.
2. One scan hashes the runs of all documents and keeps those whose bits are set; only
   documents with such seeds are written, with their token hashes.
3. Seeds of documents and items are joined, by lanes, since a seed may lie in any share
   of all documents; pairs that share enough of them for the
   coverage to be possible are tiled, each pair a row of its own, in Arrow batches.

Defined cases: an item of 1 to MIN_MATCH - 1 tokens is one seed of its whole length
(and needs that run in full); items without tokens, and NULL or blank texts, match
nothing; NULL ids are kept; repeated documents are each reported; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut
from ._rows import drop_rows, look_up, row_key
from ._text import U, Words, gram_hashes, mix, slices

MIN_MATCH = 5
COVERAGE = 0.5
BITS_PER_SEED = 32
MIN_POWER, MAX_POWER = 19, 30  # the filter has 2 ** 19 bits (64 KB) to 2 ** 30 (128 MB)
SEGMENT = 1 << 16  # bytes of the filter built together
SEED_PAIRS = 1 << 19  # common seeds of an item and a document looked at together

_GAP = np.ones(256, bool)
_GAP[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = False
_GAP[128:] = False
_BIT = (1 << np.arange(8)).astype(np.uint8)


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    at = batch.schema.get_field_index("text")
    lower = pc.utf8_lower(batch.column(at).cast(pa.large_string()).fill_null(""))
    for rows, raw, offsets in slices(batch.set_column(at, "text", lower), "text"):
        words = Words(raw, offsets, space=_GAP)
        yield rows, words, words.hashes()


def _places(seeds: np.ndarray, power: int, probes: int) -> Iterator[np.ndarray]:
    """A seed's places in the filter, one probe after another."""
    at, step = seeds >> U(64 - power), mix(seeds) | U(1)
    for _ in range(probes):
        yield (at & U((1 << power) - 1)).astype(np.int64)
        at = at + step


def _in_filter(seeds: np.ndarray, table: np.ndarray, power: int, probes: int) -> np.ndarray:
    """Numbers of the seeds whose bits are all set; later probes look at what is left."""
    left = np.arange(len(seeds))
    at, step = seeds >> U(64 - power), None
    for turn in range(probes):
        place = (at & U((1 << power) - 1)).astype(np.int64)
        hit = (table[place >> 3] & _BIT[place & 7]) != 0
        left, at = left[hit], at[hit]
        step = mix(seeds[left]) | U(1) if turn == 0 else step[hit]
        at = at + step
    return left


def _segments(byte: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    """Bytes of the filter as rows of a segment each."""
    no = byte // SEGMENT
    first = np.flatnonzero(np.concatenate([[True], no[1:] != no[:-1]]))
    ends = np.append(first[1:], len(no))
    within = (byte % SEGMENT).astype(np.uint16)
    return pa.RecordBatch.from_arrays(
        [pa.array(no[first]), pa.array([within[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
         pa.array([bits[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], names=["no", "at", "bits"])


def item_tokens(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                min_match: int = MIN_MATCH) -> DataFrame:
    """(item, tokens, need, seeds, times): an item's token hashes, its least match, its
    seeds and how often each occurs in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words, h in _tokens(batch):
                tokens, need, seeds, times = [], [], [], []
                for i in range(rows.num_rows):
                    own = h[words.first[i]:words.first[i + 1]]
                    size = max(1, min(min_match, len(own)))
                    grams, _ = gram_hashes(own, np.zeros(len(own), np.int8), size)
                    tokens.append(own.tobytes())
                    need.append(size)
                    found, n = np.unique(grams, return_counts=True)
                    seeds.append(found.view(np.int64))
                    times.append(n)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("item"), pa.array(tokens, pa.binary()), pa.array(need, pa.int32()),
                     pa.array(seeds, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                    names=["item", "tokens", "need", "seeds", "times"])
    items = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    return items.mapInArrow(run, "item long, tokens binary, need int, seeds array<long>, times array<long>")


def filter_size(seeds: int) -> tuple[int, int]:
    """(bits as a power of two, probes) of a Bloom filter for so many seeds."""
    power = min(MAX_POWER, max(MIN_POWER, (seeds * BITS_PER_SEED - 1).bit_length()))
    return power, max(1, min(8, round(0.69 * 2 ** power / max(seeds, 1))))


def seed_filter(items: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """(bits of all seeds, eight to a byte; probes; lengths of seeds that occur)."""
    counts = items.where("size(seeds) > 0").groupBy("need").agg(F.sum(F.size("seeds")).alias("n")).collect()
    power, probes = filter_size(sum(r.n for r in counts))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = np.asarray(batch.column("seeds").flatten()).view(U)
            if len(seeds):
                at = np.unique(np.concatenate(list(_places(seeds, power, probes))))
                byte = at >> 3
                first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
                yield _segments(byte[first], np.bitwise_or.reduceat(_BIT[at & 7], first))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}  # the segments of this partition, SEGMENT bytes each
        for batch in batches:
            for no, at, bits in zip(*(batch.column(c) for c in ("no", "at", "bits"))):
                table = own.setdefault(no.as_py(), np.zeros(SEGMENT, np.uint8))
                table[np.frombuffer(at.as_py(), np.uint16)] |= np.frombuffer(bits.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()),
                                          pa.array([t.tobytes() for t in own.values()], pa.binary())],
                                         names=["no", "bits"])

    parts = items.select("seeds").mapInArrow(mark, "no long, at binary, bits binary")
    table = np.zeros(max(SEGMENT, 1 << (power - 3)), np.uint8)
    for row in parts.repartition("no").mapInArrow(merge, "no long, bits binary").toLocalIterator():
        table[row.no * SEGMENT:(row.no + 1) * SEGMENT] = np.frombuffer(row.bits, np.uint8)
    return table, probes, sorted(r.need for r in counts)


def seeded_documents(docs: DataFrame, table: np.ndarray, probes: int, lengths: list[int]) -> DataFrame:
    """(dk, id, tokens, seeds) of the documents that may share a seed."""
    shared, power = docs.sparkSession.sparkContext.broadcast(table), (len(table) * 8).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for rows, words, h in _tokens(batch):
                found, owner = [np.zeros(0, U)], [np.zeros(0, np.int64)]
                for size in lengths:
                    grams, at = gram_hashes(h, words.row, size)
                    hit = _in_filter(grams, bits, power, probes)
                    found.append(grams[hit])
                    owner.append(words.row[at[hit]])
                seeds, rows_of = np.concatenate(found), np.concatenate(owner)
                order = np.lexsort((seeds, rows_of))
                seeds, rows_of = seeds[order], rows_of[order]
                first = np.searchsorted(rows_of, np.arange(rows.num_rows + 1))
                some = np.flatnonzero(np.diff(first))
                if len(some):
                    yield pa.RecordBatch.from_arrays([
                        rows.column("dk").take(pa.array(some)), rows.column("id").take(pa.array(some)),
                        pa.array([h[words.first[i]:words.first[i + 1]].tobytes() for i in some], pa.binary()),
                        pa.array([np.unique(seeds[first[i]:first[i + 1]]).view(np.int64) for i in some],
                                 pa.list_(pa.int64()))], names=["dk", "id", "tokens", "seeds"])
    return docs.mapInArrow(run, "dk long, id long, tokens binary, seeds array<long>")


def _match_edges(ga: np.ndarray, gd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the first and of the last common seed of every maximal run of common
    seeds along a diagonal. Seed pairs are looked at some at a time and not kept."""
    order = np.argsort(ga, kind="stable")
    low, high = np.searchsorted(ga[order], gd, "left"), np.searchsorted(ga[order], gd, "right")
    total = np.cumsum(high - low)
    edges: list[list[np.ndarray]] = [[], []]
    at = 0
    while at < len(gd):
        seen = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, seen + SEED_PAIRS, "right")))
        times = (high - low)[at:to]
        j = np.repeat(np.arange(at, to), times)
        within = np.arange(len(j)) - np.repeat(np.cumsum(times) - times, times)
        i = order[np.repeat(low[at:to], times) + within]
        for found, step, last_i, last_j in ((edges[0], -1, 0, 0), (edges[1], 1, len(ga) - 1, len(gd) - 1)):
            edge = (i == last_i) | (j == last_j)
            inner = ~edge
            edge[inner] = ga[i[inner] + step] != gd[j[inner] + step]
            found.append(np.stack([i[edge], j[edge]]))
        at = to
    out = []
    for found in edges:
        i, j = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        by = np.lexsort((i, j - i))
        out.append(np.stack([i[by], j[by]]))
    return out[0], out[1]


def tile(item: np.ndarray, doc: np.ndarray, need: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token hash arrays: (item start, document start,
    length), the longest first; of equal lengths the first in the item, then in the
    document. Memory grows with the matches, not with the pairs of common seeds."""
    ga, _ = gram_hashes(item, np.zeros(len(item), np.int8), need)
    gd, _ = gram_hashes(doc, np.zeros(len(doc), np.int8), need)
    (i, j), (end, _) = _match_edges(ga, gd)
    start, length = np.arange(len(i)), end - i + need
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(length, i[start], j[start])]
    heapq.heapify(heap)
    free_i, free_j = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = free_i[a:a + n] & free_j[b:b + n]
        if free.all():
            free_i[a:a + n] = free_j[b:b + n] = False
            tiles.append((a, b, n))
            if not free_i.any():
                break
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= need:
                heapq.heappush(heap, (-(e - s), a + s, b + s))
    return tiles


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH,
                       coverage: float = COVERAGE) -> DataFrame:
    """One row per (document, item) with enough of the item covered: ids, ``dk`` (a
    key of id and text), n_item, n_covered, coverage, n_tiles, longest, and
    ``in_order`` (whether the tiles lie in the item's order)."""
    items = cut(item_tokens(benchmark, item_col, item_text_col, min_match), "items")
    table, probes, lengths = seed_filter(items)
    texts = docs.select(row_key(id_col, text_col).alias("dk"), F.col(id_col).cast("long").alias("id"),
                        F.col(text_col).alias("text"))
    seeded = cut(seeded_documents(texts, table, probes, lengths).withColumn("uid", F.monotonically_increasing_id()), "seeded")
    # A row per item and seed: items may repeat in the table, so each has a number.
    numbered = cut(items.withColumn("no", F.monotonically_increasing_id()), "items")
    # A tile of L >= need tokens starts a seed at L - need + 1 >= L / need places of the
    # item. Pairs with fewer common places than tiles over `coverage` of the item have
    # are left out before any token travels.
    places = numbered.select("no", "need", (F.octet_length("tokens") / 8).alias("n"),
                             F.explode(F.arrays_zip("seeds", "times")).alias("s"))
    pairs = (look_up(seeded.select("uid", F.explode("seeds").alias("seed")),
                     places.select("no", "need", "n", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times")),
                     "seed", "uid")
             .groupBy("uid", "no", "need", "n").agg(F.sum("times").alias("common"))
             .where(F.col("common") * F.col("need") >= F.col("n") * coverage).select("uid", "no"))
    rows = (pairs.join(seeded.select("uid", "dk", "id", F.col("tokens").alias("doc")), "uid")
            .join(numbered.select("no", "item", "need", "tokens"), "no")
            .select("dk", "id", "doc", "item", "need", "tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in range(batch.num_rows):
                item = np.frombuffer(batch.column("tokens")[r].as_py(), U)
                doc = np.frombuffer(batch.column("doc")[r].as_py(), U)
                tiles = tile(item, doc, batch.column("need")[r].as_py())
                covered = sum(n for _, _, n in tiles)
                if covered and covered >= coverage * len(item):
                    places = [b for _, b, _ in sorted(tiles)]
                    out.append((batch.column("id")[r].as_py(), batch.column("item")[r].as_py(),
                                batch.column("dk")[r].as_py(), len(item), covered, covered / len(item), len(tiles),
                                max(n for _, _, n in tiles), places == sorted(places)))
            columns = list(zip(*out)) if out else [()] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.float64(), pa.int64(),
                                                                                   pa.int64(), pa.bool_()])],
                names=["id", "item", "dk", "n_item", "n_covered", "coverage", "n_tiles", "longest", "in_order"])
    found = rows.mapInArrow(run, "id long, item long, dk long, n_item long, n_covered long, coverage double,"
                                 " n_tiles long, longest long, in_order boolean")
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
                      ) -> DataFrame:
    """The rows of ``df`` that no benchmark item contaminates, with all their columns."""
    return drop_rows(df, contaminated_pairs(df, benchmark, id_col, text_col), id_col, text_col)
