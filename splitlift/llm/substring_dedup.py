"""Substring deduplication by anchor sampling and grouping at one depth.

A window is ``WINDOW`` consecutive words. Every window equal to one that starts
earlier in the corpus (smaller document id, or same id and earlier start) is a
repeat; the words that repeats cover are removed.

No suffix tree is built: of the trees that prefixes would partition, only the nodes 20
words deep are needed, as equal hashes; longer repeats are unions of windows.

Which suffixes. All windows of 20 words contain 13 runs of ``ANCHOR`` = 8 words;
the leftmost smallest hash of them is the window's anchor. Equal windows have
equal anchors at equal places, so the suffixes that matter are those starting at
anchors - about one word in seven - and an anchor that occurs once in the corpus
(a prefix without a branch) has no repeat below it.

1. ``anchor_rows``: one row per anchor of the corpus. Anchors that already recur
   within a slice of a task are known to recur and are dealt out at random; one
   marker per slice goes to the anchor's own group. A passage that a third of all
   documents share thus meets one task in slices / rows of its real number.
2. ``repeated``: anchors that recur, per document.
3. ``window_rows``: the documents are joined with their recurring anchors; each
   anchor row holds the hashes of the windows it is the anchor of. Windows that
   recur within a slice are decided there, the earliest alone travels on.
4. Suffix groups by variable-length prefix: the 8-word prefix, or all 20 words
   where more than ``PREFIX_BUDGET`` suffixes share the 8. Within a partition the
   suffixes are sorted by prefix and corpus order (id and place of the anchor, which
   lies at one distance from the start in all equal windows), the leaves of each
   subtree in order; a node 20 words deep with two leaves or more is a repeat, and
   all its leaves but the first are marked. Leaves stream by: one subtree's node
   labels, each with the place of its first leaf, are all that is held.
5. Marked windows meet their documents; runs of them are the maximal repeats.

Defined cases: NULL or blank text has no words; documents under 20 words lose
nothing; NULL ids rank last; rows of one id count as one document, so a repeated
row keeps what its first copy keeps (its windows are made once for all copies); an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import cut
from ._pack import pack_texts, unpack_texts
from ._text import Words, gram_hashes, powers, mix, slices, U

WINDOW = 20
ANCHOR = 8
PREFIX_BUDGET = 1_000_000
NO_ID = np.iinfo(np.int64).max


def _windows(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, anchor-gram hashes, window starts, anchor of each window)."""
    h = words.hashes()
    m = len(h) - window + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return h, np.zeros(0, U), none, none
    g, _ = gram_hashes(h, np.zeros(len(h), np.int8), anchor)
    best, at, width, need = g, np.arange(len(g)), 1, window - anchor + 1
    while width < need:  # leftmost smallest of `width` grams, doubled each time
        step = min(width, need - width)
        left, right = best[:-step], best[step:]
        keep = left <= right
        at = np.where(keep, at[:-step], at[step:])
        best = np.where(keep, left, right)
        width += step
    start = np.flatnonzero(words.row[:m] == words.row[window - 1:])
    return h, g, start, at[start]


def _window_hashes(h: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    p = powers(window)
    total = np.zeros(len(starts), U)
    for j in range(window):
        total += h[starts + j] * p[j]
    return mix(total + U(window))


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ord, dk, text): ids with NULL last, and a key of id and text."""
    return df.select(F.col(id_col).alias("id"),
                     F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("ord"),
                     F.xxhash64(F.col(id_col), F.col(text_col)).alias("dk"),
                     F.col(text_col).alias("text"))


def anchor_rows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(grp, key, dk, pos, weight): anchors, and markers (pos NULL)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in slices(batch, "text"):
                words = Words(raw, offsets)
                _, g, _, at = _windows(words, window, anchor)
                if not len(at):
                    continue
                at = np.unique(at)
                _, firsts = np.unique(np.asarray(rows.column("dk")), return_index=True)
                at = at[np.isin(words.row[at], firsts)]  # copies of a row add nothing
                key = g[at]
                dk = np.asarray(rows.column("dk"))[words.row[at]]
                pos = at - words.first[words.row[at]]
                names, which, times = np.unique(key, return_inverse=True, return_counts=True)
                known = times[which] > 1
                grp = np.where(known, mix(dk.view(U) + pos.astype(U)), key)
                marks = names[times > 1]
                fill = len(marks)
                none = np.concatenate([np.zeros(len(at), bool), np.ones(fill, bool)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([grp, marks]).view(np.int64)),
                    pa.array(np.concatenate([key, marks]).view(np.int64)),
                    pa.array(np.concatenate([dk, np.zeros(fill, np.int64)])),
                    pa.array(np.concatenate([pos, np.zeros(fill, np.int64)]).astype(np.int32), mask=none),
                    pa.array(np.concatenate([1 + known, np.full(fill, 2)]).astype(np.int32)),
                ], names=["grp", "key", "dk", "pos", "weight"])
    return docs.select("dk", "text").mapInArrow(run, "grp long, key long, dk long, pos int, weight int")


def repeated(anchors: DataFrame, budget: int = PREFIX_BUDGET) -> DataFrame:
    """(dk, marks): per document its recurring anchors, each with ``long``: its
    8-word prefix has more suffixes than the budget, so it needs the long one."""
    weight = F.sum("weight").over(Window.partitionBy("grp"))
    rows = cut(anchors.withColumn("total", weight).where("total > 1 and pos is not null")
               .select("key", "dk", "pos"), "anchors")
    # At most (rows / budget) keys, so 8 bytes of them per million rows: broadcast. A
    # set, so that copies of one row (they share dk) put each anchor there once.
    over = rows.groupBy("key").count().where(F.col("count") > budget).select("key", F.lit(True).alias("long"))
    return (rows.join(F.broadcast(over), "key", "left").groupBy("dk")
            .agg(F.collect_set(F.struct("pos", F.coalesce("long", F.lit(False)).alias("long"))).alias("marks")))


def window_rows(packed: DataFrame, marks: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(key, ord, dk, at, mask, open, hashes): windows of the anchor at word ``at``;
    window i starts i words before it. Bits of ``mask``: windows known to be repeats;
    ``open`` and ``hashes`` are the numbers and hashes of those still to be decided."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows, raw, offsets in slices(unpack_texts(whole), "text"):
                yield from _window_batch(rows, raw, offsets, window, anchor)
    # One row per dk: the windows of its copies have the same (ord, place) and marks.
    once = packed.groupBy("dk").agg(F.first(F.struct("ord", "z")).alias("one")).select("dk", "one.ord", "one.z")
    joined = once.join(marks, "dk")
    return joined.select("ord", "dk", "z", F.col("marks.pos").alias("pos"),
                         F.col("marks.long").alias("long")).mapInArrow(
        run, "key long, ord long, dk long, at int, mask int, open array<int>, hashes array<long>")


def _window_batch(rows, raw, offsets, window, anchor) -> Iterator[pa.RecordBatch]:
    words = Words(raw, offsets)
    h, g, start, at = _windows(words, window, anchor)
    pos, long_ = rows.column("pos"), rows.column("long")
    sizes = np.asarray(pos.value_lengths())
    where = np.asarray(pos.flatten()) + np.repeat(words.first[:-1], sizes)
    wanted, lengthy = np.zeros(len(h), bool), np.zeros(len(h), bool)
    wanted[where] = True
    lengthy[where] = np.asarray(long_.flatten())
    pick = wanted[at]
    start, at = start[pick], at[pick]
    if not len(start):
        return
    code = _window_hashes(h, start, window)
    text = words.row[start]
    ord_ = np.asarray(rows.column("ord"))[text]
    dk = np.asarray(rows.column("dk"))[text]
    begin = start - words.first[text]
    # Repeats within the slice: all but the earliest are decided here.
    order = np.lexsort((begin, ord_, code))
    c, o, b = code[order], ord_[order], begin[order]
    new = np.concatenate([[True], c[1:] != c[:-1]])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (o != o[lead]) | (b != b[lead])
    done = np.zeros(len(code), bool)
    done[order] = later
    # Rows: one per anchor, or one per window where the prefix has to be long.
    single = lengthy[at]
    head = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]) | single
    head_at = np.flatnonzero(head)
    row = np.cumsum(head) - 1
    offset = (at - start).astype(np.int32)
    mask = np.bincount(row, np.where(done, 1 << offset.astype(np.int64), 0), len(head_at)).astype(np.int32)
    open_ = ~done
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[open_], minlength=len(head_at)))]).astype(np.int32)
    key = np.where(single, code, g[at])[head_at]
    decided = ends[1:] == ends[:-1]  # nothing left to compare: any partition will do
    key = np.where(decided, mix(dk[head_at].view(U) + begin[head_at].astype(U)), key)
    yield pa.RecordBatch.from_arrays([
        pa.array(key.view(np.int64)), pa.array(ord_[head_at]), pa.array(dk[head_at]),
        pa.array((at - words.first[text])[head_at].astype(np.int32)), pa.array(mask),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(offset[open_])),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(code[open_].view(np.int64))),
    ], names=["key", "ord", "dk", "at", "mask", "open", "hashes"])


def mark_repeats(rows: DataFrame) -> DataFrame:
    """(ord, dk, at, mask) of rows with repeats: subtrees in sorted order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Labels of the open subtree's nodes, sorted, and the first leaf of each.
        last_key, seen, seen_ord, seen_place = None, *(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column("key"))
            open_, hashes = batch.column("open"), batch.column("hashes")
            row = np.repeat(np.arange(len(key)), np.asarray(hashes.value_lengths()))
            code, bit = np.asarray(hashes.flatten()), np.asarray(open_.flatten())
            place = np.asarray(batch.column("at"))[row].astype(np.int64) - bit
            ord_ = np.asarray(batch.column("ord"))[row]
            # Leaves come in corpus order; equal labels of one subtree are one node.
            order = np.lexsort((np.arange(len(code)), code, key[row]))
            c, k = code[order], key[row][order]
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])]) if len(c) else np.zeros(0, bool)
            lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(c) else np.zeros(0, np.int64)
            o, p = ord_[order], place[order]
            first_ord, first_place = o[lead], p[lead]
            if last_key is not None and len(seen) and key[0] == last_key:
                at = np.minimum(np.searchsorted(seen, c), len(seen) - 1)
                known = (k == last_key) & (seen[at] == c)
                first_ord = np.where(known, seen_ord[at], first_ord)
                first_place = np.where(known, seen_place[at], first_place)
            later = (o != first_ord) | (p != first_place)
            hit = np.zeros(len(code), bool)
            hit[order] = later
            mask = np.asarray(batch.column("mask")) | np.bincount(
                row, np.where(hit, 1 << bit.astype(np.int64), 0), len(key)).astype(np.int32)
            if key[-1] != last_key:
                seen, seen_ord, seen_place = (x[:0] for x in (seen, seen_ord, seen_place))
            last_key = key[-1]
            tail = new & (k == last_key)
            seen, own = np.unique(np.concatenate([seen, c[tail]]), return_index=True)
            seen_ord = np.concatenate([seen_ord, first_ord[tail]])[own]
            seen_place = np.concatenate([seen_place, first_place[tail]])[own]
            keep = pa.array(mask != 0)
            yield pa.RecordBatch.from_arrays([
                batch.column("ord"), batch.column("dk"), batch.column("at"), pa.array(mask)],
                names=["ord", "dk", "at", "mask"]).filter(keep)
    sorted_ = rows.repartition("key").sortWithinPartitions("key", "ord", "at")
    return sorted_.mapInArrow(run, "ord long, dk long, at int, mask int")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, anchor: int = ANCHOR, budget: int = PREFIX_BUDGET) -> DataFrame:
    """One row per input row: id, text without the repeated words (kept words joined
    by one space), n_words, n_removed, and ``spans``: the maximal runs removed, as
    (first word, number of words)."""
    docs = _documents(df, id_col, text_col)
    marks = repeated(anchor_rows(docs, window, anchor), budget)
    marked = mark_repeats(window_rows(pack_texts(docs, ["ord", "dk"]), marks, window, anchor))
    per_doc = (marked.groupBy("dk", "ord")
               .agg(F.collect_list(F.struct("at", "mask")).alias("m"))
               .select("dk", "ord", F.col("m.at").alias("at"), F.col("m.mask").alias("mask")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows, raw, offsets in slices(unpack_texts(whole), "text"):
                yield _keep(rows, raw, offsets, window)
    out = (pack_texts(docs, ["id", "ord", "dk"]).join(per_doc, ["dk", "ord"], "left").select("id", "z", "at", "mask")
           .mapInArrow(run, "id long, kept string, n_words long, n_removed long,"
                            " spans array<struct<start:int,n:int>>"))
    return out.withColumnsRenamed({"id": id_col, "kept": text_col})


def _keep(rows, raw, offsets, window) -> pa.RecordBatch:
    words = Words(raw, offsets)
    anchors, masks = rows.column("at"), rows.column("mask")
    sizes = np.asarray(anchors.value_lengths().fill_null(0))
    anchor = np.repeat(words.first[:-1], sizes) + np.asarray(anchors.flatten())
    mask = np.asarray(masks.flatten())
    depth = np.zeros(len(words) + 1, np.int64)
    for bit in range(window):
        at = anchor[(mask >> bit) & 1 == 1] - bit
        np.add.at(depth, at, 1)
        np.add.at(depth, at + window, -1)
    gone = np.cumsum(depth)[:-1] > 0
    body = words.raw.tobytes()
    kept, spans = [], []
    for i in range(rows.num_rows):
        a, b = words.first[i], words.first[i + 1]
        out = gone[a:b]
        if out.any():
            kept.append(" ".join(body[s:e].decode() for s, e in zip(
                words.start[a:b][~out].tolist(), words.end[a:b][~out].tolist())))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
            spans.append([{"start": int(s), "n": int(e - s)} for s, e in zip(edge[::2], edge[1::2])])
        else:
            kept.append(b" ".join(body[offsets[i]:offsets[i + 1]].split()).decode())
            spans.append([])
    n_removed = np.bincount(words.row, gone, rows.num_rows).astype(np.int64)
    return pa.RecordBatch.from_arrays([
        rows.column("id"), pa.array(kept, pa.string()), pa.array(words.count.astype(np.int64)),
        pa.array(n_removed), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))],
        names=["id", "kept", "n_words", "n_removed", "spans"])


def removal_digest(removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns, from ``remove_repeats``."""
    return removed.select(id_col, "n_words", "n_removed", F.sha2(F.col(text_col), 256).alias("kept_sha256"),
                          F.size("spans").cast("long").alias("n_spans"))
