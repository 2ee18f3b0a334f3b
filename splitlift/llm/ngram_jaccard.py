"""N-gram Jaccard join through a count-vector R-tree.

A document's set is its distinct 5-word shingles (64-bit hashes). Equal sets are
one *class*; classes are the points that are joined.

Count vectors. Shingles are hashed into groups; a class is the point of its group
counts. Two sets share at most the sum, over groups, of the smaller count, so a
pair whose sum of minima is under what Jaccard 0.8 needs is no link. A page of
points has the group-wise maximum as its rectangle, which bounds all its points.

Root of the tree. Sets of a and b shingles with Jaccard 0.8 differ in at most
d = (a + b) / 9 shingles, so their counts - and contents - differ in at most d
groups. Hashed into m > d groups, they agree wholly in m - d of them; so, with the
groups of both in one order, ``SHARED`` of the first d + SHARED are common (one of the
first d + 1 where no set of the pair reaches SHARED_FROM shingles). Each class is listed
under that many of its groups, as (m, group, contents), the fullest first: an entry of
several shingles is rarely shared by documents that merely quote the same passage.
Empty groups say nothing and are no entries: if either set of a pair has as many
groups that are not empty, the common ones are among them. A set that has fewer is
listed under a prefix of its shingles too, in the order of their hashes, which holds
for pairs of such sets. m is a power of two chosen by size; a set also uses the m of
the smaller partners it may have. Entries that list one class are dropped, then classes
with fewer than SHARED entries left: most classes end here. What is left is the
directory of (coordinate, class).

Leaves. Classes of one home coordinate (their longest list) are dealt into pages
of about ``LEAF`` points, with their vectors and sets. Then, in two phases:
1. Links inside each page, then between each page and one hub page of its home
   list: groups of near copies are joined at a cost linear in their number.
2. On every shared coordinate, pages that hold points not joined to each other yet,
   so that no link between components is missed. Pages of one component are not
   paired again, and large components get pages of their own.
Page pairs are bound by rectangles, then by points; the pairs that survive are
checked exactly.

Components come from alternating stars; copies of a text are never expanded.

Defined cases: NULL or blank text has an empty set, linked with nothing; a NULL id
takes part, but is no component id unless nothing else is; repeated rows are one
class; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import connected_components
from ._io import cut
from ._pack import pack_texts, unpack_texts
from ._rows import drop_rows, look_up, row_key
from ._text import U, Words, gram_hashes, mix, powers, slices

SHINGLE = 5
PERCENT = 80
SHARED = 4  # entries that linked sets of SHARED_FROM shingles or more have in common
SHARED_FROM = 64  # smaller ones have one in common at least
LEAF = 128  # points of a page, of PAGE_SHINGLES / LEAF shingles each
PAGE_SHINGLES = LEAF * 512


def _shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first hash of each text + end), with repeats."""
    words = Words(raw, offsets, lower=True)
    h = words.hashes()
    grams, at = gram_hashes(h, words.row, k)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    rows = words.row[at]
    if len(short):  # the whole sequence is one shingle
        p = powers(k)
        whole = np.array([np.sum(h[words.first[i]:words.first[i + 1]] * p[:words.count[i]], dtype=U)
                          for i in short.tolist()], U)
        grams = np.concatenate([grams, mix(whole + words.count[short].astype(U))])
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        grams, rows = grams[order], rows[order]
    return grams, np.searchsorted(rows, np.arange(len(offsets)))


def needed(n, percent: int = PERCENT):
    """Least overlap that a set of ``n`` needs with any partner."""
    return (percent * n + 99) // 100


def most_different(a: int, b: int, percent: int = PERCENT) -> int:
    """Most shingles in which linked sets of ``a`` and ``b`` can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def groups_for(n: int, percent: int = PERCENT) -> int:
    """Number of groups for the smaller set of a pair, a power of two: well over the
    differing shingles, in small sets so many that enough groups are not empty."""
    least = 1.4 * most_different(100 * n, 100 * (100 * n // percent), percent) / 100
    return 1 << max(1, int(np.ceil(np.log2(max(least, 1) * (4 if n < 32 else 1)))))


@functools.lru_cache(maxsize=100_000)
def group_plan(n: int, percent: int = PERCENT) -> tuple[tuple[int, int, int], ...]:
    """(groups, most differing groups, entries to share) for a set of ``n``: as the
    smaller set, then for the groupings of smaller partners."""
    own = groups_for(n, percent)
    low, high = needed(n, percent), 100 * n // percent
    plan = {own: (most_different(n, high, percent), SHARED if high >= SHARED_FROM else 1)}
    for a in {low, *(x for x in (31, 32) if low <= x <= n)}:
        plan.setdefault(groups_for(a, percent), (most_different(n, n, percent), SHARED if n >= SHARED_FROM else 1))
    return tuple((size, *rest) for size, rest in plan.items())


def entries(own: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The directory coordinates of a set (its distinct hashes)."""
    out = []
    mixed = mix(own)
    for size, differ, share in group_plan(len(own), percent):
        group = (own & U(size - 1)).astype(np.int64)
        count = np.bincount(group, minlength=size)
        order = np.argsort(group, kind="stable")
        total = np.concatenate([[U(0)], np.cumsum(mixed[order], dtype=U)])
        ends = np.cumsum(count)
        inside = total[ends] - total[ends - count]  # sums wrap around, as differences do
        code = mix(inside + mix(np.arange(size, dtype=U) + U(size)) + count.astype(U))
        full = np.flatnonzero(count)
        out.append(code[full[np.lexsort((code[full], -count[full]))[:differ + share]]])
        if len(full) < differ + share:
            spare = len(own) - needed(len(own), percent)
            out.append(np.sort(mix(mixed + U(size)))[:spare + share])
    return np.concatenate(out)


def _class_key(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def set_rows(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(id, dk, cls, n): class and size of each document's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in slices(batch, "text"):
                grams, first = _shingles(raw, offsets, k)
                sets = [np.unique(grams[a:b]) for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("dk"),
                     pa.array([_class_key(s) if len(s) else None for s in sets], pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64())], names=["id", "dk", "cls", "n"])
    return docs.mapInArrow(run, "id long, dk long, cls long, n long")


def entry_rows(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(grp, coord, cls): all classes under their coordinates, a class once per slice.
    Of a coordinate's classes in a slice two stay in the coordinate's own group; the
    others are known to be on a longer list and are dealt out at random."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, offsets in slices(batch, "text"):
                grams, first = _shingles(raw, offsets, k)
                given: dict[int, np.ndarray] = {}
                for a, b in zip(first, first[1:]):
                    if b > a:
                        own = np.unique(grams[a:b])
                        key = _class_key(own)
                        if key not in given:
                            given[key] = entries(own, percent)
                if given:
                    coord = np.concatenate(list(given.values()))
                    cls = np.repeat(np.fromiter(given, np.int64), [len(v) for v in given.values()])
                    order = np.argsort(coord, kind="stable")
                    edge = np.concatenate([[True], np.diff(coord[order]) != 0, [True]])
                    known = order[~(edge[1:] | edge[:-1])]
                    grp = coord.copy()
                    grp[known] = mix(coord[known] + cls[known].view(U))
                    yield pa.RecordBatch.from_arrays([pa.array(grp.view(np.int64)), pa.array(coord.view(np.int64)),
                                                      pa.array(cls)], names=["grp", "coord", "cls"])
    return docs.select("text").mapInArrow(run, "grp long, coord long, cls long")


def directory(listed: DataFrame) -> DataFrame:
    """(coord, cls, size): coordinates that list two classes or more."""
    same = Window.partitionBy("grp")
    lists = cut(listed.withColumn("low", F.min("cls").over(same)).withColumn("high", F.max("cls").over(same))
                .where("low < high or grp <> coord").select("coord", "cls").distinct(), "lists")
    return look_up(lists, lists.groupBy("coord").agg(F.count(F.lit(1)).alias("size")), "coord", "cls")


def leaves(sets: DataFrame, listed: DataFrame) -> DataFrame:
    """(cls, n, home, page): where each listed class lies."""
    size = sets.where("cls is not null").groupBy("cls").agg(F.first("n").alias("n"))
    enough = F.col("entries") >= F.when(F.col("n") >= SHARED_FROM, SHARED).otherwise(1)
    homes = cut(listed.groupBy("cls").agg(F.max(F.struct("size", "coord")).alias("h"), F.count(F.lit(1)).alias("entries"))
             .join(size, "cls").where(enough).select("cls", "n", F.col("h.coord").alias("home")), "homes")
    members = homes.groupBy("home").agg(F.count(F.lit(1)).alias("members"))
    return look_up(homes, members, "home", "cls").select("cls", "n", "home", _page(
        F.col("home"), F.col("members"), F.col("n")).alias("page"))


def page_points(docs: DataFrame, sets: DataFrame, placed: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(page, p): the points of each page, with their group counts (16-bit, n / 4
    groups or more) and exact sets, from one document of each class (copies of one row share dk)."""
    reps = (sets.where("cls is not null").groupBy("cls").agg(F.min("dk").alias("dk"))
            .join(placed.select("cls", "page"), "cls"))
    once = pack_texts(docs.select("dk", "text"), ["dk"]).groupBy("dk").agg(F.first("z").alias("z"))
    joined = once.join(reps, "dk").select("page", "cls", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows, raw, offsets in slices(unpack_texts(whole), "text"):
                grams, first = _shingles(raw, offsets, k)
                n, counts, hashes = [], [], []
                for i in range(rows.num_rows):
                    own = np.unique(grams[first[i]:first[i + 1]])
                    size = 1 << max(4, int(len(own) // 4).bit_length())
                    n.append(len(own))
                    counts.append(np.bincount((own & U(size - 1)).astype(np.int64), minlength=size)
                                  .astype(np.uint16).tobytes())
                    hashes.append(own.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page"), rows.column("cls"), pa.array(n, pa.int64()), pa.array(counts, pa.binary()),
                     pa.array(hashes, pa.binary())], names=["page", "cls", "n", "counts", "hashes"])
    out = joined.mapInArrow(run, "page long, cls long, n long, counts binary, hashes binary")
    return out.groupBy("page").agg(F.collect_list(F.struct(
        "cls", F.col("cls").alias("comp"), "n", "counts", "hashes")).alias("p"))


def _fold(counts: np.ndarray, size: int) -> np.ndarray:
    """Group counts over fewer groups (sizes are powers of two)."""
    return counts.reshape(-1, size).sum(axis=0)


def _may_link(x: list, y: list, same: bool, percent: int) -> bool:
    """Whether any pair of points of two pages can reach the threshold."""
    vx = [np.frombuffer(p["counts"], np.uint16).astype(np.int32) for p in x]
    vy = vx if same else [np.frombuffer(p["counts"], np.uint16).astype(np.int32) for p in y]
    size = min(min(map(len, vx)), min(map(len, vy)))
    mx = np.stack([_fold(v, size) for v in vx])
    my = mx if same else np.stack([_fold(v, size) for v in vy])
    nx, ny = np.array([p["n"] for p in x]), np.array([p["n"] for p in y])
    least = needed(min(nx.min(), ny.min()), percent)
    if not same and np.minimum(mx.max(axis=0), my.max(axis=0)).sum() < least:
        return False  # the rectangles
    cx, cy = np.array([p["comp"] for p in x]), np.array([p["comp"] for p in y])
    for i in range(len(x)):
        shared = np.minimum(mx[i], my).sum(axis=1)
        # |A n B| >= percent/100 |A u B|  <=>  (100 + percent) |A n B| >= percent (|A| + |B|)
        fits = ((100 + percent) * shared >= percent * (nx[i] + ny)) & (cx[i] != cy)
        if fits.any():
            return True
    return False


def _links(x: list, y: list, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links between points of different components of two pages, as a forest."""
    pts = x if same else x + y
    sets = [np.frombuffer(p["hashes"], U) for p in pts]
    n = np.array([len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(pts)), n)
    shared = times > 1  # what one point has alone is in no intersection
    column, owner = (np.cumsum(shared) - 1)[column[shared[column]]], owner[shared[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    inter = np.zeros((len(pts), len(pts)), np.float64)
    width, total = 1 << 15, int(shared.sum())
    for low in range(0, total, width):
        a, b = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(pts), min(width, total - low)), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        inter += dense @ dense.T
    linked = (100 + percent) * inter >= percent * (n[:, None] + n[None, :])
    comp = np.array([p["comp"] for p in pts])
    linked &= comp[:, None] != comp[None, :]
    found, parent = [], {int(c): int(c) for c in comp}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c
    rows = range(len(pts)) if same else range(len(x))
    for i in rows:
        for j in np.flatnonzero(linked[i]).tolist():
            if j > i:
                a, b = root(int(comp[i])), root(int(comp[j]))
                if a != b:
                    parent[a] = b
                    found.append((pts[i]["cls"], pts[j]["cls"]))
    return found


_LINKS = "a long, b long"


def _link_rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()),
                                       pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])


def links_within(pages: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between points of one page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for points in batch.column("p"):
                if len(points) > 1:
                    x = points.as_py()
                    yield _link_rows(_links(x, x, True, percent))
    return pages.select("p").mapInArrow(run, _LINKS)


def links_between(pairs: DataFrame, pages: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between the pages of each pair (x, y), x and y different."""
    def with_points(of: DataFrame, *fields: str) -> DataFrame:
        part = F.transform("p", lambda q: F.struct(*[q[f].alias(f) for f in ("cls", "comp", *fields)]))
        px = pages.select(F.col("page").alias("x"), part.alias("px"))
        py = pages.select(F.col("page").alias("y"), part.alias("py"))
        return of.join(px, "x").join(py, "y")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_may_link(x.as_py(), y.as_py(), False, percent)
                    for x, y in zip(batch.column("px"), batch.column("py"))]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("px"), batch.column("py")):
                yield _link_rows(_links(x.as_py(), y.as_py(), False, percent))
    surviving = cut(with_points(pairs, "n", "counts").mapInArrow(bound, "x long, y long"), "pairs")
    return with_points(surviving, "hashes").mapInArrow(verify, _LINKS)


def _page(head, members, n):
    """A page number: ``members`` points of size ``n`` under ``head`` are spread so
    that a page has about PAGE_SHINGLES shingles."""
    spread = F.ceil(members * F.greatest(n, F.lit(512)) / F.lit(PAGE_SHINGLES))
    return F.xxhash64(head, F.pmod(F.xxhash64("cls"), spread))


def class_components(listed: DataFrame, placed: DataFrame, pages: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, comp) over classes with a link."""
    # Phase 1: every page, then with the hub page of its home list.
    within = cut(links_within(pages, percent), "links")
    on_page = listed.select("coord", "cls").join(placed.select("cls", "page"), "cls").select("coord", "page")
    hubs = on_page.groupBy("coord").agg(F.min("page").alias("y"))
    pairs = (placed.select(F.col("page").alias("x"), F.col("home").alias("coord")).distinct()
             .join(hubs, "coord").where("x <> y").select("x", "y").distinct())
    hub_links = cut(links_between(pairs, pages, percent), "links")
    links = within.unionByName(hub_links)

    # Phase 2: on every coordinate, pages whose points are not joined yet. Points of
    # small components stay on their pages, which phase 1 has gone through.
    joined = cut(connected_components(links).withColumnRenamed("node", "cls"), "components")
    large = joined.groupBy("comp").agg(F.count(F.lit(1)).alias("comp_size")).where(F.col("comp_size") > LEAF)
    own_pages = look_up(joined, large, "comp", "cls")
    second = cut(placed.join(joined, "cls", "left").join(own_pages.select("cls", "comp_size"), "cls", "left")
                 .withColumn("comp", F.coalesce("comp", "cls"))
                 .select("cls", "comp", F.when(F.col("comp_size").isNotNull(), _page(
                     F.col("comp"), F.col("comp_size"), F.col("n"))).otherwise(F.col("page")).alias("page")), "leaves")
    # Coordinates that list the same pages count once: a list is known by the number
    # of its pages and the sum (bitwise) of their hashes.
    same = Window.partitionBy("coord")
    open_ = (listed.select("coord", "cls").join(second, "cls")
             .groupBy("coord", "page").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
             .withColumn("low", F.min("c0").over(same)).withColumn("high", F.max("c1").over(same))
             .withColumn("list", F.xxhash64(F.count(F.lit(1)).over(same), F.bit_xor(F.xxhash64("page")).over(same)))
             .where("low < high").select("list", "page").distinct())
    spans = second.groupBy("page").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    open_ = open_.join(spans, "page")
    left = open_.select("list", F.col("page").alias("x"), F.col("c0").alias("x0"), F.col("c1").alias("x1"))
    right = open_.select("list", F.col("page").alias("y"), F.col("c0").alias("y0"), F.col("c1").alias("y1"))
    rest = cut(left.join(right, "list").where("x < y and not (x0 = x1 and y0 = y1 and x0 = y0)")
               .select("x", "y").distinct(), "pairs")
    used = rest.select(F.col("x").alias("page")).union(rest.select("y")).distinct()
    again = (pages.select(F.explode("p").alias("q")).select("q.cls", "q.n", "q.counts", "q.hashes")
             .join(second.select("cls", "comp", "page").join(used, "page", "left_semi"), "cls")
             .groupBy("page").agg(F.collect_list(F.struct("cls", "comp", "n", "counts", "hashes")).alias("p")))
    more = links_between(rest, cut(again, "pages"), percent)
    return connected_components(links.unionByName(more))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that
    links reach), and ``dk``, a key of id and text for joining back."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("dk"),
                     F.col(text_col).alias("text"))
    sets = cut(set_rows(docs, k), "sets")
    listed = cut(directory(entry_rows(docs, k, percent)), "directory")
    placed = cut(leaves(sets, listed), "leaves")
    pages = cut(page_points(docs, sets, placed, k), "pages")
    comps = class_components(listed, placed, pages, percent)
    # Classes first, so that copies of a text are one row when components are joined.
    least = sets.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"))
    linked = cut(comps.withColumnRenamed("node", "cls").join(least, "cls"), "linked")
    names = linked.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = (least.join(look_up(linked.drop("id"), names, "comp", "cls").drop("comp"), "cls", "left")
             .select("cls", F.coalesce("component_id", "id").alias("component_id")))
    return (sets.select("id", "dk", "cls", "n").join(named, "cls", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
                    .alias("component_id"), "dk"))


def keep_one_per_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is their component's id (one row of each), with
    all their columns. Rows with a NULL id stay if nothing else of theirs does."""
    found = cut(jaccard_components(df, id_col, text_col), "components")
    drop = found.where(~F.col(id_col).eqNullSafe(F.col("component_id")))
    again = found.groupBy("dk").count().where("count > 1")
    return drop_rows(df, drop, id_col, text_col, again)
