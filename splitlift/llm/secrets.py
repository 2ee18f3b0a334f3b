"""Secret scan with corpus-wide ownership frequency (native DataFrame operations).

Base findings are regular-expression matches (leftmost, non-overlapping per
kind). Their places come from ``split`` with the same pattern: the pieces lie
between the matches, so running lengths of pieces and matches give code point
offsets, with no Python.

The method then looks at who owns a value. Every candidate value - of a base
match, or of a bare run that looks like a credential - is hashed; the hashes are
counted over distinct repositories and distinct owners. A hash found with
``example_owners`` owners or more is a widely copied example; one that few
owners have is owner-specific and looks live. Bare runs that look live and
touch no base match are added as spans of kind ``live``; base spans all stay.

Distinct counting runs in two grouped steps (hash, owner, repository), then
(hash, owner), each with map-side partials, and a span meets its value's counts by
hash and lane, so a value copied into a third of all rows meets no single task. The text is read once; the cut table holds only
the matches.

Defined cases: NULL text is empty text; a NULL owner or repository is an owner
or repository of its own; repeated rows are each reported; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import cut
from ._rows import look_up

# Fixed patterns of the contract. A run is maximal either way, so the minimum
# lengths of access (16) and hex (32) are part of the pattern; that of the
# assigned value (8) is not, since a shorter match still uses up its text.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
          r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# Bare runs that may be credentials: 20 or more characters with letters and
# at least four digits.
BARE = r"[A-Za-z0-9+_-]{20,}"
BARE_TEST = r"[0-9][^0-9]*[0-9][^0-9]*[0-9][^0-9]*[0-9]"

KINDS = ("assign", "access", "hex", "live")  # the order of kinds at one start
EXAMPLE_OWNERS = 3


def _matches(text: Column, pattern: str, value_group: int) -> Column:
    """Per match: code points since the previous match's end, its length, its value."""
    p = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                          F.regexp_extract_all(text, p, F.lit(0)).alias("hit"),
                          F.regexp_extract_all(text, p, F.lit(value_group)).alias("value"))
    found = F.transform(F.filter(zipped, lambda z: z["hit"].isNotNull()), lambda z: F.struct(
        F.char_length(z["gap"]).alias("gap"), F.char_length(z["hit"]).alias("len"),
        z["value"].alias("value")))
    return F.when(text.rlike(pattern), found)  # most texts have none: one search


def find_candidates(df: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str
                    ) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): all rows, and one row per match with its place and value."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(df.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
        F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"),
        _matches(text, ASSIGN, 2).alias("assign"), _matches(text, ACCESS, 0).alias("access"),
        _matches(text, HEX, 0).alias("hex"), _matches(text, BARE, 0).alias("live")), "matches")
    in_order = Window.partitionBy("uid", "kind").orderBy("pos")
    parts = None
    for rank, kind in enumerate(KINDS):
        part = (rows.where(F.size(kind) > 0)
                .select("uid", "owner", "repo", F.lit(rank).alias("kind"),
                        F.posexplode(kind).alias("pos", "m")))
        parts = part if parts is None else parts.unionByName(part)
    spans = (parts.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(in_order))
             .select("uid", "owner", "repo", "kind", (F.col("end") - F.col("m.len")).alias("start"),
                     "end", F.col("m.value").alias("value")))
    assign_ok = (F.col("kind") == 0) & (F.char_length("value") >= 8)
    bare_ok = ((F.col("kind") == 3) & F.col("value").rlike(BARE_TEST)
               & F.col("value").rlike("[A-Za-z]"))
    return rows, spans.where(assign_ok | bare_ok | F.col("kind").isin(1, 2))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) over the whole corpus."""
    per_repo = spans.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"),
                                         F.sum("n").alias("n_repos"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
        s["end"].cast("string"))), ",")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 owner_col: str = "source", repo_col: str = "doc_id",
                 example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per input row: id, and ``found``: its spans in order, each with
    kind (index in KINDS), start, end, hash of the value, n_owners, n_repos and
    ``example`` (true: widely copied)."""
    rows, spans = find_candidates(df, id_col, text_col, owner_col, repo_col)
    spans = cut(spans.withColumn("hash", F.sha2("value", 256)).drop("value"), "spans")
    known = (look_up(spans, ownership(spans), "hash", "uid")
             .withColumn("example", F.col("n_owners") >= example_owners))
    # A bare run touches a base match if one starting at or before it ends after
    # its start, or one starting at or after it starts before its end.
    base = F.col("kind") < 3
    upto = Window.partitionBy("uid").orderBy("start").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("uid").orderBy("start").rangeBetween(
        Window.currentRow, Window.unboundedFollowing)
    touches = (F.coalesce(F.max(F.when(base, F.col("end"))).over(upto) > F.col("start"), F.lit(False))
               | F.coalesce(F.min(F.when(base, F.col("start"))).over(after) < F.col("end"), F.lit(False)))
    per_row = (known.withColumn("touches", touches)
               .where(base | ~(F.col("example") | F.col("touches")))
               .groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(
                   "start", "kind", "end", "hash", "n_owners", "n_repos", "example"))).alias("found")))
    return (rows.select("uid", "id").join(per_row, "uid", "left")
            .select(F.col("id").alias(id_col),
                    F.coalesce("found", F.expr("cast(array() as array<struct<start:bigint,kind:int,"
                               "end:bigint,hash:string,n_owners:bigint,n_repos:bigint,"
                               "example:boolean>>)")).alias("found")))


def secrets_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns, from ``scan_secrets``."""
    base = F.filter("found", lambda s: s["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        count(3).alias("n_live"),
        F.size(F.filter("found", lambda s: s["example"])).cast("long").alias("n_example"))
