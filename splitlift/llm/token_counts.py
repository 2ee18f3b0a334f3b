"""Token counts kept by signed deltas, committed in idempotent batches.

A store is a folder with two parts per batch:

* ``ledger/<batch>``: signed rows (id, source, lang, tokenizer, n_docs, n_tokens):
  plus for inserts, minus for what deletes take away, both for revised counts;
* ``rollup/<batch>``: their sums by source, language and tokenizer version.

Totals are sums of the rollups. A batch counts once its rollup is written whole
(Spark's ``_SUCCESS``, put there last): a batch that failed half-way is written
over when it is delivered again, and one that is committed is not applied twice.

What a delete or revision takes away is the id's net contribution in the committed
ledger, so the caller needs to know the id alone. A recount takes away no more than what
the id has under the row's own source and language. All steps are joins and grouped
sums with map-side partials on narrow rows; a source with a third of all documents
is a third of the rows of no single task.

Defined cases: NULL text counts 0 tokens; NULL source, language or tokenizer is a
group of its own; rows with a NULL id can be inserted, not taken away; each of
repeated rows counts, and a delete takes them all away; a delete of an unknown id
changes nothing; an empty batch is committed and changes nothing; further columns are
ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scope
from ._io import cut
from ._text import slices

KEYS = ("source", "lang", "tokenizer")
_LEDGER = "id long, source string, lang string, tokenizer string, n_docs long, n_tokens long"
_loaded: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _encoding(name: str, pattern: str, ranks: dict[bytes, int]):
    if name not in _loaded:
        import tiktoken
        _loaded[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[name]


def count_tokens(df: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and n_tokens, the length of the text in tokens of the rank
    file ``path``."""
    shared = df.sparkSession.sparkContext.broadcast((path, pattern, read_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(*shared.value)
        for batch in batches:
            for rows, _, _ in slices(batch, text_col):
                texts = rows.column(text_col).to_pylist()
                counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(counts, pa.int64())],
                                                 names=[*keep, "n_tokens"])
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return df.select(*keep, text_col).mapInArrow(run, f"{schema}, n_tokens long")


def changes(counts: DataFrame, op: str, tokenizer: str, id_col: str = "doc_id", source_col: str = "source",
            lang_col: str = "lang") -> DataFrame:
    """Change rows of one kind - insert, revise or recount - from counted documents."""
    return counts.select(
        F.lit(op).alias("op"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), "n_tokens")


def deletions(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in
               (("source", "string"), ("lang", "string"), ("tokenizer", "string"), ("n_tokens", "long"))]
    return ids.select(F.lit("delete").alias("op"), F.col(id_col).cast("long").alias("id"), *nothing)


class TokenRollup:
    """The store at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def scratch(cls, spark: SparkSession) -> TokenRollup:
        """A new store in the current scope, in the shared checkpoint folder."""
        return cls(spark, scope.current(spark).path("llm_rollup"))

    def batches(self) -> list[str]:
        """Committed batches."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rollup")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rollup/*/_SUCCESS"))
        return sorted(s.getPath().getParent().getName() for s in (found or []))

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{part}/{b}" for b in self.batches()]
        return (self.spark.read.schema(schema).parquet(*paths) if paths
                else self.spark.createDataFrame([], schema))

    def state(self) -> DataFrame:
        """Net contribution of each id, source, language and tokenizer."""
        return (self._read("ledger", _LEDGER).groupBy("id", *KEYS)
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs <> 0 or n_tokens <> 0"))

    def commit(self, batch: str, changed: DataFrame) -> bool:
        """Applies change rows (op, id, source, lang, tokenizer, n_tokens); False if the
        batch is committed already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"no batch name: {batch!r}")
        if batch in self.batches():
            return False
        plus = changed.where("op in ('insert', 'revise', 'recount')").select(
            "id", *KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
        state = self.state()
        gone = (changed.where("op in ('delete', 'revise', 'recount') and id is not null")
                .select(F.col("id").alias("of"), F.col("source").alias("s"), F.col("lang").alias("l"),
                        (F.col("op") != "recount").alias("whole")).distinct())
        same = (state["id"] == gone["of"]) & (gone["whole"] | (
            state["source"].eqNullSafe(gone["s"]) & state["lang"].eqNullSafe(gone["l"])))
        minus = state.join(gone, same, "left_semi").select(
            "id", *KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
        ledger = f"{self.path}/ledger/{batch}"
        plus.unionByName(minus).write.mode("overwrite").option("compression", "zstd").parquet(ledger)
        (self.spark.read.schema(_LEDGER).parquet(ledger).groupBy(*KEYS)
         .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
         .write.mode("overwrite").parquet(f"{self.path}/rollup/{batch}"))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of what is in the store."""
        rollup = self._read("rollup", _LEDGER.removeprefix("id long, "))
        return (rollup.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs <> 0 or n_tokens <> 0"))


def corpus_rollup(docs: DataFrame, labels: DataFrame, first: str, second: str, pattern: str) -> DataFrame:
    """Totals after three batches over ``documents``: all are inserted with the counts
    of the first rank file; those labelled toxic are deleted; of the rest, rows not
    labelled English (a NULL language too) are recounted with the second rank file. An
    id's English rows keep their counts; rows with a NULL id cannot be taken away and
    keep theirs."""
    store = TokenRollup.scratch(docs.sparkSession)
    keep = ["doc_id", "source", "lang"]
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    store.commit("1-insert", changes(count_tokens(docs, first, pattern, keep), "insert", "byte_bpe_50k"))
    store.commit("2-toxic", deletions(toxic))
    foreign = count_tokens(docs.where("not (lang <=> 'en') and doc_id is not null"), second, pattern, keep)
    store.commit("3-multilingual", changes(cut(foreign, "counts").join(toxic, "doc_id", "left_anti"), "recount",
                                           "byte_bpe_multi_50k"))
    return store.totals()
