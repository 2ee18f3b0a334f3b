"""A corpus-cleaning pipeline over the ``documents`` table.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it
kept, and returns a DataFrame; ``run`` writes it as Parquet in the shared checkpoint
folder and reads it back as the next stage's documents. All stages but the last
return the columns of ``documents``.

1. quality classifier: documents predicted to be bad go (score under 0.3);
2. exact dedup: of equal texts the row with the largest id stays;
3. n-gram Jaccard join: of each group of near copies (words of five, similarity 0.8
   or more) the document with the smallest id stays;
4. benchmark decontamination: documents that cover half of a benchmark item go;
5. BPE: token ids of what is left, decoded again; one row per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitlift.llm import bpe, decontaminate, exact_dedup, ngram_jaccard, quality
from splitlift.llm._io import table
from splitlift.llm._vocab import default_vocabulary
from splitlift.sources import scope


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.keep_one_per_component(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(bpe.bpe_round_trip(docs, default_vocabulary()))


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

# A trained classifier, string tiling and BPE have no SQL form; tests compare the
# pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage cuts on its way goes when its result is written."""
    kept = scope.current(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scope.Scope(spark, name):
            docs = kept.cut(stage(spark, docs, sf_dir), f"stage_{name}", "zstd")
    return docs
