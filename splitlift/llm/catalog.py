"""The ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from . import (bpe, decontaminate, exact_dedup, language_id, licenses, ngram_jaccard, periodic_runs, quality, secrets,
               substring_dedup, token_counts, toxicity, whitening)
from ._io import table
from ._vocab import default_vocabulary, splitting_pattern


def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark, sf_dir):
    return language_id.identify_languages(
        table(spark, sf_dir, "documents"), default_vocabulary("byte_bpe_50k.tiktoken"))


def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("dk")


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.removal_digest(
        substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op5_secret_scan(spark, sf_dir):
    return secrets.secrets_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op6_bpe(spark, sf_dir):
    return bpe.bpe_digest(bpe.bpe_round_trip(table(spark, sf_dir, "documents"), default_vocabulary()))


def op7_token_counts(spark, sf_dir):
    return token_counts.corpus_rollup(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
        default_vocabulary("byte_bpe_50k.tiktoken"), default_vocabulary("byte_bpe_multi_50k.tiktoken"),
        splitting_pattern())


def op8_decontamination(spark, sf_dir):
    return decontaminate.contaminated_pairs(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("dk")


def op9_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened_rows(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_license_scan(spark, sf_dir):
    return licenses.license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.runs_digest(periodic_runs.periodic_runs(
        periodic_runs.with_loops(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_ngram_jaccard_join, op4_substring_dedup, op5_secret_scan,
                                  op6_bpe, op7_token_counts, op8_decontamination, op9_quality, op10_exact_dedup,
                                  op11_embedding_whitening, op12_license_scan, op13_periodic_runs)}
