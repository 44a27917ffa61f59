"""The queries of this subpackage for the driver: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers

from quarry.llm import decontaminate, language, lines, mih, pack, pii, simhash, substring, token_count
from quarry.llm._base import read


def op1_multi_index_hashing(spark, sf_dir):
    return mih.nearest(read(spark, sf_dir, "embeddings"))


def op2_latent_decontamination(spark, sf_dir):
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_pii_anchors(spark, sf_dir):
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op5_unit_dedup(spark, sf_dir):
    return lines.repeated_passages(read(spark, sf_dir, "documents")).drop("row")


def op6_token_counts(spark, sf_dir):
    return token_count.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_suffix_dedup(spark, sf_dir):
    return substring.removals(read(spark, sf_dir, "documents"))


def op8_language_mixture(spark, sf_dir):
    return language.identify(read(spark, sf_dir, "documents"))


def op9_site_line_dedup(spark, sf_dir):
    return lines.line_report(read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark, sf_dir):
    return pack.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries():
    return {f.__name__: f for f in (op1_multi_index_hashing, op2_latent_decontamination, op3_simhash_near_dedup, op4_pii_anchors, op5_unit_dedup, op6_token_counts, op7_suffix_dedup, op8_language_mixture, op9_site_line_dedup, op10_best_fit_packing)}


def oracle_sql():
    return {"op9_site_line_dedup": lines.LINE_SQL}
