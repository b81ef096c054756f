"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontamination, language_id, license_scan, matroska, mixing, phrases, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, va_file
from .common import documents, table

QUERIES = {
    "op1_mixing": lambda spark, sf_dir: mixing.op1_mixing(documents(spark, sf_dir, "doc_id", "text", "source")),
    "op2_substring_dedup": lambda spark, sf_dir: substring_dedup.op2_substring_dedup(documents(spark, sf_dir, "doc_id", "text")),
    "op3_quality_rules": lambda spark, sf_dir: quality_rules.op3_quality_rules(documents(spark, sf_dir, "doc_id", "text", "lang", "source")),
    "op4_matroska": lambda spark, sf_dir: matroska.op4_matroska(documents(spark, sf_dir, "doc_id", "text")),
    "op5_license_scan": lambda spark, sf_dir: license_scan.op5_license_scan(documents(spark, sf_dir, "doc_id", "text")),
    "op6_language_id": lambda spark, sf_dir: language_id.op6_language_id(documents(spark, sf_dir, "doc_id", "text", "lang")),
    "op7_suffix_dedup": lambda spark, sf_dir: suffix_dedup.op7_suffix_dedup(documents(spark, sf_dir, "doc_id", "text")),
    "op8_simhash": lambda spark, sf_dir: simhash.op8_simhash(documents(spark, sf_dir, "doc_id", "text")),
    "op9_bpe": lambda spark, sf_dir: bpe.op9_bpe(documents(spark, sf_dir, "doc_id", "text")),
    "op10_sharding": lambda spark, sf_dir: sharding.op10_sharding(documents(spark, sf_dir, "doc_id", "text")),
    "op11_clustering": lambda spark, sf_dir: va_file.op11_clustering(table(spark, sf_dir, "embeddings", "vec_id", "embedding")),
    "op12_phrases": lambda spark, sf_dir: phrases.op12_phrases(documents(spark, sf_dir, "lang", "text")),
    "op13_decontamination": lambda spark, sf_dir: decontamination.op13_decontamination(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")),
}

ORACLE_SQL = {"op1_mixing": mixing.ORACLE, "op3_quality_rules": quality_rules.ORACLE, "op11_clustering": va_file.ORACLE, "op12_phrases": phrases.ORACLE, "op13_decontamination": decontamination.ORACLE}
