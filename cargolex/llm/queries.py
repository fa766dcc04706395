"""The registered queries: each applies one operator with its production parameters to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontamination, exact_dedup, html_text, language_id, licenses, line_dedup, minhash, mixing, pii, quality_rules, ranked_search, spelling, suffix_dedup
from .common import table
from .sql import SQL


def op1_quality_rules(spark, sf_dir):
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op5_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark, sf_dir):
    """n_lines, n_dropped and the md5 of what stays of each document; its source is its host."""
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept_bytes")


def op8_source_mixing(spark, sf_dir):
    """How often each document is read."""
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_tokens", "n_copies")


def op9_decontamination(spark, sf_dir):
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.coalesce(F.transform("item_ids", lambda x: x.cast("string")), F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"), "contaminated")


def op10_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.equal_texts(table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_pii": op2_pii,
        "op3_language_id": op3_language_id,
        "op4_near_dedup": op4_near_dedup,
        "op5_html_extraction": op5_html_extraction,
        "op6_line_dedup": op6_line_dedup,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_source_mixing": op8_source_mixing,
        "op9_decontamination": op9_decontamination,
        "op10_license_scan": op10_license_scan,
        "op11_ranked_search": op11_ranked_search,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql():
    return dict(SQL)
