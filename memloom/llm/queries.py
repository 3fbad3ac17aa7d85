"""Queries over the driver's tables, one per operator, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import capfilter, chat, decontam, divergence, filters, hmm, html, langid, neardup, pii, tokencount, warc
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_digest

    return pack_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_block_labeller": html.op1_block_labeller,
    "op2_perspective_rotation": chat.op2_perspective_rotation,
    "op3_concat_cut": op3_concat_cut,
    "op4_checked_patterns": pii.op4_checked_patterns,
    "op5_hidden_markov": hmm.op5_hidden_markov,
    "op6_cross_parsing": langid.op6_cross_parsing,
    "op7_merkle_audit": warc.op7_merkle_audit,
    "op8_chosen_path": neardup.op8_chosen_path,
    "op9_aho_corasick": decontam.op9_aho_corasick,
    "op10_cap_filters": capfilter.op10_cap_filters,
    "op11_incidence_product": filters.op11_incidence_product,
    "op12_count_histograms": divergence.op12_count_histograms,
    "op13_prefix_counts": tokencount.op13_prefix_counts,
}
SQL: dict[str, str] = {
    "op2_perspective_rotation": chat.SQL,
    "op4_checked_patterns": pii.SQL,
    "op7_merkle_audit": warc.SQL,
    "op8_chosen_path": neardup.SQL,
    "op9_aho_corasick": decontam.SQL,
    "op10_cap_filters": capfilter.SQL,
    "op11_incidence_product": filters.SQL,
    "op12_count_histograms": divergence.SQL,
}
