"""The queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from planlens.llm import language_id, mixing, near_dup, packing, quality_rules, secret_scan, substring_dedup, token_counts, token_files, topk
from planlens.llm.common import table


def tokenizer(name: str) -> str:
    """Where the vocabulary file lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op1_quality_rules": lambda spark, d: quality_rules.op1(table(spark, d, "documents")),
    "op2_near_dup": lambda spark, d: near_dup.op2(table(spark, d, "documents")),
    "op3_mixing": lambda spark, d: mixing.op3(table(spark, d, "documents")),
    "mixing_of_shared_texts": lambda spark, d: mixing.mix_texts(table(spark, d, "documents")),
    "op4_topk": lambda spark, d: topk.op4(table(spark, d, "embeddings")),
    "op5_packing": lambda spark, d: packing.op5(table(spark, d, "documents"), tokenizer("word_bpe_49k.json")),
    "op6_token_files": lambda spark, d: token_files.op6(table(spark, d, "documents"), tokenizer("byte_bpe_50k.json")),
    "op7_secret_scan": lambda spark, d: secret_scan.op7(table(spark, d, "documents")),
    "op8_token_counts": lambda spark, d: token_counts.op8(table(spark, d, "documents"), tokenizer("piece_bpe_32k.model")),
    "op9_suffix_dedup": lambda spark, d: substring_dedup.op9(table(spark, d, "documents")),
    "op10_language_id": lambda spark, d: language_id.op10(table(spark, d, "pages"), table(spark, d, "documents")),
}

ORACLE = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op4_topk": topk.OP4_SQL,
}
