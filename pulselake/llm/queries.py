"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pulselake.llm import (
    byte_bpe,
    collocations,
    common,
    cover_tree,
    decontamination,
    exact_dedup,
    html_content,
    huffman_tokens,
    importance,
    jaccard_join,
    language_id,
    quality,
    toxicity,
    warc,
)


def op9_byte_bpe(spark, sf_dir: str):
    import public_tokenizers

    return byte_bpe.digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_quality": quality.op2_quality,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_token_files": huffman_tokens.op4_token_files,
    "op5_top_k": cover_tree.op5_top_k,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html_content": html_content.op7_html_content,
    "op8_warc": warc.op8_warc,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_collocations": collocations.op11_collocations,
    "op12_importance": importance.op12_importance,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}

ORACLES = {
    "op3_decontamination": decontamination.OP3_SQL,
    "op5_top_k": cover_tree.OP5_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_jaccard_join": jaccard_join.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op13_exact_dedup": exact_dedup.OP13_SQL,
}
