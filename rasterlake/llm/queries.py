"""Queries over the operators of this subpackage, and the SQL of those that have one."""

from __future__ import annotations

from . import bpe, bpe_sql, divergence, fingerprint, langid, lines, mixing, neardup, packing, pii, prefixtrie, quality, tokencounts, topk


def pipeline(spark, sf_dir: str):
    """The whole corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_neardup": neardup.op3_neardup,
    "op4_topk": topk.op4_topk,
    "op5_token_counts": tokencounts.op5_token_counts,
    "op6_mixing": mixing.op6_mixing,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_quality": quality.op8_quality,
    "op9_pii": pii.op9_pii,
    "op10_langid": langid.op10_langid,
    "op11_divergence": divergence.op11_divergence,
    "op12_packing": packing.op12_packing,
    "op13_prefix_trie": prefixtrie.op13_prefix_trie,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_bpe": bpe_sql.OP1_SQL,
    "op3_neardup": neardup.OP3_SQL,
    "op4_topk": topk.OP4_SQL,
    "op5_token_counts": bpe_sql.OP5_SQL,
    "op7_line_dedup": lines.OP7_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op13_prefix_trie": prefixtrie.OP13_SQL,
}
