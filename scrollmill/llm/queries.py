"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from scrollmill.llm import bpe, exact_dedup, langid, line_dedup, media, minhash_dedup, mixing, pii, quality, suffix_dedup

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_quality": quality.op2_quality,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_media": media.op6_media,
    "op7_language_id": langid.op7_language_id,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op9_passage_dedup": line_dedup.op9_passage_dedup,
    "op10_pii": pii.op10_pii,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE_OP1,
    "op3_minhash_dedup": minhash_dedup.ORACLE_OP3,
    "op4_exact_dedup": exact_dedup.ORACLE_OP4,
    "op9_line_dedup": line_dedup.ORACLE_OP9,
    "op9_passage_dedup": line_dedup.ORACLE_OP9_PASSAGES,
}
