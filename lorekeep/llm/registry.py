"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bpe, chat, collocations, fingerprint, html_extract, infill, mixing, ngram_join, pii, quality, suffix_dedup, token_count


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_ann": ann.op2_ann,
        "op3_html": html_extract.op3_html,
        "op4_quality": quality.op4_quality,
        "op5_token_counts": token_count.op5_token_counts,
        "op6_fingerprints": fingerprint.op6_fingerprints,
        "op7_pii": pii.op7_pii,
        "op8_ngram_join": ngram_join.op8_ngram_join,
        "op9_bpe": bpe.op9_bpe,
        "op10_chat": chat.op10_chat,
        "op11_infill": infill.op11_infill,
        "op12_collocations": collocations.op12_collocations,
        "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op2_ann": ann.SQL, "op8_ngram_join": ngram_join.SQL, "op10_chat": chat.SQL, "op11_infill": infill.SQL, "op12_collocations": collocations.SQL}
    if corpus_pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
