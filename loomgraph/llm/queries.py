"""The queries of the training-data operators, one per operator, and those that SQL can check."""

from __future__ import annotations

from loomgraph.llm import compression_quality, decontaminate, html_crf, language_id, ngram_join, pii, ppm, quality_rules, sentencepiece_codec, substring_chain


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_html_crf": html_crf.op1_html_crf,
        "op2_language_id": language_id.op2_language_id,
        "op3_pii": pii.op3_pii,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_compression_quality": compression_quality.op6_compression_quality,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
        "op9_substring_chain": substring_chain.op9_substring_chain,
        "op10_ppm": ppm.op10_ppm,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
