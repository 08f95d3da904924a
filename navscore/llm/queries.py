"""The registered queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from navscore.llm import (
    decontaminate,
    html_blocks,
    lang_ecoc,
    periodic_runs,
    phrase_tries,
    piece_fst,
    quality_gam,
    quality_rules,
    simhash_gray,
    suffix_dedup,
    token_count,
    token_files,
    toxicity_channel,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_quality_classifier": quality_gam.op2_quality_classifier,
    "op3_token_counts": token_count.op3_token_counts,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_token_files": token_files.op5_token_files,
    "op6_language_id": lang_ecoc.op6_language_id,
    "op7_html_extraction": html_blocks.op7_html_extraction,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_sentencepiece": piece_fst.op9_sentencepiece,
    "op10_simhash": simhash_gray.op10_simhash,
    "op11_toxicity": toxicity_channel.op11_toxicity,
    "op12_collocations": phrase_tries.op12_collocations,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op4_decontamination": decontaminate.OP4_SQL,
    "op12_collocations": phrase_tries.OP12_SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
