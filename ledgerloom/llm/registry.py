"""Queries of the training-data operators, with SQL where SQL can express them."""

from ledgerloom.llm import hard_negatives, licenses, lm_scoring, mixing, ngram_join, packing, pii, quality_rules, quality_sql, simhash, spelling, toxicity, url_filters, winnowing

QUERIES = {
    "op1_pii_spans": pii.op1_pii_spans,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_license_sentences": licenses.op3_license_sentences,
    "op4_quality_divergence": quality_rules.op4_quality_divergence,
    "op5_simhash_groups": simhash.op5_simhash_groups,
    "op6_packing": packing.op6_packing,
    "op7_attention_lm": lm_scoring.op7_attention_lm,
    "op8_url_rules": url_filters.op8_url_rules,
    "op9_winnowing": winnowing.op9_winnowing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_spelling": spelling.op12_spelling,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op3_license_sentences": licenses.OP3_SQL,
    "op4_quality_divergence": quality_sql.OP4_SQL,
    "op8_url_rules": url_filters.OP8_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
