"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from meterspark.llm import (
    conversations,
    decontaminate,
    divergence,
    html,
    jaccard,
    lm,
    packing,
    rules,
    suffixes,
    tokens,
    toxicity,
    urls,
    warc,
)

QUERIES = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_html_extraction": html.op5_html_extraction,
    "op6_packing": packing.op6_packing,
    "op7_url_filter": urls.op7_url_filter,
    "op8_lm_scoring": lm.op8_lm_scoring,
    "op9_repetition_rules": rules.op9_repetition_rules,
    "op10_warc_bundles": warc.op10_warc_bundles,
    "op11_token_counts": tokens.op11_token_counts,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_conversation_repair": conversations.op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op10_warc_bundles": warc.OP10_SQL, "op12_source_divergence": divergence.OP12_SQL}
