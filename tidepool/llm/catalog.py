"""The operators' registered queries."""

from __future__ import annotations

from . import (
    divergence,
    packing,
    pages,
    phrases,
    pieces,
    quality_model,
    quality_rules,
    secrets,
    simhash,
    suffix_tree,
    topk,
    toxicity,
    url_filter,
)
from .common import LlmQuery

__all__ = ["QUERIES", "LlmQuery"]

QUERIES = {
    "op1_packing": packing.QUERY,
    "op2_html_extraction": pages.QUERY,
    "op3_quality_classifier": quality_model.QUERY,
    "op4_simhash": simhash.QUERY,
    "op5_top_k": topk.QUERY,
    "op6_sentencepiece": pieces.QUERY,
    "op7_toxicity": toxicity.QUERY,
    "op8_secret_scan": secrets.QUERY,
    "op9_quality_rules": quality_rules.QUERY,
    "op10_lm_scoring": suffix_tree.QUERY,
    "op11_url_filter": url_filter.QUERY,
    "op12_source_divergence": divergence.QUERY,
    "op13_phrase_collocations": phrases.QUERY,
}
