"""Queries and oracles of this subpackage."""

from logloom.llm import (
    bpe,
    conversation_trie,
    decontaminate,
    html_extract,
    language_id,
    license_scan,
    quality_classifier,
    quality_rules,
    shards,
    simhash,
    suffix_dedup,
    token_alignment,
    url_filter,
)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (html_extract, license_scan, quality_rules, shards, decontaminate, bpe, language_id, quality_classifier, suffix_dedup, simhash, conversation_trie, url_filter, token_alignment):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
