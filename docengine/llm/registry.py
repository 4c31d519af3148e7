"""The queries op1 to op10 and their SQL, gathered from the operators' modules."""

from __future__ import annotations

from docengine.llm import (
    decontaminate,
    exact_dedup,
    lm_scoring,
    quality,
    sentencepiece_codec,
    simhash_dedup,
    substring_dedup,
    token_output,
    toxicity,
    url_filter,
)

_MODULES = (
    decontaminate,
    exact_dedup,
    lm_scoring,
    quality,
    sentencepiece_codec,
    simhash_dedup,
    substring_dedup,
    token_output,
    toxicity,
    url_filter,
)

QUERIES = {m.NAME: m.query for m in _MODULES}
ORACLES = {m.NAME: m.ORACLE_SQL for m in _MODULES if m.ORACLE_SQL}
