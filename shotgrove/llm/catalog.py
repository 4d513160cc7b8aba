"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from shotgrove.llm import chat, decontaminate, lexical, url_filter
from shotgrove.llm.bpe import op6_bpe
from shotgrove.llm.common import Query
from shotgrove.llm.jaccard_join import op3_jaccard_join
from shotgrove.llm.language_id import op10_language_id
from shotgrove.llm.lm_scoring import op9_lm_scoring
from shotgrove.llm.merkle import op1_fingerprints
from shotgrove.llm.packing import op12_packing
from shotgrove.llm.pseudonyms import op2_pseudonyms
from shotgrove.llm.sharding import op4_sharding
from shotgrove.llm.spelling import op11_spelling

QUERIES: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sharding": op4_sharding,
    "op5_chat": chat.op5_chat,
    "op6_bpe": op6_bpe,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
    "op11_spelling": op11_spelling,
    "op12_packing": op12_packing,
    "op13_search": lexical.op13_search,
}

SQL: dict[str, str] = {
    "op5_chat": chat.SQL,
    "op7_decontamination": decontaminate.SQL,
    "op8_url_filter": url_filter.sql(),
    "op13_search": lexical.SQL,
}
