"""The subpackage's queries, the pipeline among them, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import mixing, pii, quality, secret_scan, substring_dedup
from .chat_quotes import op4_chat_quotes
from .decontaminate import op6_decontaminate
from .html_text import op10_html_text
from .near_dedup import op9_simhash_dedup
from .token_counts import op8_token_counts

_OWN = (mixing.op1_mix_sources, pii.op2_personal_data, substring_dedup.op3_substring_dedup, op4_chat_quotes, secret_scan.op5_secret_scan, op6_decontaminate, quality.op7_quality_rules, op8_token_counts, op9_simhash_dedup, op10_html_text)
#: The parts of results that SQL can express, where it can't express the whole.
_PARTS = {pii.personal_base_counts: pii.BASE_COUNTS_SQL, secret_scan.secret_base_counts: secret_scan.BASE_COUNTS_SQL, quality.quality_measures: quality.MEASURES_SQL}


def queries() -> dict:
    return {f.__name__: f for f in (*_OWN, *_PARTS)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Queries without SQL: spans by a trained method (2, 5), quotes (4), SimHash (6, 9), a fitted ratio (7, pipeline),
    a tokenizer (8) and pages (10) are tested against brute-force versions; of 2, 5 and 7 the parts that SQL has are queries too."""
    return {"op1_mix_sources": mixing.SQL, "op3_substring_dedup": substring_dedup.SQL} | {f.__name__: sql for f, sql in _PARTS.items()}
