"""The subpackage's part of the query catalogue."""

from __future__ import annotations

from .divergence import ORACLE as DIVERGENCE_ORACLE
from .divergence import op13_source_divergence
from .html_text import op3_html_extraction
from .lexical import ORACLE as LEXICAL_ORACLE
from .lexical import op11_lexical_search
from .mixing import op7_mixing
from .ngram import op6_lm_scoring
from .packing import op5_best_fit_packing
from .pieces import op12_pieces
from .quality import op10_quality_rules
from .sharding import op2_sharding
from .simhash import op1_simhash
from .token_files import op9_token_files
from .topk import ORACLE as TOPK_ORACLE
from .topk import op4_exact_topk
from .url_filter import ORACLE as URL_ORACLE
from .url_filter import op8_url_filters


def queries() -> dict:
    found = [op1_simhash, op2_sharding, op3_html_extraction, op4_exact_topk, op5_best_fit_packing, op6_lm_scoring, op7_mixing, op8_url_filters, op9_token_files, op10_quality_rules, op11_lexical_search, op12_pieces, op13_source_divergence]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_topk": TOPK_ORACLE, "op8_url_filters": URL_ORACLE, "op11_lexical_search": LEXICAL_ORACLE, "op13_source_divergence": DIVERGENCE_ORACLE}
