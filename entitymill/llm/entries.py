"""The queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from .byte_bpe import op8_byte_bpe
from .chat_views import OP3_SQL, op3_chat_views
from .fingerprints import op7_fingerprints
from .html_text import OP4_SQL, op4_html_text
from .near_dedup import OP1_SQL, op1_near_dedup
from .packing import op2_packing
from .personal_data import op9_personal_data
from .quality_rules import op10_quality_rules
from .ranked_search import OP12_SQL, op12_ranked_search
from .secret_scan import op6_secret_scan
from .subword_classifier import op5_quality_classifier
from .turn_repair import OP13_SQL, op13_turn_repair
from .window_packing import op11_window_packing

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_packing": op2_packing,
    "op3_chat_views": op3_chat_views,
    "op4_html_text": op4_html_text,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_secret_scan": op6_secret_scan,
    "op7_fingerprints": op7_fingerprints,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_personal_data": op9_personal_data,
    "op10_quality_rules": op10_quality_rules,
    "op11_window_packing": op11_window_packing,
    "op12_ranked_search": op12_ranked_search,
    "op13_turn_repair": op13_turn_repair,
}

ORACLES: dict[str, str] = {"op1_near_dedup": OP1_SQL, "op3_chat_views": OP3_SQL, "op4_html_text": OP4_SQL, "op12_ranked_search": OP12_SQL, "op13_turn_repair": OP13_SQL}
