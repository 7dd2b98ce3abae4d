"""The text queries by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_bpe
from .chat import op5_chat_format
from .decontamination import OP9_SQL, op9_decontamination
from .filter_audit import OP11_SQL, op11_filter_audit
from .html_text import op6_html_text
from .jaccard_join import op4_jaccard_join
from .language_id import op12_language_id
from .licenses import op7_license_scan
from .lm_scoring import op10_lm_scoring
from .quality import OP8_SQL, op8_quality_rules
from .secrets import op2_secret_scan
from .sharding import op1_sharding
from .spelling import op13_spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_secret_scan": op2_secret_scan,
    "op3_bpe": op3_bpe,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_chat_format": op5_chat_format,
    "op6_html_text": op6_html_text,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_filter_audit": op11_filter_audit,
    "op12_language_id": op12_language_id,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op8_quality_rules": OP8_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_filter_audit": OP11_SQL,
}
