"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .decontamination import op4_benchmark_decontamination
from .jaccard_join import OP8_SQL, op8_ngram_jaccard_join
from .license_scan import op6_license_scans
from .line_crf import op5_quality_classifier
from .line_spread import OP9_SQL, op9_line_spread
from .lm_scoring import op2_lm_scoring
from .mixing import op7_mixing_sources
from .quality_rules import OP3_SQL, op3_quality_rules
from .token_blocks import op10_token_blocks
from .url_filter import op1_url_filters

QUERIES = {f.__name__: f for f in (op1_url_filters, op2_lm_scoring, op3_quality_rules, op4_benchmark_decontamination, op5_quality_classifier, op6_license_scans, op7_mixing_sources, op8_ngram_jaccard_join, op9_line_spread, op10_token_blocks)}
SQL = {"op3_quality_rules": OP3_SQL, "op8_ngram_jaccard_join": OP8_SQL, "op9_line_spread": OP9_SQL}
