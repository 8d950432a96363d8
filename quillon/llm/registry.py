"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from .decontam import OP6_SQL, op6_decontamination
from .gbt import op3_quality_classifier
from .importance import OP12_SQL, op12_importance_resampling
from .lbl import op7_language_model
from .linededup import OP5_SQL, op5_line_dedup
from .neardup import op4_near_duplicates
from .packing import op10_best_fit_packing
from .pii import op13_personal_data
from .rans import op2_rans_blocks
from .rules import OP1_SQL, op1_quality_rules
from .suffixdedup import op8_suffix_dedup
from .vectorcodes import OP11_SQL, op11_vector_codes
from .wordpiece import op9_token_counts

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_rans_blocks": op2_rans_blocks,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_language_model": op7_language_model,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_personal_data": op13_personal_data,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_quality_rules": OP1_SQL, "op5_line_dedup": OP5_SQL, "op6_decontamination": OP6_SQL, "op11_vector_codes": OP11_SQL, "op12_importance_resampling": OP12_SQL}
