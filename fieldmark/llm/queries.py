"""The queries of this subpackage, for registration in ``__spark_entry__``."""

from __future__ import annotations

from .alignment import op13_alignment
from .exact_dedup import OP11_SQL, op11_exact_dedup
from .gif import op8_gif_media
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .language_id import op6_language_id
from .lm_scoring import op3_lm_scoring
from .mixing import op7_soft_mixing
from .packing import op1_best_fit_packing
from .quality_classifier import op10_quality_classifier
from .quality_rules import op9_quality_rules
from .secrets import op4_secret_scan
from .simhash import op2_simhash_dedup
from .suffix_dedup import op5_suffix_dedup

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_secret_scan": op4_secret_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_soft_mixing": op7_soft_mixing,
    "op8_gif_media": op8_gif_media,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_alignment": op13_alignment,
}

#: The full rows of all others are beyond SQL; tests hold each against brute force, a round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op11_exact_dedup": OP11_SQL, "op12_hard_negatives": OP12_SQL}
