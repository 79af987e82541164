"""The registered corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import centroids, line_templates, quality_rules, substring_dedup, vector_codes
from .byte_bpe import op10_byte_bpe
from .centroids import op11_centroids
from .line_templates import op6_line_templates
from .mixing import op8_mixing
from .pitman_yor import op7_pitman_yor
from .quality_classifier import op1_quality_classifier
from .quality_rules import op5_quality_rules
from .simhash import op9_simhash
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op3_suffix_dedup
from .syncmers import op4_syncmers
from .vector_codes import op13_vector_codes
from .word_bpe import op12_word_bpe

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_syncmers": op4_syncmers,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_templates": op6_line_templates,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_centroids": op11_centroids,
    "op12_word_bpe": op12_word_bpe,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE = {
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op6_line_templates": line_templates.ORACLE_SQL,
    "op11_centroids": centroids.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
