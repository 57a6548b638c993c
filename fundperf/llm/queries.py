"""The registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import document_fingerprints, hard_negatives, quality_rules, substring_dedup
from .decontamination import op2_decontamination
from .document_fingerprints import op13_document_fingerprints
from .hard_negatives import op11_hard_negatives
from .license_scan import op5_license_scan
from .packing import op9_packing
from .periodic_runs import op12_periodic_runs
from .quality_classifier import op8_quality_classifier
from .quality_rules import op7_quality_rules
from .sharding import op6_sharding
from .simhash import op10_simhash
from .substring_dedup import op4_substring_dedup
from .token_counts import op3_token_counts
from .url_filter import op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_document_fingerprints": op13_document_fingerprints,
}

ORACLES: dict[str, str] = {
    "op4_substring_dedup": substring_dedup.ORACLE_SQL,
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_document_fingerprints": document_fingerprints.ORACLE_SQL,
}
