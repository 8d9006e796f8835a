"""The queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from .compaction import OP6_SQL, op6_compaction
from .decontaminate import op8_decontamination
from .jaccard_join import op10_jaccard
from .language_id import op9_language_id
from .license_scan import op7_licenses
from .multiset_hash import op2_fingerprints
from .packing import op1_packing
from .personal_data import op11_personal_data
from .quality_cnn import op3_quality
from .repair import op13_repair
from .token_counts import op5_token_counts
from .warc import OP4_SQL, op4_warc
from .whitening import op12_whitening

QUERIES = {
    "op1_packing": op1_packing,
    "op2_fingerprints": op2_fingerprints,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_token_counts": op5_token_counts,
    "op6_compaction": op6_compaction,
    "op7_licenses": op7_licenses,
    "op8_decontamination": op8_decontamination,
    "op9_language_id": op9_language_id,
    "op10_jaccard": op10_jaccard,
    "op11_personal_data": op11_personal_data,
    "op12_whitening": op12_whitening,
    "op13_repair": op13_repair,
}

ORACLE_SQL: dict[str, str] = {"op4_warc": OP4_SQL, "op6_compaction": OP6_SQL}
