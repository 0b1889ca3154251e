"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from ferrolith.llm.byte_cnn import op7_quality_classifier
from ferrolith.llm.byte_pairs import op11_byte_pairs
from ferrolith.llm.language_model import OP4_SQL, op4_lm_scores
from ferrolith.llm.licenses import op5_license_scan
from ferrolith.llm.line_dedup import OP1_SQL, op1_line_dedup
from ferrolith.llm.merkle import OP12_SQL, op12_merkle_manifest
from ferrolith.llm.mixing import OP8_SQL, op8_source_mixing
from ferrolith.llm.near_duplicates import OP6_SQL, op6_near_duplicates
from ferrolith.llm.neighbours import op10_nearest_neighbours
from ferrolith.llm.periodic_runs import op13_periodic_runs
from ferrolith.llm.quality_rules import op9_quality_rules
from ferrolith.llm.segmentations import op2_sentencepiece_sampling
from ferrolith.llm.token_files import op3_token_files

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sentencepiece_sampling": op2_sentencepiece_sampling,
    "op3_token_files": op3_token_files,
    "op4_lm_scores": op4_lm_scores,
    "op5_license_scan": op5_license_scan,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op4_lm_scores": OP4_SQL,
    "op6_near_duplicates": OP6_SQL,
    "op8_source_mixing": OP8_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
