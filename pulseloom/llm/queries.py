"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pulseloom.llm.collocations import OP11_SQL, op11_phrase_collocations
from pulseloom.llm.decontamination import op7_decontamination
from pulseloom.llm.jaccard_join import OP12_SQL, op12_jaccard_join
from pulseloom.llm.language_id import op3_language_id
from pulseloom.llm.license_scan import OP8_LINES_SQL, OP8_SQL, op8_license_lines, op8_license_scan
from pulseloom.llm.minhash_dedup import OP6_SQL, op6_minhash_dedup
from pulseloom.llm.pii import op5_pii
from pulseloom.llm.quality_rules import OP9_ABLATION_SQL, OP9_SQL, op9_ablation, op9_quality_rules
from pulseloom.llm.secret_scan import op1_secret_scan
from pulseloom.llm.sharding import op2_sharding
from pulseloom.llm.source_mix import OP10_SQL, op10_source_mix
from pulseloom.llm.spelling import op13_spelling_variants
from pulseloom.llm.token_ids import op4_token_ids

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_sharding": op2_sharding,
    "op3_language_id": op3_language_id,
    "op4_token_ids": op4_token_ids,
    "op5_pii": op5_pii,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op8_license_lines": op8_license_lines,
    "op9_quality_rules": op9_quality_rules,
    "op9_ablation": op9_ablation,
    "op10_source_mix": op10_source_mix,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {
    "op6_minhash_dedup": OP6_SQL,
    "op8_license_scan": OP8_SQL,
    "op8_license_lines": OP8_LINES_SQL,
    "op9_quality_rules": OP9_SQL,
    "op9_ablation": OP9_ABLATION_SQL,
    "op10_source_mix": OP10_SQL,
    "op11_phrase_collocations": OP11_SQL,
    "op12_jaccard_join": OP12_SQL,
}
