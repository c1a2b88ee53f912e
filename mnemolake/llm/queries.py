"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from mnemolake.llm import license_scan, line_dedup
from mnemolake.llm.alignment import op13_alignment
from mnemolake.llm.decontamination import op4_decontamination
from mnemolake.llm.fingerprints import op12_fingerprints
from mnemolake.llm.language_id import op9_language_id, op9_language_id_pages
from mnemolake.llm.license_scan import op8_license_scan
from mnemolake.llm.line_dedup import op3_line_dedup
from mnemolake.llm.near_dedup import op5_near_dedup
from mnemolake.llm.packing import op6_packing
from mnemolake.llm.spelling import op11_spelling_variants
from mnemolake.llm.suffix_dedup import op1_suffix_dedup
from mnemolake.llm.token_counts import op7_token_counts
from mnemolake.llm.token_files import op10_token_files
from mnemolake.llm.topk import op2_exact_topk

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_topk": op2_exact_topk,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_near_dedup": op5_near_dedup,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_license_scan": op8_license_scan,
    "op9_language_id": op9_language_id,
    "op9_language_id_pages": op9_language_id_pages,
    "op10_token_files": op10_token_files,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fingerprints": op12_fingerprints,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op8_license_scan": license_scan.ORACLE,
}
