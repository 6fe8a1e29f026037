"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from seqloom.llm.embeddings import op8_embedding_dedup
from seqloom.llm.licenses import op6_license_scan
from seqloom.llm.lines import op9_line_dedup
from seqloom.llm.mixing import op3_mixing
from seqloom.llm.packing import op4_packing
from seqloom.llm.quality_classifier import op2_quality_classifier
from seqloom.llm.quality_rules import op5_quality_rules
from seqloom.llm.repeats import op1_suffix_dedup
from seqloom.llm.simhash import op7_simhash
from seqloom.llm.toxicity import op10_toxicity

OPERATORS = (
    op1_suffix_dedup, op2_quality_classifier, op3_mixing, op4_packing, op5_quality_rules,
    op6_license_scan, op7_simhash, op8_embedding_dedup, op9_line_dedup, op10_toxicity,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {}
