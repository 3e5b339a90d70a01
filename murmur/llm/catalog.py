"""The queries of this subpackage: one for each operator, and line dedup also of short lines."""

from __future__ import annotations

from murmur.llm.alignment import op11_token_alignment
from murmur.llm.bpe import op3_byte_bpe
from murmur.llm.decontaminate import op5_decontaminate
from murmur.llm.jaccard_join import op1_jaccard_join
from murmur.llm.language_id import op8_language_id
from murmur.llm.line_dedup import op6_line_dedup, op6_line_dedup_all
from murmur.llm.lm import op9_lm_scoring
from murmur.llm.neighbours import op12_nearest_neighbours
from murmur.llm.oracle import ORACLE
from murmur.llm.quality import op4_quality_classifier
from murmur.llm.quality_rules import op10_quality_rules
from murmur.llm.repeats import op2_suffix_dedup
from murmur.llm.sharding import op7_sharding
from murmur.llm.whitening import op13_embedding_whitening

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {f.__name__: f for f in (
    op1_jaccard_join, op2_suffix_dedup, op3_byte_bpe, op4_quality_classifier, op5_decontaminate, op6_line_dedup, op6_line_dedup_all, op7_sharding, op8_language_id, op9_lm_scoring, op10_quality_rules,
    op11_token_alignment, op12_nearest_neighbours, op13_embedding_whitening)}
