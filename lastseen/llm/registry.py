"""The operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

import corpus_pipeline
from lastseen.llm.byte_pair import op10_byte_bpe
from lastseen.llm.conversation_repair import op11_conversation_repair
from lastseen.llm.line_dedup import OP7_SQL, op7_line_dedup
from lastseen.llm.mixing import OP4_SQL, op4_mixing
from lastseen.llm.near_dup import OP2_SQL, op2_near_dup
from lastseen.llm.outliers import op9_quality_rules
from lastseen.llm.personal_data import op1_personal_data
from lastseen.llm.prefix_free import op5_suffix_dedup
from lastseen.llm.quality_model import op3_quality_model
from lastseen.llm.site_style import op12_site_style
from lastseen.llm.spelling_variants import op13_spelling_variants
from lastseen.llm.token_files import op6_token_files
from lastseen.llm.topk import OP8_SQL, op8_exact_topk

QUERIES: dict[str, Callable[..., DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_near_dup": op2_near_dup,
    "op3_quality_model": op3_quality_model,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_files": op6_token_files,
    "op7_line_dedup": op7_line_dedup,
    "op8_exact_topk": op8_exact_topk,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_site_style": op12_site_style,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

#: Operators 1, 3, 5, 6 and 9 to 13 and the pipeline are checked against brute force.
ORACLES: dict[str, str] = {
    "op2_near_dup": OP2_SQL,
    "op4_mixing": OP4_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_exact_topk": OP8_SQL,
}
