"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from colloquy.llm.decontaminate import OP10_SQL, op10_decontaminate
from colloquy.llm.divergence import OP13_SQL, op13_divergence
from colloquy.llm.language_model import op7_language_model
from colloquy.llm.lexical import OP11_SQL, op11_search
from colloquy.llm.mixing import op9_mix
from colloquy.llm.private import op5_private
from colloquy.llm.quality import op8_quality
from colloquy.llm.recompress import OP2_SQL, op2_recompression
from colloquy.llm.simhash import op1_simhash
from colloquy.llm.tokens import op3_token_files, op4_token_counts
from colloquy.llm.topk import OP6_SQL, op6_top_k
from colloquy.llm.urls import op12_url_filters

QUERIES = {f.__name__: f for f in (op1_simhash, op2_recompression, op3_token_files, op4_token_counts, op5_private, op6_top_k, op7_language_model, op8_quality, op9_mix, op10_decontaminate, op11_search, op12_url_filters, op13_divergence)}
ORACLES = {"op2_recompression": OP2_SQL, "op6_top_k": OP6_SQL, "op10_decontaminate": OP10_SQL, "op11_search": OP11_SQL, "op13_divergence": OP13_SQL}
