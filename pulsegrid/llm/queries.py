"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from .golay_simhash import op5_query
from .html_template import op11_query
from .huffman import op9_query
from .importance import OP13_SQL, op13_query
from .lexical import OP12_SQL, op12_query
from .line_dedup import OP1_SQL, op1_query
from .multi_index import op2_query
from .packing import op6_query
from .pii import op4_query
from .quality import op7_query
from .top_k import OP8_SQL, op8_query
from .toxicity import op3_query
from .word_bpe import op10_query

QUERIES = {
    "op1_line_dedup": op1_query,
    "op2_multi_index": op2_query,
    "op3_toxicity_chain": op3_query,
    "op4_pii_disclosure": op4_query,
    "op5_simhash_golay": op5_query,
    "op6_nnls_packing": op6_query,
    "op7_quality_qda": op7_query,
    "op8_exact_top_k": op8_query,
    "op9_huffman_tokens": op9_query,
    "op10_word_bpe": op10_query,
    "op11_html_template": op11_query,
    "op12_block_max_search": op12_query,
    "op13_importance_resampling": op13_query,
}
SQL = {
    "op1_line_dedup": OP1_SQL,
    "op8_exact_top_k": OP8_SQL,
    "op12_block_max_search": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
