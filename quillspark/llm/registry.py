"""The queries of this subpackage and their DuckDB twins."""

from . import op1_quality, op2_topk, op3_bpe, op4_simhash, op5_pii, op6_warc, op7_forest, op8_chat, op9_packing, op10_secrets

MODULES = (op1_quality, op2_topk, op3_bpe, op4_simhash, op5_pii, op6_warc, op7_forest, op8_chat, op9_packing, op10_secrets)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
