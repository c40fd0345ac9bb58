"""The queries of the operators of this package, and what SQL says about them."""

from __future__ import annotations

from voyage.llm.decontamination import ORACLE_OP9, op9_decontamination
from voyage.llm.graph_dedup import ORACLE_OP12, op12_embedding_near_dedup
from voyage.llm.line_dedup import ORACLE_OP2, op2_line_dedup
from voyage.llm.merkle import ORACLE_OP11, op11_merkle_manifest
from voyage.llm.ngram_jaccard import ORACLE_OP1, op1_ngram_jaccard_join
from voyage.llm.packing import op10_best_fit_packing
from voyage.llm.periodic_runs import ORACLE_OP13, op13_periodic_runs
from voyage.llm.pii import op6_pii
from voyage.llm.sharding import ORACLE_OP7, op7_sharding
from voyage.llm.suffix_dedup import ORACLE_OP3, op3_suffix_dedup
from voyage.llm.topk_search import ORACLE_OP5, op5_topk_search
from voyage.llm.toxicity import op8_toxicity
from voyage.llm.url_filter import op4_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_line_dedup, op3_suffix_dedup, op4_url_filter, op5_topk_search,
        op6_pii, op7_sharding, op8_toxicity, op9_decontamination, op10_best_fit_packing,
        op11_merkle_manifest, op12_embedding_near_dedup, op13_periodic_runs,
    )
}

ORACLE = {
    "op1_ngram_jaccard_join": ORACLE_OP1, "op2_line_dedup": ORACLE_OP2, "op3_suffix_dedup": ORACLE_OP3, "op5_topk_search": ORACLE_OP5,
    "op7_sharding": ORACLE_OP7, "op9_decontamination": ORACLE_OP9,
    "op11_merkle_manifest": ORACLE_OP11, "op12_embedding_near_dedup": ORACLE_OP12, "op13_periodic_runs": ORACLE_OP13,
}
