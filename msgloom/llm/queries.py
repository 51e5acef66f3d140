"""The registered queries of this subpackage and their SQL."""

from msgloom.llm.ans_files import op8_ans_files
from msgloom.llm.bpe import op2_byte_bpe
from msgloom.llm.collocations import OP11_SQL, op11_collocations
from msgloom.llm.decontaminate import op10_decontaminate
from msgloom.llm.language_id import op9_language_id
from msgloom.llm.license_scan import op3_license
from msgloom.llm.near_dup import op7_near_dup
from msgloom.llm.ngram_join import op12_ngram_join
from msgloom.llm.pii import op6_pii
from msgloom.llm.quality import op5_quality
from msgloom.llm.ranked_search import OP13_SQL, op13_ranked_search
from msgloom.llm.secret_scan import op4_secrets
from msgloom.llm.topk_search import OP1_SQL, op1_topk_search

QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_license": op3_license,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_pii": op6_pii,
    "op7_near_dup": op7_near_dup,
    "op8_ans_files": op8_ans_files,
    "op9_language_id": op9_language_id,
    "op10_decontaminate": op10_decontaminate,
    "op11_collocations": op11_collocations,
    "op12_ngram_join": op12_ngram_join,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES = {"op1_topk_search": OP1_SQL, "op11_collocations": OP11_SQL, "op13_ranked_search": OP13_SQL}
