"""The corpus operators' queries, by name; ORACLES has the SQL of those that SQL can express."""

from __future__ import annotations

from . import dac, graph_ann, hard_negatives, langid, lexical, licenses, packing, pii, simhash, spotsigs, suffix_pieces, superkmer, token_counts

QUERIES = {
    "op1_simhash": simhash.op1,
    "op2_sentencepiece": suffix_pieces.op2,
    "op3_nearest": graph_ann.op3,
    "op4_packing": packing.op4,
    "op5_language": langid.op5,
    "op6_substrings": superkmer.op6,
    "op7_spotsigs": spotsigs.op7,
    "op8_licenses": licenses.op8,
    "op9_token_ids": dac.op9,
    "op10_pii": pii.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_token_counts": token_counts.op12,
    "op13_lexical": lexical.op13,
}
ORACLES: dict[str, str] = {
    "op6_substrings": superkmer.ORACLE,
    "op7_spotsigs": spotsigs.ORACLE,
    "op8_licenses": licenses.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op13_lexical": lexical.ORACLE,
}
