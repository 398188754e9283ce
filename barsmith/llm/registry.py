"""Queries and SQL of the corpus operators, for __spark_entry__.py."""

from __future__ import annotations

from . import op1_urls, op2_rans, op3_packing, op4_mixing, op5_jaccard, op6_rules, op7_neighbours, op8_quality, op9_count, op10_langid, op11_winnow, op12_audit, op13_dominance

QUERIES = {
    "op1_urls": op1_urls.op1_urls,
    "op2_rans": op2_rans.op2_rans,
    "op3_packing": op3_packing.op3_packing,
    "op4_mixing": op4_mixing.op4_mixing,
    "op5_jaccard": op5_jaccard.op5_jaccard,
    "op6_rules": op6_rules.op6_rules,
    "op7_neighbours": op7_neighbours.op7_neighbours,
    "op8_quality": op8_quality.op8_quality,
    "op9_count": op9_count.op9_count,
    "op10_langid": op10_langid.op10_langid,
    "op11_winnow": op11_winnow.op11_winnow,
    "op12_audit": op12_audit.op12_audit,
    "op13_dominance": op13_dominance.op13_dominance,
}
ORACLES: dict[str, str] = {
    "op1_urls": op1_urls.ORACLE,
    "op4_mixing": op4_mixing.ORACLE,
    "op12_audit": op12_audit.ORACLE,
    "op13_dominance": op13_dominance.ORACLE,
}
