"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from worktally.llm import bpe, langid, mixing, negatives, quality, repeats, secrets, shards, simhash, spelling, topk, url_rules, vector_copies

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_shards": shards.op2_shards,
    "op3_url_rules": url_rules.op3_url_rules,
    "op4_langid": langid.op4_langid,
    "op5_bpe": bpe.op5_bpe,
    "op6_mixing": mixing.op6_mixing,
    "op7_simhash": simhash.op7_simhash,
    "op8_repeats": repeats.op8_repeats,
    "op9_vector_copies": vector_copies.op9_vector_copies,
    "op10_quality": quality.op10_quality,
    "op11_spelling": spelling.op11_spelling,
    "op12_negatives": negatives.op12_negatives,
    "op13_secrets": secrets.op13_secrets,
}

ORACLES = {
    "op1_topk": topk.OP1_SQL,
    "op3_url_rules": url_rules.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op12_negatives": negatives.OP12_SQL,
    "op13_secrets": secrets.OP13_SQL,
}
