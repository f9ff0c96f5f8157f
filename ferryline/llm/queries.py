"""The queries of this subpackage, for ``__spark_entry__``: name -> function, name -> SQL."""

from __future__ import annotations

from . import ann, bpe, langid, lm, packing, secrets, simhash, substrings, topk, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_lm": lm.op2_lm,
    "op3_langid": langid.op3_langid,
    "op4_simhash": simhash.op4_simhash,
    "op5_topk": topk.op5_topk,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_ann": ann.op7_ann,
    "op8_packing": packing.op8_packing,
    "op9_substrings": substrings.op9_substrings,
    "op10_secrets": secrets.op10_secrets,
}
SQL: dict[str, str] = {"op5_topk": topk.OP5_SQL}
