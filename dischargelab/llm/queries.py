"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from dischargelab.llm import align, ann, bpe, fim, langid, line_dedup, minhash, packing, pii, sharding, simhash, substring_dedup, topk

QUERIES = {
    "op1_bpe": bpe.op1,
    "op2_line_dedup": line_dedup.op2,
    "op3_simhash": simhash.op3,
    "op4_topk": topk.op4,
    "op5_langid": langid.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_sharding": sharding.op7,
    "op8_packing": packing.op8,
    "op9_ann": ann.op9,
    "op10_pii": pii.op10,
    "op11_minhash": minhash.op11,
    "op12_align": align.op12,
    "op13_fim": fim.op13,
}
ORACLES = {
    "op4_topk": topk.OP4_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op11_minhash": minhash.OP11_SQL,
    "op13_fim": fim.OP13_SQL,
}
