"""The subpackage's queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from siteweave.llm import alignment, ann, bpe, decontamination, hpylm, langid, packing, sharding, simhash, sstable, suffixdedup, topk, whitening

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_simhash": simhash.op2_simhash,
    "op3_sharding": sharding.op3_sharding,
    "op4_hpylm": hpylm.op4_hpylm,
    "op5_langid": langid.op5_langid,
    "op6_ann": ann.op6_ann,
    "op7_bpe": bpe.op7_bpe,
    "op8_packing": packing.op8_packing,
    "op9_suffixdedup": suffixdedup.op9_suffixdedup,
    "op10_sstable": sstable.op10_sstable,
    "op11_whitening": whitening.op11_whitening,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {"op1_topk": topk.ORACLE, "op3_sharding": sharding.ORACLE, "op12_decontamination": decontamination.ORACLE}
