"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from tidesmith.llm import bpe, decontaminate, fim, langid, linededup, neardup, packing, pii, quality, resample, suffixdedup, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_line_dedup": linededup.op2,
    "op3_near_duplicates": neardup.op3,
    "op4_decontamination": decontaminate.op4,
    "op5_suffix_array_dedup": suffixdedup.op5,
    "op6_language_id": langid.op6,
    "op7_quality": quality.op7,
    "op8_packing": packing.op8,
    "op9_personal_data": pii.op9,
    "op10_top_k": topk.op10,
    "op11_resampling": resample.op11,
    "op12_fill_in_middle": fim.op12,
    "op13_bpe": bpe.op13,
}
ORACLE_SQL = {"op2_line_dedup": linededup.OP2_SQL, "op4_decontamination": decontaminate.OP4_SQL, "op10_top_k": topk.OP10_SQL, "op12_fill_in_middle": fim.OP12_SQL}
