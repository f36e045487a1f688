"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, language_id, licenses, lm_scoring, mixing, near_dedup, packing, pii, warc


def queries() -> dict:
    return {
        "op1_lm_scoring": lm_scoring.op1_lm_scoring,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_language_id": language_id.op3_language_id,
        "op4_pii": pii.op4_pii,
        "op5_pack": packing.op5_pack,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_warc": warc.op7_warc,
        "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
        "op9_licenses": licenses.op9_licenses,
        "op10_mix_sources": mixing.op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.OP2_SQL, "op6_near_dedup": near_dedup.OP6_SQL, "op7_warc": warc.OP7_SQL, "op8_embedding_dedup": embedding_dedup.OP8_SQL}
