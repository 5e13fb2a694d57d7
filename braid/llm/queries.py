"""The queries of this subpackage, by name, and their SQL."""
from __future__ import annotations

from braid.llm import bpe, exact_dedup, licenses, line_dedup, media, mixing, pii, simhash, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_simhash": simhash.op5_simhash,
        "op6_license_scan": licenses.op6_license_scan,
        "op6_license_forms": licenses.op6_license_forms,
        "op7_mixing": mixing.op7_mixing,
        "op7_mixing_passes": mixing.op7_mixing_passes,
        "op8_pii": pii.op8_pii,
        "op9_media": media.op9_media,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op4_substring_dedup": substring_dedup.OP4_SQL,
        "op6_license_scan": licenses.OP6_SQL,
        "op6_license_forms": licenses.OP6_FORMS_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op10_line_dedup": line_dedup.OP10_SQL,
    }
