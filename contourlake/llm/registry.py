"""The queries of this subpackage and their SQL, by the names that the entry module registers."""

from __future__ import annotations

from . import epsjoin, fingerprints, lines, maxscore, merkle, mixing, packing, probminhash, quality, rindex, toxicity, whitening, wrappers


def queries() -> dict:
    return {
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_mixing": mixing.op3_mixing,
        "op4_epsilon_join": epsjoin.op4_epsilon_join,
        "op5_line_dedup": lines.op5_line_dedup,
        "op6_wrappers": wrappers.op6_wrappers,
        "op7_near_dedup": probminhash.op7_near_dedup,
        "op8_packing": packing.op8_packing,
        "op9_repeats": rindex.op9_repeats,
        "op10_quality": quality.op10_quality,
        "op11_max_score": maxscore.op11_max_score,
        "op12_manifest": merkle.op12_manifest,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": lines.OP5_SQL, "op11_max_score": maxscore.OP11_SQL, "op12_manifest": merkle.OP12_SQL}
