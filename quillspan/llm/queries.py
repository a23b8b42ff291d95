"""The queries of this package and their SQL."""

from __future__ import annotations

from quillspan.llm import bpe, decontam, quality, sharding, simhash, substring, toxicity, urlfilter, wavelet
from quillspan.llm import license as licenses


def queries() -> dict:
    return {
        "op1_simhash_pivots": simhash.op1,
        "op2_distribution_divergence": quality.op2,
        "op3_license_dice": licenses.op3,
        "op4_url_range_join": urlfilter.op4,
        "op5_wavelet_shards": wavelet.op5,
        "op6_difference_cover": substring.op6,
        "op7_pigeonhole_edits": decontam.op7,
        "op8_bpe_tree": bpe.op8,
        "op9_stratified_interleaving": sharding.op9,
        "op10_toxicity_trees": toxicity.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_distribution_divergence": quality.OP2_SQL,
        "op3_license_dice": licenses.OP3_SQL,
        "op4_url_range_join": urlfilter.OP4_SQL,
    }
