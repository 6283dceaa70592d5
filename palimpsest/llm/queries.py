"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, factorisation, fmindex, licenses, minhash, mixing, rules, suffix, vptree, warc

QUERIES = {
    "op1_warc_derivatives": warc.op1_warc_derivatives,
    "op2_suffix_array_dedup": suffix.op2_suffix_array_dedup,
    "op3_factorisation_machine": factorisation.op3_factorisation_machine,
    "op4_vp_tree_neighbours": vptree.op4_vp_tree_neighbours,
    "op4_exact_neighbours": vptree.op4_exact_neighbours,
    "op5_adaptive_quality_rules": rules.op5_adaptive_quality_rules,
    "op6_hash_threshold_mixing": mixing.op6_hash_threshold_mixing,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_fm_index_substring_dedup": fmindex.op8_fm_index_substring_dedup,
    "op9_license_scan": licenses.op9_license_scan,
    "op9_license_scan_wrapped": licenses.op9_license_scan_wrapped,
    "op10_minhash_near_dedup": minhash.op10_minhash_near_dedup,
}

ORACLES = {
    "op1_warc_derivatives": warc.ORACLE,
    "op4_exact_neighbours": vptree.ORACLE,
    "op5_adaptive_quality_rules": rules.ORACLE,
    "op6_hash_threshold_mixing": mixing.ORACLE,
    "op9_license_scan": licenses.ORACLE,
}
