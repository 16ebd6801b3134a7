"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from granary.llm import linededup, media, mixing, neardup, packing, secrets, sharding, toxicity, vectors, warc

QUERIES = {
    "op1_fuzzy_lines": linededup.op1_fuzzy_lines,
    "op2_posting_lists": vectors.op2_posting_lists,
    "op3_ftrl_toxicity": toxicity.op3_ftrl_toxicity,
    "op4_secret_ledger": secrets.op4_secret_ledger,
    "op5_hypergeometric_shuffle": sharding.op5_hypergeometric_shuffle,
    "op6_block_mix": mixing.op6_block_mix,
    "op7_avi_mjpeg": media.op7_avi_mjpeg,
    "op8_spf_packing": packing.op8_spf_packing,
    "op9_chosen_path": neardup.op9_chosen_path,
    "op10_warc_archive": warc.op10_warc_archive,
}

ORACLES = {"op4_secret_ledger": secrets.ORACLE, "op10_warc_archive": warc.ORACLE}
