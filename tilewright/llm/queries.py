"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from tilewright.llm import (decontaminate, merkle, mixing, pii, quality, repeats, secret_scan, setsketch, sharding, spelling,
                            suffix_tree, toxicity, warc)

QUERIES = {
    "op1_suffix_tree": suffix_tree.op1,
    "op2_nb_char_ngrams": toxicity.op2,
    "op3_secret_automaton": secret_scan.op3,
    "op4_latent_retrieval": decontaminate.op4,
    "op5_setsketch": setsketch.op5,
    "op6_sampled_splitters": sharding.op6,
    "op7_contextual_pii": pii.op7,
    "op8_water_filling": mixing.op8,
    "op9_seekable_warc": warc.op9,
    "op10_likelihood_ratio": quality.op10,
    "op11_doubling_repeats": repeats.op11,
    "op12_edit_tiles": spelling.op12,
    "op13_merkle_climb": merkle.op13,
}

ORACLES = {
    "op5_setsketch": setsketch.OP5_SQL,
    "op8_water_filling": mixing.OP8_SQL,
    "op9_seekable_warc": warc.OP9_SQL,
    "op11_doubling_repeats": repeats.OP11_SQL,
    "op12_edit_tiles": spelling.OP12_SQL,
    "op13_merkle_climb": merkle.OP13_SQL,
}
