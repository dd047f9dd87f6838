"""The queries of this package and their oracles, as __spark_entry__ adds them."""

from __future__ import annotations

from . import lm, mixing, ogg, packing, sharding, simhash, token_files, topk, toxicity, url_graph

QUERIES = {
    "op1_ogg_media": ogg.op1_ogg_media,
    "op2_url_graph": url_graph.op2_url_graph,
    "op3_packing": packing.op3_packing,
    "op4_simhash": simhash.op4_simhash,
    "op5_mixing": mixing.op5_mixing,
    "op6_topk": topk.op6_topk,
    "op7_lm": lm.op7_lm,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_sharding": sharding.op9_sharding,
    "op10_token_files": token_files.op10_token_files,
}
ORACLES = {
    "op2_url_graph": url_graph.oracle(),
    "op5_mixing": mixing.oracle(),
    "op6_topk": topk.oracle(),
    "op9_sharding": sharding.oracle(),
}
