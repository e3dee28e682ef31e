"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from spindrift.llm import cosine, forest, langid, lattice, mixing, packing, quality, simhash, toxicity, warc

QUERIES = {
    "op1_lattice": lattice.op1_lattice,
    "op2_mixing": mixing.op2_mixing,
    "op3_packing": packing.op3_packing,
    "op4_simhash": simhash.op4_simhash,
    "op5_embedding_dedup": cosine.op5_embedding_dedup,
    "op6_nearest": forest.op6_nearest,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_langid": langid.op8_langid,
    "op9_warc": warc.op9_warc,
    "op10_quality": quality.op10_quality,
}

ORACLES: dict[str, str] = {"op5_embedding_dedup": cosine.OP5_SQL, "op9_warc": warc.OP9_SQL}
