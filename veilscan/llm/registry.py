"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, embeddings, exact_dedup, langid, mixing, pii, quality, secrets, simhash, toxicity

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_bpe": bpe.op2_bpe,
    "op3_pii": pii.op3_pii,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_simhash": simhash.op6_simhash,
    "op7_embeddings": embeddings.op7_embeddings,
    "op8_secrets": secrets.op8_secrets,
    "op9_quality": quality.op9_quality,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

#: The others can't be expressed in SQL (or count hashes that it lacks); tests hold them against brute force.
SQL = {"op4_mix_sources": mixing.OP4_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL}
