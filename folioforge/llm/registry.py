"""The queries of this subpackage and their oracles."""

from __future__ import annotations

from folioforge.llm import bpe, decontaminate, embeddings, fingerprints, packing, pii, runs, secrets, simhash, substrings, toxicity, urlrules, variants

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_bpe": bpe.op2_bpe,
    "op3_substrings": substrings.op3_substrings,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pii": pii.op5_pii,
    "op6_packing": packing.op6_packing,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_url_filters": urlrules.op8_url_filters,
    "op9_embeddings": embeddings.op9_embeddings,
    "op10_secrets": secrets.op10_secrets,
    "op11_runs": runs.op11_runs,
    "op12_decontamination": decontaminate.op12_decontamination,
    "op13_variants": variants.op13_variants,
}

ORACLES = {"op3_substrings": substrings.ORACLE_SQL, "op8_url_filters": urlrules.ORACLE_SQL, "op9_embeddings": embeddings.ORACLE_SQL, "op12_decontamination": decontaminate.ORACLE_SQL, "op13_variants": variants.ORACLE_SQL}
