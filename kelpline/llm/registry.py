"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, fingerprints, jaccard, neighbours, packing, pii, quality, resampling, runs, secrets, toxicity, warc

QUERIES = {
    "op1_document_fingerprints": fingerprints.query,
    "op2_secret_scans": secrets.query,
    "op3_preference_formatting": chat.query,
    "op4_warc_revisits": warc.query,
    "op5_bpe_transducer": bpe.query,
    "op6_feistel_pseudonyms": pii.query,
    "op7_best_fit_packing": packing.query,
    "op8_jaccard_join": jaccard.query,
    "op9_quality_outliers": quality.query,
    "op10_toxicity": toxicity.query,
    "op11_importance_resampling": resampling.query,
    "op12_periodic_runs": runs.query,
    "op13_nearest_neighbours": neighbours.query,
}

ORACLES = {
    "op3_preference_formatting": chat.ORACLE,
}
