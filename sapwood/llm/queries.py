"""The training-data queries by name, with SQL where SQL can express them."""

from __future__ import annotations

from . import embedding_dedup, jaccard_join, licences, media, mixing, packing, quality, secrets, suffix_dedup, toxicity


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_licence_scan": licences.query,
        "op2_jaccard_join": jaccard_join.query,
        "op3_toxicity": toxicity.query,
        "op4_suffix_dedup": suffix_dedup.query,
        "op5_secrets": secrets.query,
        "op6_embedding_dedup": embedding_dedup.query,
        "op7_packing": packing.query,
        "op8_quality": quality.query,
        "op9_media": media.query,
        "op10_mix_sources": mixing.query,
    }


def oracle_sql() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
