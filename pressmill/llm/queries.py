"""Registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from pressmill.llm import (byte_bpe, centroid_clusters, exact_dedup, language_id, license_scan, lm_scoring, merkle_manifest,
                           near_dedup, packing, prefix_fingerprint, quality, sharding, url_filter)


def pipeline(spark, sf_dir):
    """The top-level pipeline, which is shipped beside the package."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op2_prefix_fingerprint": prefix_fingerprint.op2_prefix_fingerprints,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_sharding": sharding.op7_shards,
    "op8_language_id": language_id.op8_language_id,
    "op9_quality": quality.op9_quality,
    "op10_packing": packing.op10_packing,
    "op11_centroid_clusters": centroid_clusters.op11_centroid_clusters,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_license_scan": license_scan.op13_license_scan,
    "pipeline": pipeline,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op11_centroid_clusters": centroid_clusters.OP11_SQL,
    "op12_merkle_manifest": merkle_manifest.OP12_SQL,
}
