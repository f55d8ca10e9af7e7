"""The registered queries of this subpackage and their SQL twins, where SQL can express them."""

from contrail.llm import centroids, decontaminate, exact_dedup, language_id, license_scan, mixing, ngram_join, packing, quality, secret_scan, shard, suffix_dedup, token_alignment

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_decontamination": decontaminate.query,
    "op3_language_id": language_id.query,
    "op4_sharding": shard.query,
    "op5_suffix_array_dedup": suffix_dedup.query,
    "op6_quality": quality.query,
    "op7_mixing": mixing.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_secret_scan": secret_scan.query,
    "op10_license_scan": license_scan.query,
    "op11_sum_of_squares_packing": packing.query,
    "op12_token_alignment": token_alignment.query,
    "op13_centroid_clustering": centroids.query,
}

ORACLES = {"op8_exact_dedup": exact_dedup.SQL, "op13_centroid_clustering": centroids.SQL}
