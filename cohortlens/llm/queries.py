"""Registered queries of this package and the SQL that DuckDB can check them with."""

from __future__ import annotations

import corpus_pipeline
from cohortlens.llm import (
    byte_bpe,
    embedding_dedup,
    language_id,
    lexical_search,
    license_scan,
    minhash_dedup,
    packing,
    pii,
    quality_rules,
    sharding,
    suffix_dedup,
    url_filter,
    vector_codes,
)

QUERIES = {
    "op1_minhash_dedup": minhash_dedup.query,
    "op2_byte_bpe": byte_bpe.query,
    "op3_jump_sharding": sharding.query,
    "op4_url_filter": url_filter.query,
    "op5_pii": pii.query,
    "op6_license_scan": license_scan.query,
    "op6_license_tree": license_scan.tree_query,
    "op7_quality_rules": quality_rules.query,
    "op8_language_id": language_id.query,
    "op9_embedding_dedup": embedding_dedup.query,
    "op10_packing": packing.query,
    "op11_lexical_search": lexical_search.query,
    "op12_suffix_dedup": suffix_dedup.query,
    "op13_vector_codes": vector_codes.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op4_url_filter": url_filter.ORACLE,
    "op6_license_scan": license_scan.ORACLE,
    "op6_license_tree": license_scan.TREE_ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op9_embedding_dedup": embedding_dedup.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_suffix_dedup": suffix_dedup.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
