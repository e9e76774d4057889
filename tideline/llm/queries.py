"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from tideline.llm import decontam, fingerprints, hamerly, langid, license_scan, minhash, mixing, sa_dedup, sharding, simhash, spelling, token_counts, url_filter
from tideline.llm.common import table
from tideline.llm.oracles import ORACLE_SQL  # noqa: F401


def op1_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_license_scans(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, table(spark, sf_dir, "labels")).drop("text")


def op5_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filters(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op10_suffix_array_dedup(spark, sf_dir):
    return sa_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark, sf_dir):
    return hamerly.cluster(table(spark, sf_dir, "embeddings"))


def op13_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_token_counts, op3_license_scans, op4_mixing, op5_decontamination,
        op6_url_filters, op7_simhash_near_dedup, op8_language_id, op9_sharding, op10_suffix_array_dedup,
        op11_spelling_variants, op12_centroid_clustering, op13_minhash_near_dedup,
    )
}
