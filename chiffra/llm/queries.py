"""The queries of this subpackage and their SQL."""

from chiffra.llm import audit, cuckoo, decontam, fixity, licenses, lmscore, mixing, neardup, quality, sharding, tokencount, urls, yinyang

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_lm_scores": lmscore.op2_lm_scores,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_fixity_audit": fixity.op4_fixity_audit,
    "op5_token_counts": tokencount.op5_token_counts,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_near_dedup": neardup.op7_near_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_url_filter": urls.op9_url_filter,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_exact_dedup": cuckoo.op12_exact_dedup,
    "op13_centroid_clusters": yinyang.op13_centroid_clusters,
}
ORACLE_SQL = {**audit.SQL, **cuckoo.SQL, **fixity.SQL, **licenses.SQL, **urls.SQL, **yinyang.SQL}
