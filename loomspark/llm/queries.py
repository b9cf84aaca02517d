"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from loomspark.llm import ann, decontaminate, embed_dedup, filter_audit, langid, line_dedup, mixing, ngram_join, packing, pii, secrets, vector_codes, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_packing": packing.op2_packing,
    "op3_warc": warc.op3_warc,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_ann": ann.op5_ann,
    "op6_embedding_dedup": embed_dedup.op6_embedding_dedup,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_pii": pii.op8_pii,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_language_id": langid.op10_language_id,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_decontaminate": decontaminate.op12_decontaminate,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_warc": warc.ORACLE,
    "op6_embedding_dedup": embed_dedup.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_decontaminate": decontaminate.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
