"""The queries of the training-data operators and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from sentryspark.llm import byte_bpe, collocations, decontamination, exact_dedup, language_id, line_dedup, near_dedup, packing, personal_data, resampling, token_counts, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.url_filter_query,
    "op2_exact_dedup": exact_dedup.exact_dedup_query,
    "op3_near_dedup": near_dedup.near_dedup_query,
    "op4_byte_bpe": byte_bpe.byte_bpe_query,
    "op5_warc": warc.warc_query,
    "op6_line_dedup": line_dedup.line_dedup_query,
    "op7_decontamination": decontamination.decontamination_query,
    "op8_token_counts": token_counts.token_counts_query,
    "op9_packing": packing.packing_query,
    "op10_language_id": language_id.language_id_query,
    "op11_personal_data": personal_data.personal_data_query,
    "op12_collocations": collocations.collocations_query,
    "op13_resampling": resampling.resampling_query,
}
ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_near_dedup": near_dedup.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
