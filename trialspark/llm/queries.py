"""The subpackage's queries, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chunked_bpe, collocations, filter_audit, html_crf, isolation, language_id, line_runs, order_packing, packing, partenum, pii, shuffle_shards, vector_links

QUERIES = {
    "op1_line_dedup": line_runs.op1,
    "op2_quality_forest": isolation.op2,
    "op3_personal_data": pii.op3,
    "op4_language_id": language_id.op4,
    "op5_sharding": shuffle_shards.op5,
    "op6_chunked_bpe": chunked_bpe.op6,
    "op7_vector_links": vector_links.op7,
    "op8_html_text": html_crf.op8,
    "op9_packing": packing.op9,
    "op10_jaccard_join": partenum.op10,
    "op11_order_packing": order_packing.op11,
    "op12_collocations": collocations.op12,
    "op13_filter_audit": filter_audit.op13,
}

ORACLES = {
    "op1_line_dedup": line_runs.op1_sql(),
    "op7_vector_links": vector_links.op7_sql(),
    "op10_jaccard_join": partenum.op10_sql(),
    "op12_collocations": collocations.op12_sql(),
    "op13_filter_audit": filter_audit.op13_sql(),
}
