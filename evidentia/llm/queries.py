"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from . import align, chat, exact_dedup, filter_audit, html_text, line_dedup, media, minhash, mixing, packing, quality, simhash, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_chat_format": chat.op3_chat_format,
    "op4_near_dedup": minhash.op4_near_dedup,
    "op5_html_text": html_text.op5_html_text,
    "op6_mixing": mixing.op6_mixing,
    "op7_media_columns": media.op7_media_columns,
    "op8_quality": quality.op8_quality,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_packing": packing.op10_packing,
    "op11_simhash": simhash.op11_simhash,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_cross_tokenizer": align.op13_cross_tokenizer,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_chat_format": chat.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
