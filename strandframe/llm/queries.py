"""The corpus queries and their SQL."""

from __future__ import annotations

from strandframe.llm import bitpack, chat, dart_minhash, decontaminate, filter_audit, multi_index, packing, periodic_runs, recompress, suffix_array, toxicity, url_tree, word_bpe

QUERIES = {
    "op1_chat_formatting": chat.query,
    "op2_multi_index": multi_index.query,
    "op3_packing": packing.query,
    "op4_token_files": bitpack.query,
    "op5_decontamination": decontaminate.query,
    "op6_suffix_array": suffix_array.query,
    "op7_dart_minhash": dart_minhash.query,
    "op8_recompression": recompress.query,
    "op9_toxicity": toxicity.query,
    "op10_url_filters": url_tree.query,
    "op11_word_bpe": word_bpe.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_filter_audit": filter_audit.query,
}
SQL = {
    "op1_chat_formatting": chat.SQL,
    "op5_decontamination": decontaminate.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
