"""The queries of this subpackage by name, and their SQL."""

from . import byte_bpe, chat, language, licenses, near_dup, neighbours, packing, periodic, quality, repeats, token_store, vector_codes, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_warc_archives": warc.op2_warc_archives,
    "op3_minhash_near_dedup": near_dup.op3_minhash_near_dedup,
    "op4_nearest_neighbours": neighbours.op4_nearest_neighbours,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_chat_format": chat.op6_chat_format,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_token_shards": token_store.op9_token_shards,
    "op10_language_id": language.op10_language_id,
    "op11_repeated_strings": repeats.op11_repeated_strings,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES = {
    "op2_warc_archives": warc.OP2_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
