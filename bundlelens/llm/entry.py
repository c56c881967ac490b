"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from bundlelens.llm import chat, decontaminate, languages, linededup, merkle, minhash, neighbours, packing, repair, simhash, substrings, tokens, warc

QUERIES = {
    "op1_language_id": languages.op1_language_id,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_warc": warc.op3_warc,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_token_records": tokens.op5_token_records,
    "op6_substrings": substrings.op6_substrings,
    "op7_chat": chat.op7_chat,
    "op8_best_fit": packing.op8_best_fit,
    "op9_line_templates": linededup.op9_line_templates,
    "op10_simhash": simhash.op10_simhash,
    "op11_repair": repair.op11_repair,
    "op12_minhash": minhash.op12_minhash,
    "op13_merkle": merkle.op13_merkle,
}

SQL: dict[str, str] = {
    "op3_warc": warc.SQL,
    "op7_chat": chat.SQL,
    "op9_line_templates": linededup.SQL,
    "op11_repair": repair.SQL,
    "op12_minhash": minhash.SQL,
    "op13_merkle": merkle.SQL,
}
