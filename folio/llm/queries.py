"""The registered queries of this subpackage and their SQL."""

from folio.llm import chat, collocations, decontaminate, language, lines, packing, quality, simhash, substrings, suffixes, token_counts, token_files, whitening

QUERIES = {
    "op1_token_files": token_files.query,
    "op2_simhash": simhash.query,
    "op3_quality_rules": quality.query,
    "op4_line_dedup": lines.query,
    "op5_chat_format": chat.query,
    "op6_packing": packing.query,
    "op7_decontaminate": decontaminate.query,
    "op8_language_id": language.query,
    "op9_substrings": substrings.query,
    "op10_suffix_array": suffixes.query,
    "op11_token_counts": token_counts.query,
    "op12_whitening": whitening.query,
    "op13_collocations": collocations.query,
}

ORACLE_SQL = {
    "op4_line_dedup": lines.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op9_substrings": substrings.ORACLE,
    "op10_suffix_array": suffixes.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
