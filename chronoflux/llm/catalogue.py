"""Registered queries of the text operators, and the SQL of those that SQL can express."""

from chronoflux.llm import decontaminate, language, lexical, licenses, mixing, neardup, periods, quality, simhash, substrings, token_files, tokens, toxicity

QUERIES = {f.__name__: f for f in (
    quality.op1_quality, language.op2_language, toxicity.op3_toxicity, tokens.op4_token_counts, mixing.op5_mixing, neardup.op6_near_duplicates,
    substrings.op7_repeated_substrings, decontaminate.op8_decontamination, licenses.op9_license_scan, token_files.op10_token_files,
    lexical.op11_lexical_search, periods.op12_periodic_runs, simhash.op13_simhash)}

ORACLE = {"op5_mixing": mixing.OP5_SQL, "op8_decontamination": decontaminate.OP8_SQL, "op9_license_scan": licenses.OP9_SQL, "op11_lexical_search": lexical.OP11_SQL}
