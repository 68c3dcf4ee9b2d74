"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from tarmac.llm import (bpe_lexicon, collocations, context_tree, crf, decontam, hashing_index, html_text, line_dedup, minhash,
                        orc_tokens, pieces, spelling, suffix_dedup)

QUERIES = {
    "op1_decontam": decontam.query,
    "op2_sentencepiece": pieces.query,
    "op3_minhash": minhash.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_nearest": hashing_index.query,
    "op6_context_tree": context_tree.query,
    "op7_toxicity": crf.query,
    "op8_html_extract": html_text.query,
    "op9_orc_tokens": orc_tokens.query,
    "op10_line_dedup": line_dedup.query,
    "op11_spelling": spelling.query,
    "op12_collocations": collocations.query,
    "op13_bpe_lexicon": bpe_lexicon.query,
}

ORACLE_SQL = {
    "op10_line_dedup": line_dedup.SQL,
    "op12_collocations": collocations.SQL,
}
