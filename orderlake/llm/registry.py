"""The registered queries of this subpackage and their SQL."""

from orderlake.llm import alignment, chat, exact, jaccard, language, mixing, pieces, quality, repeats, tokens, trie, winnowing, wrappers

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_language_id": language.op2_language_id,
    "op3_exact_dedup": exact.op3_exact_dedup,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_mixing": mixing.op5_mixing,
    "op6_html_extraction": wrappers.op6_html_extraction,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op8_suffix_dedup": repeats.op8_suffix_dedup,
    "op9_token_output": tokens.op9_token_output,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_decontamination": winnowing.op12_decontamination,
    "op13_cross_tokenizer": alignment.op13_cross_tokenizer,
    "quality_ablations": quality.quality_ablations,
}

ORACLE_SQL = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op3_exact_dedup": exact.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
    "op12_decontamination": winnowing.OP12_SQL,
    "quality_ablations": quality.ABLATIONS_SQL,
}
