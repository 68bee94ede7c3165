"""The corpus operators as queries over whole tables: name -> callable, and SQL where it can say the same."""

from __future__ import annotations

from kickframe.llm import align, chat, licenses, mixing, pieces, prefix_trie, quality, search, sharding, simhash, spotsigs, token_orc, urls

QUERIES = {
    "op1_url_filter": urls.query,
    "op2_sentencepiece": pieces.query,
    "op3_sharding": sharding.query,
    "op4_licenses": licenses.query,
    "op5_simhash": simhash.query,
    "op6_spotsigs": spotsigs.query,
    "op7_mixing": mixing.query,
    "op8_chat_format": chat.query,
    "op9_search": search.query,
    "op10_quality": quality.query,
    "op11_token_orc": token_orc.query,
    "op12_align": align.query,
    "op13_prefix_trie": prefix_trie.query,
}
SQL = {"op8_chat_format": chat.SQL, "op13_prefix_trie": prefix_trie.SQL}
