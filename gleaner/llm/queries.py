"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from gleaner.llm.byte_bpe import op8_byte_level_bpe
from gleaner.llm.hamming import OP3_SQL, op2_approximate_nearest_neighbours, op3_exact_top_k
from gleaner.llm.jaccard_join import op10_ngram_jaccard_join
from gleaner.llm.lexical_search import OP11_SQL, op11_ranked_lexical_search
from gleaner.llm.license_scan import op7_license_scan
from gleaner.llm.line_dedup import OP1_SQL, op1_line_dedup
from gleaner.llm.ordinal_quality import op6_quality_classifier
from gleaner.llm.packing import op4_packing
from gleaner.llm.preference_format import OP5_SQL, op5_chat_formatting
from gleaner.llm.prefix_trie import OP13_SQL, op13_conversation_prefix_trie
from gleaner.llm.suffix_dedup import op9_suffix_array_dedup
from gleaner.llm.url_filter import OP12_SQL, op12_url_filters

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_approximate_nearest_neighbours": op2_approximate_nearest_neighbours,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_packing": op4_packing,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_license_scan": op7_license_scan,
    "op8_byte_level_bpe": op8_byte_level_bpe,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_url_filters": op12_url_filters,
    "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
}

ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op3_exact_top_k": OP3_SQL, "op5_chat_formatting": OP5_SQL, "op11_ranked_lexical_search": OP11_SQL, "op12_url_filters": OP12_SQL, "op13_conversation_prefix_trie": OP13_SQL}
