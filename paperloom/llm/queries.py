"""The queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .byte_bpe import op9_byte_bpe
from .centroid_clustering import OP12_SQL, op12_centroid_clustering
from .conversation_trie import OP13_SQL, op13_conversation_trie
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .language_id import op5_language_id
from .mixing import op6_mixing
from .ngram_join import OP1_SQL, op1_ngram_join
from .quality_rules import op10_quality_rules
from .suffix_dedup import op8_suffix_dedup
from .token_files import op11_token_files
from .toxicity import op7_toxicity
from .url_filter import op3_url_filter
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_warc": op4_warc,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_files": op11_token_files,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES = {"op1_ngram_join": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op4_warc": OP4_SQL, "op12_centroid_clustering": OP12_SQL, "op13_conversation_trie": OP13_SQL}
