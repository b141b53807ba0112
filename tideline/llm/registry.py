"""Queries of this subpackage and, where SQL can express them, their DuckDB form."""

from tideline.llm import bpe, collocations, forest, jaccard, mixing, quality, quotes, repair, rules, secrets, sharding, toxicity, wordpiece
from tideline.llm.oracles import ORACLES  # noqa: F401  (the entry takes both from here)

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_token_counts": wordpiece.op3_token_counts,
    "op4_embedding_near_dedup": forest.op4_embedding_near_dedup,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_quality_rules": rules.op6_quality_rules,
    "op7_ngram_jaccard_join": jaccard.op7_ngram_jaccard_join,
    "op8_toxicity_classifier": toxicity.op8_toxicity_classifier,
    "op9_bpe_encode_decode": bpe.op9_bpe_encode_decode,
    "op10_chat_formatting": quotes.op10_chat_formatting,
    "op11_sharding": sharding.op11_sharding,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_conversation_repair": repair.op13_conversation_repair,
}
