"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tallybook.llm.op1_masked_lm import op1_masked_lm
from tallybook.llm.op2_quality_rules import ORACLE as OP2_SQL
from tallybook.llm.op2_quality_rules import op2_quality_rules
from tallybook.llm.op3_suffix_dedup import op3_suffix_dedup
from tallybook.llm.op4_media_shards import op4_media_shards
from tallybook.llm.op5_length_buckets import op5_length_buckets
from tallybook.llm.op6_site_quality import op6_site_quality
from tallybook.llm.op7_packed_ids import op7_packed_ids
from tallybook.llm.op8_ngram_jaccard import op8_ngram_jaccard
from tallybook.llm.op9_piece_codec import op9_piece_codec
from tallybook.llm.op10_substring_dedup import op10_substring_dedup
from tallybook.llm.op11_simhash_near import op11_simhash_near
from tallybook.llm.op12_hard_negatives import ORACLE as OP12_SQL
from tallybook.llm.op12_hard_negatives import op12_hard_negatives
from tallybook.llm.op13_spelling_forms import op13_spelling_forms

QUERIES = {
    "op1_masked_lm": op1_masked_lm,
    "op2_quality_rules": op2_quality_rules,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_media_shards": op4_media_shards,
    "op5_length_buckets": op5_length_buckets,
    "op6_site_quality": op6_site_quality,
    "op7_packed_ids": op7_packed_ids,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_piece_codec": op9_piece_codec,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_simhash_near": op11_simhash_near,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_forms": op13_spelling_forms,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": OP2_SQL,
    "op12_hard_negatives": OP12_SQL,
}
