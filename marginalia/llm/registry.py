"""The queries of the corpus operators, with SQL where SQL gives the same rows."""

from __future__ import annotations

from marginalia.llm.htmltext import op1_html_extraction
from marginalia.llm.langid import op3_language_id
from marginalia.llm.licenses import op9_license_scans
from marginalia.llm.mixing import OP6_SQL, op6_mixing
from marginalia.llm.pieces import op4_sentencepiece
from marginalia.llm.quality import op2_quality_rules
from marginalia.llm.simhash import op8_simhash_near_dedup
from marginalia.llm.tokenshards import op10_token_shards
from marginalia.llm.topk import OP7_SQL, op7_exact_top_k
from marginalia.llm.toxicity import op5_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_html_extraction, op2_quality_rules, op3_language_id, op4_sentencepiece, op5_toxicity, op6_mixing, op7_exact_top_k, op8_simhash_near_dedup, op9_license_scans, op10_token_shards)
}
ORACLE_SQL = {"op6_mixing": OP6_SQL, "op7_exact_top_k": OP7_SQL}
