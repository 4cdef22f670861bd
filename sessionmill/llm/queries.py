"""The registered queries of the corpus operators. Ranked search has SQL; the others can't be put as plain SQL and are tested in tests/llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm import ranked
from sessionmill.llm.decontaminate import op2_decontaminate
from sessionmill.llm.html_text import op5_html_text
from sessionmill.llm.jaccard import op4_ngram_jaccard
from sessionmill.llm.language import op3_language_id
from sessionmill.llm.lm_score import op8_lm_score
from sessionmill.llm.mixing import op6_source_mix
from sessionmill.llm.packing import op13_packing
from sessionmill.llm.secrets import op10_secret_scan
from sessionmill.llm.toxicity import op1_toxicity
from sessionmill.llm.url_rules import op9_url_rules
from sessionmill.llm.vectors import op7_embedding_neardup
from sessionmill.llm.whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_html_text": op5_html_text,
    "op6_source_mix": op6_source_mix,
    "op7_embedding_neardup": op7_embedding_neardup,
    "op8_lm_score": op8_lm_score,
    "op9_url_rules": op9_url_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_whitening": op11_whitening,
    "op12_ranked_search": ranked.op12_ranked_search,
    "op13_packing": op13_packing,
}
ORACLE_SQL: dict[str, str] = {"op12_ranked_search": ranked.ORACLE_SQL}
