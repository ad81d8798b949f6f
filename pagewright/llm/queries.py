"""The queries of this subpackage, by name, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.bpe import op9_byte_bpe
from pagewright.llm.chattree import OP5_SQL, op5_chat_format
from pagewright.llm.langid import op4_language_id
from pagewright.llm.mixing import OP3_SQL, op3_mixing
from pagewright.llm.neardup import OP10_SQL, op10_embedding_near_dedup
from pagewright.llm.ngramjoin import OP6_SQL, op6_ngram_jaccard_join
from pagewright.llm.substring import OP8_SQL, op8_substring_dedup
from pagewright.llm.topk import OP7_SQL, op7_topk_search
from pagewright.llm.toxicity import op2_toxicity
from pagewright.llm.urlfilter import OP1_SQL, op1_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_chat_format": op5_chat_format,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_topk_search": op7_topk_search,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op3_mixing": OP3_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_ngram_jaccard_join": OP6_SQL,
    "op7_topk_search": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op10_embedding_near_dedup": OP10_SQL,
}
