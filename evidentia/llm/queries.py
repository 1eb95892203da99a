"""The subpackage's queries and their SQL."""

from __future__ import annotations

from evidentia.llm.embeddings import OP1_SQL, op1_embedding_dedup
from evidentia.llm.html import op10_html
from evidentia.llm.language import op8_language
from evidentia.llm.ngrams import OP2_SQL, op2_stupid_backoff
from evidentia.llm.packing import op3_packing
from evidentia.llm.quality import OP4_SQL, op4_quality
from evidentia.llm.simhash import op6_simhash
from evidentia.llm.urlfilter import OP7_SQL, op7_url_filter
from evidentia.llm.wavelet import op5_wavelet_matrix
from evidentia.llm.wordtable import op9_word_table

QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_stupid_backoff, op3_packing, op4_quality, op5_wavelet_matrix, op6_simhash, op7_url_filter, op8_language, op9_word_table, op10_html)}
ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op2_stupid_backoff": OP2_SQL, "op4_quality": OP4_SQL, "op7_url_filter": OP7_SQL}
