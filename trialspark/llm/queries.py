"""The queries of this subpackage, by name, and the SQL that checks them where there is any."""

from __future__ import annotations

from trialspark.llm.media import op3_media_columns
from trialspark.llm.neighbours import op10_nearest_neighbours
from trialspark.llm.ngram_join import op6_ngram_join
from trialspark.llm.packing import op8_best_fit_packing
from trialspark.llm.passages import op7_substring_dedup
from trialspark.llm.quality import op4_quality
from trialspark.llm.secret_scan import OP9_SQL, op9_secret_scan
from trialspark.llm.sentencepiece import op1_sentencepiece
from trialspark.llm.token_scan import op5_token_counts
from trialspark.llm.token_store import op2_token_store

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_store": op2_token_store,
    "op3_media_columns": op3_media_columns,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_ngram_join": op6_ngram_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op9_secret_scan": OP9_SQL,
}
