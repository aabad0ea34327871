"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .langid import op6_language_id
from .lines import OP2_SQL, op2_line_dedup
from .media import op3_media_columns
from .mixing import OP1_SQL, op1_mix_sources
from .neardup import op8_minhash_near_dedup
from .neighbours import op4_nearest_neighbours
from .pieces import op9_sentencepiece
from .substrings import op7_substring_dedup
from .toxicity import op10_toxicity
from .warc import OP5_SQL, op5_warc_audit

QUERIES = {"op1_mix_sources": op1_mix_sources, "op2_line_dedup": op2_line_dedup, "op3_media_columns": op3_media_columns, "op4_nearest_neighbours": op4_nearest_neighbours, "op5_warc_audit": op5_warc_audit, "op6_language_id": op6_language_id, "op9_sentencepiece": op9_sentencepiece, "op10_toxicity": op10_toxicity, "op7_substring_dedup": op7_substring_dedup, "op8_minhash_near_dedup": op8_minhash_near_dedup}
ORACLES = {"op1_mix_sources": OP1_SQL, "op2_line_dedup": OP2_SQL, "op5_warc_audit": OP5_SQL}
