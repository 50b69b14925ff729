"""The subpackage's queries by name."""

from cellweave.llm.chat import op2_chat
from cellweave.llm.fingerprint import op8_fingerprint
from cellweave.llm.mixing import op7_mixing
from cellweave.llm.near_dedup import op1_near_dedup
from cellweave.llm.oracles import SQL  # noqa: F401
from cellweave.llm.pieces import op5_sentencepiece
from cellweave.llm.pii import op4_pii
from cellweave.llm.quality import op6_quality
from cellweave.llm.sharding import op10_sharding
from cellweave.llm.substring_dedup import op9_substring_dedup
from cellweave.llm.topk import op3_topk

QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_chat, op3_topk, op4_pii, op5_sentencepiece, op6_quality, op7_mixing, op8_fingerprint, op9_substring_dedup, op10_sharding)}
