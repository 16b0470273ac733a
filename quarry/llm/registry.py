"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quarry.llm import codes, embedding_dedup, minhash, topk
from quarry.llm.bpe import op1_bpe
from quarry.llm.codes import op13_codes
from quarry.llm.embedding_dedup import op3_embedding_dedup
from quarry.llm.html_text import op9_html
from quarry.llm.langid import op2_langid
from quarry.llm.licenses import op7_licenses
from quarry.llm.minhash import op6_minhash
from quarry.llm.packing import op4_packing
from quarry.llm.pieces import op11_sentencepiece
from quarry.llm.sharding import op5_sharding
from quarry.llm.topk import op8_topk
from quarry.llm.toxicity import op10_toxicity
from quarry.llm.whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_bpe, op2_langid, op3_embedding_dedup, op4_packing, op5_sharding, op6_minhash, op7_licenses, op8_topk, op9_html, op10_toxicity, op11_sentencepiece, op12_whitening, op13_codes)}
ORACLE_SQL = {"op3_embedding_dedup": embedding_dedup.ORACLE, "op6_minhash": minhash.ORACLE, "op8_topk": topk.ORACLE, "op13_codes": codes.ORACLE}
