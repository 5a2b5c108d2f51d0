"""The queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from helixlake.llm.bpe import op4_bpe
from helixlake.llm.html import op1_html
from helixlake.llm.langid import op3_langid
from helixlake.llm.minhash import op2_minhash
from helixlake.llm.packing import op6_packing
from helixlake.llm.passages import op11_passages
from helixlake.llm.pii import op5_pii
from helixlake.llm.resampling import op12_resampling
from helixlake.llm.spotsigs import op7_spotsigs
from helixlake.llm.sql import ORACLE_SQL
from helixlake.llm.suffixes import op9_suffixes
from helixlake.llm.vectors import op8_vectors
from helixlake.llm.warc import op10_warc
from helixlake.llm.whitening import op13_whitening

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_html": op1_html,
    "op2_minhash": op2_minhash,
    "op3_langid": op3_langid,
    "op4_bpe": op4_bpe,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_spotsigs": op7_spotsigs,
    "op8_vectors": op8_vectors,
    "op9_suffixes": op9_suffixes,
    "op10_warc": op10_warc,
    "op11_passages": op11_passages,
    "op12_resampling": op12_resampling,
    "op13_whitening": op13_whitening,
}
