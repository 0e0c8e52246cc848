"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from fluvia.llm import bpe, html_text, langid, lines, neighbours, packing, pii, quality, simhash, vectors_dedup

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality": quality.op3_quality,
    "op4_langid": langid.op4_langid,
    "op5_simhash": simhash.op5_simhash,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_packing": packing.op7_packing,
    "op8_vectors": vectors_dedup.op8_vectors,
    "op9_lines": lines.op9_lines,
    "op10_html": html_text.op10_html,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
