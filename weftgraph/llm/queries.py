"""The corpus operators' queries, by name, and DuckDB SQL where it can express one."""

from __future__ import annotations

import corpus_pipeline
from weftgraph.llm.bpe_chunks import op2_bpe_chunks
from weftgraph.llm.language_id import op1_language_id
from weftgraph.llm.ogg_media import op9_ogg_media
from weftgraph.llm.pii_pseudonyms import op8_pii_pseudonyms
from weftgraph.llm.repeated_spans import op10_repeated_spans
from weftgraph.llm.secret_scan import op6_secret_scan
from weftgraph.llm.simhash_dedup import op4_simhash_dedup
from weftgraph.llm.source_mix import OP3_SQL, op3_source_mix
from weftgraph.llm.topk_search import OP7_SQL, op7_topk_search
from weftgraph.llm.url_rules import op5_url_rules

QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe_chunks, op3_source_mix, op4_simhash_dedup, op5_url_rules, op6_secret_scan, op7_topk_search, op8_pii_pseudonyms, op9_ogg_media, op10_repeated_spans)} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op3_source_mix": OP3_SQL, "op7_topk_search": OP7_SQL}
