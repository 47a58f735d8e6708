"""Registry of the library's queries and their SQL counterparts."""

from __future__ import annotations

from . import bundle_queries, consensus_queries, data_queries, gold_queries, grounding_queries, layout_queries, markup_queries, program_queries, region_queries, repair_queries, structure_queries, text_queries, tree_queries, visual_queries

_MODULES = (layout_queries, text_queries, data_queries, visual_queries, structure_queries, tree_queries, region_queries, program_queries, repair_queries, markup_queries, consensus_queries, grounding_queries, gold_queries, bundle_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
flagship = text_queries.t02_fair_topk
