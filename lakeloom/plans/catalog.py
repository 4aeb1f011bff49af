"""Every registered query of the library, without the llm subpackage."""

from __future__ import annotations

from lakeloom.functions import families, scalar, tables as table_functions
from lakeloom.operators import aggregates, corpus, intervals, joins, keyed, lake, neardup, payloads, rollups, search, sets, star, vector_index, web, windows
from lakeloom.plans.registry import Query
from lakeloom.sources import captured, formats
from lakeloom.streaming import events

MODULES = (star, web, payloads, corpus, neardup, keyed, lake, search, vector_index, joins, intervals, aggregates, rollups, windows, sets, scalar, families, table_functions, formats, captured, events)

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    if _clash := QUERIES.keys() & _module.registry.queries.keys():
        raise ValueError(f"registered twice: {sorted(_clash)}")
    QUERIES |= _module.registry.queries
    ORACLES |= _module.registry.oracles
