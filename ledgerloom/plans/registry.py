"""Queries of the library's own operators, with SQL where SQL can express them."""

from ledgerloom.operators import alignment, commitments, corpus, draws, evaluation, evidence, extraction, grounding, layout, ledger, nearness, olap, panels, passages, pieces, retrieval, rules, screening, search, similar
from ledgerloom.sources import connectors, pages
from ledgerloom.streaming import flows, jobs

_MODULES = (ledger, commitments, olap, corpus, retrieval, alignment, passages, evaluation, flows, screening, extraction, grounding, rules, evidence, panels, layout, pieces, nearness, search, similar, draws, connectors, pages, jobs)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
