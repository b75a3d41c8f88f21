"""All registered queries of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .operators import citations, dialogue, evidence, factors, forecast, intake, layout, pages, questions, readings, registers, registry, reports, retrieval, series
from .streaming import history, ingest

MODULES = (retrieval, series, registry, pages, evidence, forecast, factors, citations, questions, reports, readings, dialogue, layout, registers, intake, ingest, history)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
