"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import queries
from .queries import admin, catalog, chunks, fulltext, graph, keyed, pages, parsing, retrieval, sources, streams, upkeep, vectors, versions  # noqa: F401

QUERIES = queries.QUERIES
ORACLES = queries.ORACLES
FLAGSHIP = retrieval.ask_hybrid
