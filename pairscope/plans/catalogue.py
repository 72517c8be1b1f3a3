"""Every registered query of the engine with its SQL twin."""

from __future__ import annotations

from pairscope.plans import audit, behavioral, details, files, panel, provenance, quality, statistics, studies

FLAGSHIP = "A06_transition_summary"
BOOKS = [behavioral.book, panel.book, statistics.book, quality.book, studies.book, files.book, provenance.book, details.book, audit.book]
QUERIES = {name: query for book in BOOKS for name, query in book.queries.items()}
ORACLES = {name: sql for book in BOOKS for name, sql in book.oracles.items()}
