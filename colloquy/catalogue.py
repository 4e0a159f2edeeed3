"""All queries of the engine, and the SQL that tells the same results."""

from __future__ import annotations

from .functions import text
from .operators import alignment, lifecycle, mutations, pruned, recency, relational, signal, transcripts, vectors, views
from .plans import evaluation, summary
from .sources import queries as sources
from .streaming import folds, speech

_PARTS = [relational, views, lifecycle, transcripts, signal, alignment, vectors, pruned, recency, mutations, text, evaluation, summary, sources, folds, speech]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
