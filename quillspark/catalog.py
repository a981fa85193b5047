"""All queries of the library, by name, and the SQL that says the same."""

from __future__ import annotations

from .operators import accents, cache, contracts, dag, intervals, media, planning, quality, records, relational, scalars, signals, stream, textops, vectors
from .streaming import queries as streaming

MODULES = (vectors, intervals, signals, textops, dag, stream, cache, quality, planning, accents, contracts, records, media, scalars, relational, streaming)
QUERIES = {f.__name__: f for m in MODULES for f in m.QUERIES}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
