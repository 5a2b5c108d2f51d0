"""All queries of the library by name, and the same in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from helixlake.plans import alignments, cascades, catalog, files, models, parses, priors, scalars, trees, windows

MODULES = (catalog, scalars, windows, alignments, files, models, trees, parses, cascades, priors)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = catalog.FLAGSHIP
