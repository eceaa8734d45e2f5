"""All registered queries of the engine itself and their DuckDB SQL."""

from __future__ import annotations

from chronoloom.plans import features, files, generators, relational, sampling, series

MODULES = (relational, series, sampling, features, generators, files)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
