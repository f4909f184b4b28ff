"""All registered queries: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

from . import applied, pipeline, relational, retrieval, structure, textual

REGISTRY = {}
for _m in (relational, textual, retrieval, structure, pipeline, applied):
    REGISTRY.update(_m.REGISTRY)
