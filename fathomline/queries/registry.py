"""All core queries, from the modules of this folder."""

from __future__ import annotations

from fathomline.queries import chunking, containers, layouts, reading, records, references, retrieval, verification

_MODULES = (retrieval, chunking, verification, layouts, reading, records, references, containers)

QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE: dict = {k: f for m in _MODULES for k, f in m.ORACLE.items()}
