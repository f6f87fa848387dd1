"""All registered queries and their oracle SQL, gathered from the catalog modules."""

from __future__ import annotations

from kiln.plans import catalog_analysis, catalog_learn, catalog_model, catalog_prep

QUERIES: dict = {}
ORACLE: dict = {}

for _mod in (catalog_prep, catalog_analysis, catalog_model, catalog_learn):
    QUERIES.update(_mod.Q)
    ORACLE.update(_mod.O)
