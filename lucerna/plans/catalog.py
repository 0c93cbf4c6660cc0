"""All registered queries of the library and their SQL."""

from lucerna.plans import catalog_audits, catalog_guards, catalog_history, catalog_labels, catalog_policies, catalog_sources

_PARTS = (catalog_labels, catalog_history, catalog_audits, catalog_guards, catalog_policies, catalog_sources)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
